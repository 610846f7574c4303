"""Languages by masked filters: n-grams and counts against plain ones, and held-out accuracy."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from traitspark.llm import language_id
from traitspark.llm.words import unsigned

SCHEMA = "doc_id long, text string, lang string, score string, held_out int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 7) for i, t, lang in rows], SCHEMA)


def plain_grams(text):
    """N-grams of a text as strings."""
    word, out = "", Counter()
    for c in [*text.lower(), " "]:
        if c.isalpha():
            word += c
            continue
        if word:
            edged = f" {word} "
            for n in language_id.SIZES:
                for i in range(len(edged) - n + 1):
                    gram = edged[i : i + n]
                    if gram.strip() and not (n == 1 and gram == " "):
                        out[gram] += 1
        word = ""
    return out


def test_grams_are_those_of_plain_strings():
    texts = ["Ein Wort, ein Ort 3x", "", "ÀÉ日本 a", "a a a", "x" * 50, "İstanbul 🙂", "퟿ ab"]
    found = language_id.Grams(texts)
    per_row = [Counter() for _ in texts]
    for word, row in zip(found.of, found.row):
        per_row[row].update(found.gram[found.word == word].tolist())
    for text, counted in zip(texts, per_row):
        assert counted == {code(g): n for g, n in plain_grams(text).items()}
    assert found.has_letter.tolist() == [any(c.isalpha() for c in t) for t in texts]
    both = language_id.Grams(["ab ab", "ab"])
    assert np.bincount(both.row).tolist() == [2, 1] and both.words == 1


def test_counts_and_masks(spark):
    rows = [(1, "der Hund der", "de"), (2, "the dog the", "en"), (3, "the end", "en"), (4, None, "en"), (5, "gar nix", None)]
    learned = language_id.learn(frame(spark, rows))
    assert learned.languages == ["de", "en"]
    total = {"de": plain_grams("der Hund der"), "en": plain_grams("the dog the") + plain_grams("the end")}
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in total.items()}
    grams = sorted(set(total["de"]) | set(total["en"]))
    wanted = [sum(1 << i for i, k in enumerate(("de", "en")) if rate[k].get(g, 0) >= 0.5 * max(r.get(g, 0) for r in rate.values())) for g in grams]
    # the learned filter never lacks a bit, and its false answers are few
    codes = np.array([code(g) for g in grams], np.uint64)
    found = learned.found(codes)[0].tolist()
    assert all(f & w == w for f, w in zip(found, wanted))
    assert sum(f != w for f, w in zip(found, wanted)) <= len(grams) // 5


def code(gram):
    """The hash of one n-gram string."""
    points = np.frombuffer(gram.encode("utf-32-le"), np.uint32)
    mixed = language_id.mix(points.astype(np.uint64))
    total = np.full(1, np.uint64(len(points)))
    for j in range(len(points)):
        total += mixed[j : j + 1] * (language_id.mix(np.array([100 * len(points) + j], np.uint64)) | np.uint64(1))
    return int(language_id.mix(total)[0])


def test_false_answers_are_corrected():
    """A crowded filter answers for languages that have nothing of a text; corrected counts do not."""
    rng = np.random.default_rng(2)
    crowded = language_id.Filter(["aa", "bb", "cc"], 4096, "aa")
    crowded.put(rng.integers(0, 1 << 63, 3000).astype(np.uint64), np.zeros(3000, np.int64), np.full(3000, 1, np.uint64))
    own = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    crowded.put(own, np.zeros(200, np.int64), np.full(200, 2, np.uint64))
    crowded.close()
    hits = np.array([sum((int(m) >> i) & 1 for m in crowded.found(own)[0]) for i in range(3)])
    assert hits[1] == 200 and hits[2] == 0 and hits[0] > 100
    true = (hits - 200 * crowded.false) / (1 - crowded.false)
    assert abs(true[0]) < 40 and abs(true[1] - 200) < 1


def test_many_languages():
    """More than 64 take a second word of the masks."""
    names = [f"l{i:03d}" for i in range(130)]
    many = language_id.Filter(names, 1 << 14, "l000")
    for i in (0, 63, 64, 129):
        gram = np.unique(language_id.Grams([f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}"]).gram)
        many.put(gram, np.full(len(gram), i // 64), np.full(len(gram), 1 << (i % 64), np.uint64))
    many.close()
    assert many.judge([f"wort{chr(97 + 129 % 26)}{chr(97 + 129 // 26)}"])[0] == ["l129"]


def test_odd_rows(spark):
    base = [(i, "der Hund und die Katze laufen schnell nach Haus", "de") for i in range(40)]
    base += [(100 + i, "the dog and the cat run quickly to the house", "en") for i in range(40)]
    odd = [(1, None, "de"), (2, "", "de"), (3, "123 !?", "en"), (None, "die Katze und der Hund", "xx"), (4, "Пример текста", None),
           (5, "the cat " * 200_000, None), (5, "the cat", None), (6, "x", "en")]
    out = language_id.identify(frame(spark, base + odd)).where("doc_id is null or doc_id < 7").collect()
    found = {}
    for r in out:
        found.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert ("und", 0.0) in found[1] and ("und", 0.0) in found[2] and ("und", 0.0) in found[3]
    assert found[None][0][0] == "de"
    assert {x[0] for x in found[4]} <= {"de", "en"}
    assert sum(x[0] == "en" for x in found[5]) == 2
    assert all(0 <= s <= 1 for x in found.values() for _, s in x)


def test_nothing_learned_and_empty(spark):
    out = language_id.identify(frame(spark, [(1, "the cat", None)])).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]
    assert language_id.identify(frame(spark, [])).count() == 0


def test_given_away_counts_add_up(spark, monkeypatch):
    rows = [(i, f"wort{chr(97 + i % 26)} und mehr davon{chr(97 + i // 26)}", "de") for i in range(300)]
    whole = frame(spark, rows).mapInArrow(language_id._count_rows, "lang string, gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    whole = {r.gram: r.n for r in whole.collect()}
    monkeypatch.setattr(language_id, "HELD", 50)
    monkeypatch.setattr(language_id, "PIECE_CHARS", 40)
    parts = frame(spark, rows).mapInArrow(language_id._count_rows, "lang string, gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    assert {r.gram: r.n for r in parts.collect()} == whole
    wanted = sum((plain_grams(t) for _, t, _ in rows), Counter())
    assert sorted(whole.values()) == sorted(wanted.values())
    assert {int(x) for x in unsigned(np.array(list(whole)))} == {code(g) for g in wanted}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang_pred == r.lang for r in out)
    assert len(out) > 200 and right >= 0.95 * len(out)
