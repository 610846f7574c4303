"""Two tokenizers' links against a plain count of all of them."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from traitspark.llm import alignment
from traitspark.llm.queries import vocabulary

PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def plain(rows):
    """Links of every document, one by one."""
    from tokenizers import Tokenizer

    sides = alignment.Sides(*PATHS)
    library = Tokenizer.from_file(PATHS[0])
    library.encode_special_tokens = True
    docs, count = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        a = library.encode(" " + text, add_special_tokens=False).ids
        b = sides.piece.encode(text)
        raw = (" " + text).encode()
        if not text or b"".join(sides.a_bytes[i] for i in a) != raw or b"".join(sides.b_bytes[i] for i in b) != raw:
            a, b = [], []
        groups, i, j, left, right = [], 0, 0, 0, 0
        now = [[], []]
        while i < len(a) or j < len(b):
            if left <= right:
                left += len(sides.a_bytes[a[i]])
                now[0].append(a[i])
                i += 1
            else:
                right += len(sides.b_bytes[b[j]])
                now[1].append(b[j])
                j += 1
            if left == right:
                groups.append(now)
                now = [[], []]
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        count.update(links.keys())
        docs.append((doc_id, a, b, groups, links))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, a, b, groups, links in docs:
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append(
            (
                doc_id,
                len(a),
                len(b),
                len(groups),
                sum(links.values()),
                sum(n for k, n in links.items() if count[k] == best[k[0]]),
                sum(n * count[k] for k, n in links.items()),
                hashlib.sha256(said.encode()).hexdigest() if groups else "",
            )
        )
    return sorted(out, key=str)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "The model of all models, the very same."), (3, "The model of all models, the very same."),
        (4, " "), (5, "a▁b"), (6, "tiré à part\r\n\n\tx  y"), (None, "日本語のテキスト mixed"), (7, "<|endoftext|> <s> </s>"),
        (8, "🙂🙂 é ﬁ ① \x00"), (9, "word " * 20000), (10, "x" * 5000), (11, "ÿþ" * 3000), (12, "Kontext " * 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit(1)).withColumn("part", F.lit("x"))
    found = sorted((tuple(r) for r in alignment.align_corpus(docs, *PATHS).collect()), key=str)
    assert found == plain(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_corpus(docs, *PATHS).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_documents(spark, sf_dir, monkeypatch, small):
    """Also with many runs, slices and blocks."""
    from pyspark import cloudpickle

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if small:  # values of the module travel with the functions that read them
        assert cloudpickle.list_registry_pickle_by_value()
        for name, value in (("RUN_RECORDS", 3000), ("BLOCK_RECORDS", 100), ("SLICE_RUNS", 3), ("EXPAND", 50), ("PIECE_BYTES", 5000)):
            monkeypatch.setattr(alignment, name, value)
    found = sorted((tuple(r) for r in alignment.align_corpus(docs, *PATHS).collect()), key=str)
    assert found == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
