"""Texts of a megabyte and columns with clashing names, through every operator on texts."""

import pytest
from pyspark.sql import functions as F

from traitspark.llm import alignment, jaccard_join, language_id, line_dedup, mixing, perplexity, quality_rules, substring_dedup, toxicity
from traitspark.llm.queries import vocabulary

CLASHING = ("key", "n", "node", "lang_of", "score", "place", "first", "words", "weight", "slice", "part", "run")
WORDS = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{i}" for i in range(120_000)]


@pytest.fixture(scope="module")
def rows():
    long = " ".join(WORDS)
    assert len(long) > 1_000_000
    short = " ".join(WORDS[500:560])
    return [(1, long), (2, long), (3, long.replace("wordak0", "other", 1)), (4, short), (5, "a quite different text of a few words")]


@pytest.fixture(scope="module")
def frame(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in CLASHING}).repartition(2)


def test_jaccard(frame):
    got = {r.doc_id: r for r in jaccard_join.components(frame).collect()}
    assert [got[i].component_id for i in range(1, 6)] == [1, 1, 1, 4, 5]
    assert got[1].n_shingles == len(WORDS) - 4


def test_substrings(frame, rows):
    got = substring_dedup.digest(substring_dedup.remove_repeats(frame)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, substring_dedup.brute_force(rows)))


def test_lines(spark, frame):
    got = {r.doc_id: r for r in line_dedup.remove_lines(frame).collect()}
    assert [got[i].n_exact + got[i].n_near for i in range(1, 6)] == [0, 1, 1, 0, 0]


def test_quality_and_language(spark, frame):
    trusted = spark.createDataFrame([(1,), (4,)], "doc_id long")
    rules = {r.doc_id: r for r in quality_rules.judge(frame, trusted).collect()}
    assert rules[1].n_words == len(WORDS) and len(rules) == 5
    scored = {r.doc_id: r for r in perplexity.classify(frame, trusted).collect()}
    assert len(scored) == 5 and scored[1].perplexity == scored[2].perplexity
    assert {r.lang_pred for r in language_id.identify(frame).collect()} <= {"en", "und"}


def test_mixture_and_toxicity(spark, frame):
    mixed = {r.doc_id: r for r in mixing.mix(frame).collect()}
    assert mixed[1].n_tokens == len(WORDS) and len(mixed) == 5
    labels = spark.createDataFrame([(4, 0), (5, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.classify(frame, labels).collect())


def test_alignment(frame, rows):
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    got = {r.doc_id: r for r in alignment.align_corpus(frame, *paths).collect()}
    assert got[1].n_a > len(WORDS) and got[1].n_links >= got[1].n_groups > 0 and got[1].groups_sha256 == got[2].groups_sha256
