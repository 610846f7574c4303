"""A training corpus from ``documents``: quality, lines, near copies, mixture, tokens.

Every stage takes all that the one before kept, and its decisions take effect:
what it rejects or removes is gone from its result. ``run`` writes each stage's
result as Parquet into the shared folder and reads it again for the next, so a
lost executor costs tasks of the current stage only.

Rows without a ``doc_id`` pass where a stage cannot judge them; null and empty
texts are rejected by the first stage; an empty table passes all stages; texts of any
length pass whole; of rows that repeat id and text one stays, and rows that repeat an
id are judged each by its own text. Columns other than those of ``documents`` are
dropped.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import traitspark
from traitspark.llm import bpe, jaccard_join, line_dedup, mixing, perplexity
from traitspark.llm.queries import vocabulary
from traitspark.session import materialise

# Python workers get the package with the task, wherever they were started.
cloudpickle.register_pickle_by_value(traitspark)

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Share of the tokens that the mixture keeps.
MIX_SHARE = 0.8


def _matching(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are in ``kept`` (``doc_id, text_key``)."""
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_key"))
    return docs.join(kept.hint("merge"), same, "left_semi").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose perplexity is within their language's limit."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return _matching(docs, perplexity.classify(docs, trusted).where("kept"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; a document that had words and has none left goes."""
    kept = line_dedup.remove_lines(docs, carry=["lang", "source"])
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.where(words | (F.col("n_exact") + F.col("n_near") == 0)).select(
        "doc_id", "text", "carried.lang", "carried.source", F.char_length("text").cast("long").alias("n_chars")
    )


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest id, then the smallest hash of its text.

    Rows are judged by id and text, so rows that repeat an id stay or go each by its own text.
    """
    found = materialise(jaccard_join.rooted(docs), "components")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    first = found.where(linked).groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    kept = _matching(docs, first.union(found.where(~linked).select("doc_id", "text_key")))
    again = found.where("doc_id is not null").groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    single, repeated = kept.join(again, "doc_id", "left_anti"), kept.join(again, "doc_id", "left_semi")
    return single.select(*COLUMNS).union(repeated.dropDuplicates(["doc_id", "text"]).select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics come near their target shares."""
    return _matching(docs, mixing.mix(docs, share=MIX_SHARE).where("selected"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return bpe.digest(bpe.encode(docs, vocabulary()), vocabulary(), keep_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: SQL cannot express the language model, the encoding and the trained limits.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
