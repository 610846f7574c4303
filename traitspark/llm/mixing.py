"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents are counted in tokens (words) by cell: source, language and topic. A
document's topic is one of ``topics`` lists into which words are hashed, the one
that most of its different words of ``TOPIC_CHARS`` characters or more belong
to. A margin's target share is its share of tokens to the power of its
``temper``, scaled to one: 1 keeps a margin, 0 makes it even.

A margin cannot have more than its tokens: where the sample's share of a value's
target is more than there is, the value's target is all of it, and the rest of the
margin is spread over the other values in proportion.

Fitting scales the cells' weights so that one margin after the other meets its
targets, by aggregation and join of the table of cells, a round in one job; no cell's weight goes above
its tokens (its probability is then 1), and what it cannot take is raked to the open
cells in the next step, until no weight changes or for ``rounds`` rounds. A document's
probability is its cell's weight over its tokens. It is drawn by a hash of its id and
text: the same for every run and partitioning, and independent of the others.

Results for odd input: a null source or language is a value of its own; a null
or empty text has no tokens, topic -1, weight 0 and probability 0; rows that
repeat a ``doc_id`` and text are drawn alike; an empty table gives an empty
result; a text of any length counts whole; only named columns are read, so
clashing ones do not matter. Margins whose cells cannot meet all targets (a source in one language
only) settle between them; :func:`residuals` gives what is left.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.hashing import hex_int, salted_md5
from ..session import materialise

MARGINS = ("source", "lang", "topic")
TOPICS = 8
TOPIC_CHARS = 6
#: Exponents of the margins' token shares.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.0}
SHARE = 0.5
ROUNDS = 20
#: Largest change of a weight in a round at which raking stops.
SETTLED = 1e-9


def topic_of(words: list[str], topics: int, known: dict[str, int]) -> int:
    """The list with most of the different long words; ties to the smaller number; without such words 0."""
    counts = [0] * topics
    for w in set(words):
        if len(w) >= TOPIC_CHARS:
            t = known.get(w)
            if t is None:
                if len(known) > 1 << 18:
                    known.clear()
                t = known[w] = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % topics
            counts[t] += 1
    return counts.index(max(counts)) if words else -1


def measured(docs: DataFrame, topics: int) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, draw, text_key`` of every row; texts go no further."""

    def emit(batches):
        known: dict[str, int] = {}
        for batch in batches:
            topic, tokens = [], []
            for text in batch.column(5).to_pylist():
                words = [w.decode() for w in (text or "").encode().split()]
                tokens.append(len(words))
                topic.append(topic_of(words, topics, known))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(topic, pa.int32()), pa.array(tokens, pa.int64())],
                ["doc_id", "source", "lang", "draw", "text_key", "topic", "tokens"],
            )

    draw = hex_int(salted_md5("mix", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", draw.alias("draw"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(emit, "doc_id long, source string, lang string, draw long, text_key long, topic int, tokens long")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & a[k].eqNullSafe(b[f"{k}_of"])
    return condition


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_of") if c in keys else F.col(c) for c in df.columns])


def targets(cells: DataFrame, margin: str, temper: float, whole: float, share: float) -> DataFrame:
    """``target`` share of each value of a margin in the sample, no more than the value has."""
    raw = cells.groupBy(margin).agg(
        F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("raw"), (F.sum("tokens") / F.lit(share * whole)).alias("most")
    )
    sums = raw.agg(F.sum("raw").alias("sums"))
    wanted = materialise(raw.crossJoin(F.broadcast(sums)).select(margin, "most", (F.col("raw") / F.col("sums")).alias("target")), "targets")  # one row
    factor, full = 0.0, -1
    while True:  # the factor only grows, and is right when no more values are full
        fills = F.lit(factor) * F.col("target") >= F.col("most")
        row = wanted.agg(
            F.coalesce(F.sum(F.when(fills, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~fills, F.col("target"))), F.lit(0.0)),
            F.count(F.when(fills, 1)),
        ).first()
        if row[2] == full or not row[1]:
            break
        full, factor = row[2], (1 - row[0]) / row[1]
    return wanted.select(margin, F.least("most", F.lit(factor) * F.col("target")).alias("target"))


def rake(cells: DataFrame, temper: dict[str, float], rounds: int, share: float) -> DataFrame:
    """``cells`` with ``weight``: shares of the sample's tokens that meet the margins' targets, at most ``most``."""
    whole = float(cells.agg(F.sum("tokens")).first()[0])
    most = (F.col("tokens") / F.lit(share * whole)).alias("most")
    start = cells.select(*MARGINS, "tokens", most, F.least(F.col("tokens") / F.lit(whole), most).alias("weight"))
    for margin, t in temper.items():
        want = _renamed(targets(cells, margin, t, whole, share), [margin]).withColumnRenamed("target", f"{margin}_target")
        start = start.join(want, _same(start, want, [margin])).drop(f"{margin}_of")
    cells = materialise(start, "cells")
    for _ in range(rounds):  # one job a round: the driver plans few, and keeps few
        fitted = cells.withColumn("was", F.col("weight"))
        for margin in temper:
            now = _renamed(fitted.groupBy(margin).agg(F.sum("weight").alias("now")), [margin])
            weight = F.least("most", F.col("weight") * (F.col(f"{margin}_target") / F.col("now"))).alias("weight")
            fitted = fitted.join(now, _same(fitted, now, [margin])).select(*[c for c in fitted.columns if c != "weight"], weight)
        change = Observation()
        fitted = fitted.observe(change, F.max(F.abs(F.col("weight") / F.col("was") - 1)).alias("most"))
        cells = materialise(fitted.drop("was"), "cells")
        if change.get["most"] < SETTLED:
            break
    return cells.select(*MARGINS, "tokens", "most", "weight")


def residuals(cells: DataFrame, temper: dict[str, float], rounds: int = ROUNDS, share: float = SHARE) -> dict[str, float]:
    """Of each margin, the largest relative difference of an expected share from its target."""
    fitted = rake(cells, temper, rounds, share)
    whole = float(cells.agg(F.sum("tokens")).first()[0])
    out = {}
    for margin, t in temper.items():
        want = _renamed(targets(cells, margin, t, whole, share), [margin])
        now = fitted.groupBy(margin).agg(F.sum("weight").alias("now"))
        gap = now.join(want, _same(now, want, [margin])).agg(F.max(F.abs(F.col("now") / F.col("target") - 1)))
        out[margin] = gap.first()[0]
    return out


def mix(
    docs: DataFrame, temper: dict[str, float] | None = None, share: float = SHARE, rounds: int = ROUNDS, topics: int = TOPICS
) -> DataFrame:
    """``doc_id, text_key, source, lang, topic, n_tokens, weight, probability, selected`` of every row.

    ``weight`` is the calibrated token weight: the cell's target share over its share of tokens.
    """
    rows = materialise(measured(docs, topics), "measured")
    cells = materialise(rows.where("tokens > 0").groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    if cells.isEmpty():
        fitted = cells.withColumns({"weight": F.lit(0.0), "most": F.lit(1.0)})
    else:
        fitted = rake(cells, temper or TEMPER, rounds, share)
    total = fitted.agg(F.sum("tokens").cast("double").alias("whole"))
    known = fitted.crossJoin(F.broadcast(total)).select(  # one row
        *[F.col(m).alias(f"{m}_of") for m in MARGINS],
        F.round(F.col("weight") * F.col("whole") / F.col("tokens"), 6).alias("weight"),
        F.round(F.least(F.lit(1.0), F.col("weight") / F.col("most")), 6).alias("probability"),
    )
    joined = rows.join(known, _same(rows, known, list(MARGINS)), "left")
    has = F.col("tokens") > 0
    p = F.when(has, F.coalesce("probability", F.lit(0.0))).otherwise(F.lit(0.0))
    return joined.select(
        "doc_id", "text_key", "source", "lang", "topic", F.col("tokens").alias("n_tokens"),
        F.when(has, F.coalesce("weight", F.lit(0.0))).otherwise(F.lit(0.0)).alias("weight"), p.alias("probability"),
        (F.col("draw") / F.lit(4294967296.0) < p).alias("selected"),
    )


def sql(temper: dict[str, float] = TEMPER, share: float = SHARE, rounds: int = ROUNDS, topics: int = TOPICS) -> str:
    """The same in SQL."""
    parts = [f"""
w AS (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, unnest(list_distinct(ws)) AS x FROM w),
v AS (SELECT doc_id, ('0x' || substr(md5(x), 1, 4))::INT % {topics} AS t, count(*) AS k FROM u WHERE length(x) >= {TOPIC_CHARS} GROUP BY ALL),
o AS (SELECT doc_id, arg_min(t, (-k, t)) AS topic FROM v GROUP BY doc_id),
r AS MATERIALIZED (
  SELECT w.doc_id, source, lang, CASE WHEN len(ws) = 0 THEN -1 ELSE coalesce(topic, 0) END AS topic, len(ws) AS tokens,
         ('0x' || substr(md5('mix:' || coalesce(w.doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT AS draw
  FROM w LEFT JOIN o ON o.doc_id = w.doc_id),
n AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM r WHERE tokens > 0 GROUP BY ALL),
h AS MATERIALIZED (SELECT sum(tokens)::DOUBLE AS whole FROM n),
c0 AS MATERIALIZED (SELECT n.*, tokens / ({share} * whole) AS most, least(tokens / whole, tokens / ({share} * whole)) AS weight FROM n, h)"""]
    for m, t in temper.items():
        parts.append(f"""a_{m} AS MATERIALIZED (SELECT {m}, pow(sum(tokens)::DOUBLE, {t}) / sum(pow(sum(tokens)::DOUBLE, {t})) OVER () AS target,
  sum(tokens) / ({share} * (SELECT whole FROM h)) AS most FROM n GROUP BY {m}),
b_{m} AS (SELECT *, sum(most) OVER q AS above, sum(target) OVER () - sum(target) OVER q AS rest, lead(most / target) OVER (ORDER BY most / target, {m}) AS following
  FROM a_{m} WINDOW q AS (ORDER BY most / target, {m})),
l_{m} AS (SELECT max(f) AS f FROM (
  SELECT (1 - above) / rest AS f FROM b_{m} WHERE rest > 1e-9 AND (1 - above) / rest >= most / target AND (1 - above) / rest < following
  UNION ALL SELECT 1.0 FROM b_{m} HAVING min(most / target) > 1)),
t_{m} AS MATERIALIZED (SELECT {m}, least(most, target * (SELECT f FROM l_{m})) AS target FROM a_{m})""")
    k = 0
    for _ in range(rounds):
        for m in temper:
            parts.append(
                f"c{k + 1} AS MATERIALIZED (SELECT c.* REPLACE (least(most, weight * target / sum(weight) OVER (PARTITION BY c.{m})) AS weight)"
                f" FROM c{k} c JOIN t_{m} t ON t.{m} IS NOT DISTINCT FROM c.{m})"
            )
            k += 1
    parts.append(f"""
p AS (SELECT source, lang, topic, round(weight * (SELECT whole FROM h) / tokens, 6) AS weight,
             round(least(1.0::DOUBLE, weight / most), 6) AS probability FROM c{k})""")
    return "WITH " + ",\n".join(x.strip() for x in parts) + """
SELECT r.doc_id, r.source, r.lang, r.topic, r.tokens AS n_tokens, coalesce(p.weight, 0) AS weight,
       coalesce(probability, 0) AS probability, draw / 4294967296.0 < coalesce(probability, 0) AS selected
FROM r LEFT JOIN p ON r.tokens > 0 AND p.source IS NOT DISTINCT FROM r.source AND p.lang IS NOT DISTINCT FROM r.lang AND p.topic = r.topic
"""
