"""Personal data in whole texts: base patterns, and terms that disclose them.

*Base.* Emails, addresses, card and phone numbers, each kind leftmost and
without overlaps; a match that fails its test (parts up to 255, a Luhn sum, a
count of digits) is dropped. The patterns are the contract's, written so that
the JVM's matcher takes time in proportion to the text: loops do not give back
what they took, and a start inside a run already looked at is skipped.

*Disclosure.* Protected are each base value and the group it belongs to, which
also values seen once share: an address's domain, a number's leading block.
Candidate terms are all words of a document, without the punctuation at them
and outside base spans. From the corpus: how many documents hold the term, the
group, and both. The information that a term gives on a group, ``log p(g, t) /
(p(g) p(t))``, is set against all there is to know, ``-log p(g)``. A term that
gives a share of at least ``generalise`` is generalised wherever it stands in a
document with that group; from ``remove`` on it is removed. It must be
significant: the chance of as many common documents for a term dealt at random
(hypergeometric tail, copies of a passage are one) times the number of pairs
tested is at most ``alpha``. Documents without the group keep the term.

Only DataFrame functions are used. Results for odd input: a null text counts as
empty and has no spans; very long texts take time in proportion; rows that
repeat a ``doc_id``, or have none, are each handled; an empty table gives an
empty result; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: In the order in which spans of one start are listed.
KINDS = ["email", "ip", "card", "phone", "term"]

LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "phone": "+", "ip": "."}

SPAN = "struct<start:int,kind:int,stop:int,value:string>"
SPACES = r"[\x20\x09-\x0D]+"
#: A word has four letters or more and may have hyphens and apostrophes inside.
WORD_EDGES = (r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])")
TERM = r"\p{L}[\p{L}\p{M}'’-]{2,}\p{L}".join(WORD_EDGES)


def _small(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(999)) <= 255)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str):
    """The test that a match of the kind must pass, as a function of its span."""

    def test(span: Column) -> Column:
        value = span["value"]
        if kind == "ip":
            return F.forall(F.split(value, r"\."), _small)
        if kind == "card":
            return F.length(_digits(value)).between(14, 19) & F.call_function("luhn_check", _digits(value))
        if kind == "phone":
            return F.length(_digits(value)).between(10, 15)
        return F.lit(True)

    return test


def matches(text: Column, pattern: Column, kind: int) -> Column:
    """Spans of all matches: what lies between them and their own lengths give the places."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.char_length(pair["b"])
        stop = start + F.char_length(pair["f"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), pair["f"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, f: F.struct(b.alias("b"), f.alias("f")))
    return F.aggregate(pairs, zero, step, lambda s: s["spans"])


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and kind."""
    none = F.array().cast(f"array<{SPAN}>")
    parts = []
    for k, kind in enumerate(KINDS[:4]):
        spans = F.filter(matches(text, F.lit(PATTERNS[kind]), k), valid(kind))
        can = text.contains(NEEDED[kind]) if kind in NEEDED else F.lit(True)
        if kind != "email":
            can = can & text.rlike("[0-9]")
        parts.append(F.when(can, spans).otherwise(none))
    return F.array_sort(F.concat(*parts))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of its spans, so that all places stay."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        between = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        gap = F.repeat(F.lit(" "), F.greatest(s["stop"] - F.greatest(s["start"], state["at"]), F.lit(0)))
        return F.struct(F.greatest(s["stop"], state["at"]).alias("at"), F.concat(state["out"], between, gap).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text)))
    return F.aggregate(spans, zero, step, rest)


def terms_of(blank: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(blank, F.lit(TERM), F.lit(0)))


def protected(span: Column) -> Column:
    """Hashes of a base value and of its group: domain, first two parts of an address, leading digits."""
    kind, value = span["kind"], F.lower(span["value"])
    block = (
        F.when(kind == 0, F.substring_index(value, "@", -1)).when(kind == 1, F.substring_index(value, ".", 2))
        .when(kind == 2, F.substring(_digits(value), 1, 6)).otherwise(F.substring(_digits(value), 1, 4))
    )
    return F.array(F.xxhash64(F.lit("value"), kind, value), F.xxhash64(F.lit("block"), kind, block))


def contexts(found: DataFrame, reach: int, reach_chars: int) -> DataFrame:
    """``row, entity, context``: what a document protects, and the ``reach`` words on either side of its first place."""
    spans = found.select("row", "text", F.explode("spans").alias("s"))
    before = F.substring(F.col("text"), F.greatest(F.col("s.start") - reach_chars + 1, F.lit(1)), F.least(F.col("s.start"), F.lit(reach_chars)))
    after = F.substring(F.col("text"), F.col("s.stop") + 1, F.lit(reach_chars))
    # the outermost word of either side may be cut, and the one at the span belongs to it
    left, right = F.split(before, SPACES), F.split(after, SPACES)
    near = F.concat(
        F.slice(F.reverse(left), F.lit(2), F.lit(reach)), F.slice(right, F.lit(2), F.lit(reach))
    )
    each = spans.select("row", F.col("s.start").alias("start"), F.xxhash64(near).alias("context"), F.explode(protected(F.col("s"))).alias("entity"))
    return each.groupBy("row", "entity").agg(F.min_by("context", "start").alias("context"))


def _ln_factorial(n: Column) -> Column:
    n = n.cast("double")
    return F.when(n < 1, 0.0).otherwise((n + 0.5) * F.ln(n) - n + 0.9189385332046727 + 1 / (12 * n))


def _ln_choose(n: Column, k: Column) -> Column:
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def ln_chance(total: Column, n_e: Column, n_t: Column, n_te: Column) -> Column:
    """Upper bound of the logarithm of the hypergeometric chance of ``n_te`` or more common documents."""
    first = _ln_choose(n_e, n_te) + _ln_choose(total - n_e, n_t - n_te) - _ln_choose(total, n_t)
    ratio = (n_e - n_te) * (n_t - n_te) / ((n_te + 1) * (total - n_e - n_t + n_te + 1))
    return F.when(ratio < 1, first - F.ln(1 - ratio)).otherwise(0.0)


def disclosing(pairs: DataFrame, entities: DataFrame, counts: DataFrame, total: int, generalise: float, alpha: float) -> DataFrame:
    """``entity, term, share``: terms that significantly give at least the share ``generalise`` of an entity away."""
    joint = materialise(
        pairs.groupBy("entity", "term").agg(F.countDistinct("row").alias("n_te"), F.countDistinct("context").alias("contexts"))
        .where("contexts > 1"),
        "joint",
    )
    tested = joint.count()
    n = F.lit(float(total))
    gives = F.ln(F.col("n_te") * n / (F.col("n_t") * F.col("n_e")))
    share = F.round(gives / F.nullif(F.ln(n / F.col("n_e")), F.lit(0.0)), 9)
    # copies of a passage are one document of the term and of the entity
    chance = ln_chance(n, F.col("contexts_e"), F.col("contexts") + F.col("n_t") - F.col("n_te"), F.col("contexts"))
    return joint.join(entities, "entity").join(counts, "term").where(
        (share >= generalise) & (chance + F.ln(F.lit(float(max(tested, 1)))) <= F.ln(F.lit(alpha)))
    ).select("entity", "term", share.alias("share"))


def sanitise(
    docs: DataFrame,
    reach: int = 5,
    reach_chars: int = 160,
    alpha: float = 0.05,
    generalise: float = 0.8,
    remove: float = 0.95,
) -> DataFrame:
    """``doc_id, spans, sanitised`` of every row.

    ``spans`` are structs of ``start, kind, stop, value`` in code points;
    ``sanitised`` has base values and generalised terms replaced by their kind,
    and removed terms by nothing.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    based = texts.withColumn("spans", base_spans(F.col("text")))
    blank = blanked(F.col("text"), F.col("spans"))
    found = based.where(F.size("spans") > 0).withColumn("row", F.monotonically_increasing_id())
    found = materialise(found.withColumn("blank", blank), "found")
    near = materialise(contexts(found, reach, reach_chars), "contexts")
    total = texts.count()
    entities = near.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.countDistinct("context").alias("contexts_e"))
    # what stands in one context only cannot be significant
    entities = materialise(entities.where("contexts_e > 1"), "entities")
    words = found.select("row", F.explode(terms_of(F.col("blank"))).alias("term"))
    pairs = materialise(near.join(entities.select("entity"), "entity", "left_semi").join(words, "row"), "pairs")
    counts = based.select(F.explode(terms_of(blank)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    strong = disclosing(pairs, entities, counts, total, generalise, alpha)
    quoted = lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))
    terms = (
        pairs.join(strong, ["entity", "term"])
        .groupBy("row", "term").agg(F.max("share").alias("share"))
        # a row's own terms: no more than its words; of two that start alike the longer comes first
        .groupBy("row").agg(
            F.transform(F.sort_array(F.collect_list("term"), False), quoted).alias("quoted"),
            F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"),
        )
    )
    joined = found.join(terms, "row", "left")
    pattern = F.concat(F.lit(WORD_EDGES[0] + "(?:"), F.array_join("quoted", "|"), F.lit(")" + WORD_EDGES[1]))
    none = F.array().cast(f"array<{SPAN}>")
    added = F.when(F.col("quoted").isNotNull(), matches(F.col("blank"), pattern, 4)).otherwise(none)
    joined = joined.withColumn("spans", F.array_sort(F.concat("spans", added)))
    nothing = based.where(F.size("spans") == 0).select("doc_id", "spans", F.col("text").alias("sanitised"))
    return joined.select("doc_id", "spans", replaced(F.col("text"), F.col("spans"), F.col("shares"), remove)).union(nothing)


def replaced(text: Column, spans: Column, shares: Column, remove: float) -> Column:
    """The text with spans replaced; of overlapping spans the first is replaced and the rest goes with it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gone = (s["kind"] == 4) & (F.coalesce(F.element_at(shares, s["value"]), F.lit(0.0)) >= remove)
        between = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        mark = F.when(gone | (s["start"] < state["at"]), "").otherwise(F.get(names, s["kind"]))
        return F.struct(F.greatest(s["stop"], state["at"]).alias("at"), F.concat(state["out"], between, mark).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text)))
    return F.aggregate(spans, zero, step, rest).alias("sanitised")


def digest(result: DataFrame) -> DataFrame:
    """Counts by kind, the base spans' SHA-256, and all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return result.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
