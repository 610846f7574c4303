"""Removal of lines that an earlier line has, up to one edited word: deletion-neighbourhood join.

A line is a run between ``\\n``; it is compared by its words (runs of other than
0x20 and 0x09-0x0D). A line with at least ``least_words`` words goes when an
earlier line, by (``doc_id``, place), has the same words; with at least
``near_words`` words it also goes when an earlier line of at least that many is
within the edit bound: one word replaced, put in or left out. Earlier lines
count whether they stay or not.

Every line emits the variants with one word left out, as hashed keys: with the
gap's place, for lines of one length (equal keys: one word replaced), and
without it, which equal the key of a whole line one word shorter. Equal keys
meet by aggregation: each line is only paired with the earliest of its key, so
no group emits its pairs. The pair's edit distance is then verified on the words.

Before that, lines that cannot have a partner are dropped exactly: with one
edited word, the first or the last half of the shorter line's words is in both.

Only DataFrame functions are used. Results for odd input: a null text stays null
and has no lines; an empty text is one line without words and stays; a row
without ``doc_id`` keeps all lines and removes none; rows that repeat ``doc_id``
are ordered by a hash of their text, and those that repeat both are treated
alike, each as if it were the only one; an empty table gives an empty result;
other columns are dropped but for those to carry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .filters import filter_words, possibly

#: Gaps between words other than the space.
ODD_GAP = r"[\t\x0B\f\r]"


def spaced(text: Column) -> Column:
    """Words of a line apart by spaces only; most texts have no other gaps and stay as they are."""
    return F.when(text.rlike(ODD_GAP), F.regexp_replace(text, ODD_GAP, " ")).otherwise(text)


def words_of(line: Column) -> Column:
    # one plain character: no pattern is compiled for each line
    return F.filter(F.split(line, " "), lambda w: w != "")


def _lines(docs: DataFrame) -> DataFrame:
    texts = docs.where("doc_id is not null and text is not null")
    return texts.select("doc_id", "text_key", F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("place", "line")).select(
        "doc_id", "text_key", "place", words_of(F.col("line")).alias("words")
    )


def _keyed(docs: DataFrame, least_words: int) -> DataFrame:
    return _lines(docs).withColumn("n", F.size("words")).where(F.col("n") >= least_words).select(
        "*", F.xxhash64(F.lit(1), "words").alias("h1"), F.xxhash64(F.lit(2), "words").alias("h2")
    )


def _halves(words: Column, n: Column) -> Column:
    """Hashes of the first and last halves, for a partner as long and for one a word longer."""
    short, long = F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")
    front = [F.xxhash64(F.lit(0), h, F.slice(words, F.lit(1), h)) for h in (short, long)]
    back = [F.xxhash64(F.lit(1), h, F.slice(words, n - h + 1, h)) for h in (short, long)]
    return F.array_distinct(F.array(*front, *back))


def hashed_lines(docs: DataFrame, least_words: int, near_words: int) -> DataFrame:
    """``h1, h2, n, halves, at`` of every line: its hashes and where it is, without its words."""
    return _keyed(docs, least_words).select(
        "h1", "h2", "n",
        F.when(F.col("n") >= near_words, _halves(F.col("words"), F.col("n"))).alias("halves"),
        F.struct("doc_id", "text_key", "place").alias("at"),
    )


def different_lines(rows: DataFrame) -> DataFrame:
    """``h1, h2, n, halves, first``: each different line and where it is found first."""
    # equal lines have equal halves
    return rows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.first("n").alias("n"), F.first("halves").alias("halves"))


def possible(lines: DataFrame) -> DataFrame:
    """Lines that share a half with a different line."""
    halves = lines.where("halves is not null").select("h1", "first", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("half")
    return halves.join(shared, "half", "left_semi").select("first").distinct()


def variants(lines: DataFrame) -> DataFrame:
    """``key, whole, first`` of each line (``first, words``): itself and all with one word left out.

    Hashes of (word, place) are combined by exclusive or, so leaving out a word
    costs the same for lines of any length.
    """
    words = lines.select("first", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    here, before = F.xxhash64("word", "i"), F.xxhash64("word", F.col("i") - 1)
    line = Window.partitionBy("first")
    past = line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    every = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = lambda a, b: a.bitwiseXOR(b)
    zero = F.lit(0).cast("long")
    parts = words.select("first", "n", "i", here.alias("here"), before.alias("before")).select(
        "first", "n", "i", "here",
        F.coalesce(F.bit_xor("here").over(past), zero).alias("front"),
        F.bit_xor("here").over(every).alias("all"),
        x(F.bit_xor("before").over(every), F.bit_xor("before").over(upto)).alias("back"),
    )
    replaced = F.struct(F.xxhash64(F.lit("r"), "n", "i", x(F.col("all"), F.col("here"))).alias("key"), F.lit(None).cast("boolean").alias("whole"))
    removed = F.struct(F.xxhash64(F.lit("d"), F.col("n") - 1, x(F.col("front"), F.col("back"))).alias("key"), F.lit(False).alias("whole"))
    whole = F.struct(F.xxhash64(F.lit("d"), "n", "all").alias("key"), F.lit(True).alias("whole"))
    rows = F.when(F.col("i") == 0, F.array(replaced, removed, whole)).otherwise(F.array(replaced, removed))
    return parts.select("first", F.explode(rows).alias("v")).select("v.key", "v.whole", "first")


def earlier_partners(keys: DataFrame) -> DataFrame:
    """``first, partner``: for each line, the earliest line that shares a key and is before it."""
    least = lambda condition: F.min(F.when(condition, F.col("first")))
    best = keys.groupBy("key").agg(
        least(F.col("whole").isNull()).alias("same"), least(F.col("whole")).alias("short"), least(~F.col("whole")).alias("long")
    )
    partner = F.when(F.col("whole").isNull(), F.col("same")).when(F.col("whole"), F.col("long")).otherwise(F.col("short"))
    return keys.join(best, "key").select("first", partner.alias("partner")).where("partner < first").groupBy("first").agg(
        F.min("partner").alias("partner")
    )


def within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are equal up to one word replaced, put in or left out."""
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    unlike = F.zip_with(a, b, lambda p, q: (~p.eqNullSafe(q)).cast("int"))
    at = F.array_position(F.zip_with(long, short, lambda p, q: ~p.eqNullSafe(q)), True).cast("int")
    gap = F.concat(F.slice(long, F.lit(1), at - 1), F.slice(long, at + 1, F.size(long)))
    return F.when(
        F.size(a) == F.size(b), F.aggregate(unlike, F.lit(0), lambda s, u: s + u) <= 1
    ).otherwise((F.abs(F.size(a) - F.size(b)) == 1) & (gap == short))


def _without(lines: Column, bounds: Column) -> Column:
    """The lines but those at ``bounds``: -1, the sorted places that go, and the number of lines."""
    runs = F.transform(
        F.sequence(F.lit(1), F.size(bounds) - 1),
        lambda k: F.slice(lines, F.get(bounds, k - 1) + 2, F.get(bounds, k) - F.get(bounds, k - 1) - 1),
    )
    return F.array_join(F.flatten(runs), "\n")


def remove_lines(docs: DataFrame, least_words: int = 2, near_words: int = 8, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, text, n_lines, n_exact, n_near`` of every row: the text left and how many lines went why.

    ``carried`` is a struct of the columns named in ``carry``, or null.
    """
    carried = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None).cast("string")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"), carried.alias("carried")
    )
    rows = materialise(hashed_lines(texts, least_words, near_words), "line-hashes")  # two readers
    lines = materialise(different_lines(rows), "lines")
    maybe = possible(lines)
    copies = (
        rows.select("h1", "h2", "at")
        .join(lines.select("h1", "h2", "first"), ["h1", "h2"]).where("at <> first")
    )
    flags = copies.select("at.*", F.lit(True).alias("copy")).union(maybe.select("first.*", F.lit(False)))
    places = lambda copy: F.sort_array(F.collect_set(F.when(F.col("copy") == copy, F.col("place"))))
    # places only; the texts that have some are joined with them once to get the open lines and once at the end
    marked = materialise(
        flags.groupBy("doc_id", "text_key").agg(places(True).alias("exact"), places(False).alias("open")), "flags"
    )
    text = ["doc_id", "text_key"]
    key = F.xxhash64(*text)
    some_open = marked.where(F.size("open") > 0).select(*text, "open")
    opened = possibly(texts.select(*text, "text"), filter_words(some_open.select(key.alias("key")), "key"), key).join(some_open, text)
    words = materialise(
        opened.select(*text, F.split(spaced(F.col("text")), "\n").alias("lines"), F.explode("open").alias("place")).select(
            F.struct(*text, "place").alias("first"), words_of(F.get("lines", F.col("place"))).alias("words")
        ).dropDuplicates(["first"]),
        "open-lines",
    )
    pairs = earlier_partners(variants(words))
    near = (
        pairs.join(words, "first")
        .join(words.select(F.col("first").alias("partner"), F.col("words").alias("other")), "partner")
        .where(within_one(F.col("words"), F.col("other")))
        .select("first.*").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("place")).alias("near"))
    )
    none = F.array().cast("array<int>")
    gone = materialise(
        marked.select(*text, "exact").join(near, text, "left").where((F.size("exact") > 0) | F.col("near").isNotNull()), "gone"
    )
    held = filter_words(gone.select(key.alias("key")), "key")
    # texts that lose no line are not shuffled; lines and bounds are columns of their own, so that they are made once a text
    ready = (
        possibly(texts, held, key).join(gone, text, "left")
        .withColumns({"exact": F.coalesce("exact", none), "near": F.coalesce("near", none), "lines": F.split("text", "\n")})
        .withColumn("bounds", F.concat(F.array(F.lit(-1)), F.sort_array(F.concat("exact", "near")), F.array(F.size("lines"))))
    )
    cut = ready.select(
        "doc_id",
        F.when(F.size("bounds") > 2, _without(F.col("lines"), F.col("bounds"))).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.size("exact").cast("long").alias("n_exact"),
        F.size("near").cast("long").alias("n_near"),
        "carried",
    )
    zero = F.lit(0).cast("long")
    whole = possibly(texts, held, key, False).select(
        "doc_id", "text", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        zero.alias("n_exact"), zero.alias("n_near"), "carried",
    )
    return whole.union(cut)


SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place,
         unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, place, line, list_filter(regexp_split_to_array(line, '[ \t\v\f\r]+'), lambda x: x <> '') AS ws FROM l
), d AS (
  SELECT ws, len(ws) AS n, min((doc_id, place)) AS first FROM w WHERE len(ws) >= 2 GROUP BY ws
), v AS (
  SELECT first, n, i, list_concat(ws[1:i-1], ws[i+1:]) AS rest
  FROM d, unnest(range(1, n + 1)) AS t(i) WHERE n >= 8
), s AS (
  SELECT n, i, rest, min(first) AS low FROM v GROUP BY n, i, rest
), p AS (
  SELECT v.first AS long, d.first AS short FROM v JOIN d ON d.ws = v.rest AND d.n >= 8
), near AS (
  SELECT v.first FROM v JOIN s USING (n, i, rest) WHERE s.low < v.first
  UNION SELECT long FROM p WHERE short < long
  UNION SELECT short FROM p WHERE long < short
), f AS (
  SELECT w.doc_id, w.place, w.line,
         d.first IS NOT NULL AND d.first <> (w.doc_id, w.place) AS copy,
         d.first = (w.doc_id, w.place) AND d.first IN (SELECT first FROM near) AS close
  FROM w LEFT JOIN d ON d.ws = w.ws
), g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE copy) AS n_exact,
         count(*) FILTER (WHERE coalesce(close, false)) AS n_near,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT copy AND NOT coalesce(close, false)), '') AS kept
  FROM f GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
       sha256(kept) AS kept_sha256
FROM documents t LEFT JOIN g ON g.doc_id = t.doc_id
"""
