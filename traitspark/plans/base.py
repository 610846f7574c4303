"""Shared inputs of the registered queries and their SQL counterparts.

The driver tables stand in for association results: line items are result
rows, their line number is the chromosome, parts are variant info. Every
frame here keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def sql_rnd(expr: str, digits: int = 6) -> str:
    # adding zero turns a negative zero into zero
    return f"round({expr}, {digits}) + 0.0"


# -- line items ------------------------------------------------------------

ROW_KEY_SQL = (
    "concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    "cast(floor(l_extendedprice * 100 + 0.5::double) as bigint))"
)
LABEL_SQL = "0.5::double * l_quantity - 30.0::double * l_tax + l_extendedprice / 10000.0::double"
LI_SQL = f"li as (select *, {ROW_KEY_SQL} as row_key, 'chr' || l_linenumber as Chromosome, {LABEL_SQL} as y from lineitem)"


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a unique text key, a chromosome name and a label that the columns explain."""
    cents = (F.col("l_extendedprice") * 100 + F.lit(0.5)).cast("long")  # rounded, prices are positive
    return table(spark, sf_dir, "lineitem").withColumns(
        {
            "row_key": F.concat_ws(
                ":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents.cast("string")
            ),
            "Chromosome": F.concat(F.lit("chr"), F.col("l_linenumber")),
            "y": F.lit(0.5) * F.col("l_quantity")
            - F.lit(30.0) * F.col("l_tax")
            + F.col("l_extendedprice") / F.lit(10000.0),
        }
    )


# -- orders ----------------------------------------------------------------

ORD_SQL = """od as (
  select o_orderkey, o_orderstatus, o_orderpriority,
         (o_orderkey % 89) / 10.0::double as f1,
         cast(o_custkey % 53 as double) as f2,
         o_totalprice / 100000.0::double + 0.2::double * ((o_orderkey % 89) / 10.0::double) as y,
         md5(concat_ws(':', '1010', o_orderkey)) < '4ccccccc' as is_test
  from orders)"""


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with one feature that moves the label, one that does not, and the test split."""
    from ..operators.sampling import split_rows

    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        ((F.col("o_orderkey") % 89) / F.lit(10.0)).alias("f1"),
        (F.col("o_custkey") % 53).cast("double").alias("f2"),
        (
            F.col("o_totalprice") / F.lit(100000.0)
            + F.lit(0.2) * ((F.col("o_orderkey") % 89) / F.lit(10.0))
        ).alias("y"),
    )
    return split_rows(rows, ["o_orderkey"])


# -- result and variant files ------------------------------------------------

RESULTS_SQL = f"""res as (
  select 'rs' || l_partkey as SNP, 'chr' || l_linenumber as Chromosome, {ROW_KEY_SQL} as row_key,
         l_returnflag as ALLELE, nullif(l_tax, 0) as iscores, l_quantity as "NBETA-50-0.0",
         l_extendedprice as "NSE-50-0.0", l_discount as "PV-50-0.0"
  from lineitem)"""
VARIANTS_SQL = """var as (
  select 'rs' || p_partkey as SNP, 'chr' || (p_partkey % 7 + 1) as Chromosome,
         p_partkey * 1000 as Position, p_brand as A1, p_type as A2,
         p_size / 50.0::double as "HWE-P", p_retailprice / 1000.0::double as iscore
  from part)"""
INTEGRATED_SQL = f"""{RESULTS_SQL}, {VARIANTS_SQL}, joined as (
  select Chromosome, Position, A1, A2, SNP, row_key, coalesce(iscores, iscore) as iscores,
         "NBETA-50-0.0" as Beta, "NSE-50-0.0" as SE, "HWE-P" as HWE_P, "PV-50-0.0" as p_value
  from res join var using (SNP, Chromosome))"""


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items under the column names of a result file."""
    li = line_items(spark, sf_dir)
    return li.select(
        F.concat(F.lit("rs"), F.col("l_partkey")).alias("SNP"),
        "Chromosome",
        "row_key",
        F.col("l_returnflag").alias("ALLELE"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("iscores"),
        F.col("l_quantity").alias("NBETA-50-0.0"),
        F.col("l_extendedprice").alias("NSE-50-0.0"),
        F.col("l_discount").alias("PV-50-0.0"),
    )


def variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under the column names of a variant-info file."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("rs"), F.col("p_partkey")).alias("SNP"),
        F.concat(F.lit("chr"), (F.col("p_partkey") % 7 + 1)).alias("Chromosome"),
        (F.col("p_partkey") * 1000).alias("Position"),
        F.col("p_brand").alias("A1"),
        F.col("p_type").alias("A2"),
        (F.col("p_size") / F.lit(50.0)).alias("HWE-P"),
        (F.col("p_retailprice") / F.lit(1000.0)).alias("iscore"),
    )


def integrated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined and tidied table, lazily."""
    from ..operators.clean import integrate, tidy_integrated

    joined = integrate(result_rows(spark, sf_dir), variant_rows(spark, sf_dir), salt_by=["row_key"])
    return tidy_integrated(joined)


# -- SQL pieces --------------------------------------------------------------


def sql_draws(seed: int, n: int) -> str:
    """Slope and offset of each affine draw."""
    part = "cast('0x' || substr(md5('{s}:' || i), {at}, 8) as bigint)"
    a, b = part.format(s=seed, at=1), part.format(s=seed, at=9)
    return f"draws as (select i, {a} % 2147483646 + 1 as a, {b} % 2147483647 as b from range(1, {n + 1}) t(i))"


def sql_members(source: str, key: str, seed: int, fraction: float = 0.3) -> str:
    """Rows of ``source`` once per subsample they belong to."""
    limit = int(fraction * 2147483647)
    residue = f"cast('0x' || substr(md5(concat_ws(':', '{seed}', {key})), 1, 8) as bigint) % 2147483647"
    return (
        f"members as (select s.*, d.i as sample_id from (select *, {residue} as res from {source}) s, draws d "
        f"where (s.res * d.a + d.b) % 2147483647 < {limit})"
    )


def _sql_power(x: str) -> str:
    p = "2147483647"
    return f"(((({x}) * ({x}) % {p}) * (({x}) * ({x}) % {p}) % {p}) * ({x}) % {p})"


def sql_places(source: str, group: str, key: str, seed: int, first: int, last: int, extra: str = "") -> str:
    """Fixed order (turn 0) and per-repeat order (turn repeat + 1) of the rows of each group.

    ``group`` names the columns that seed the order; ``extra`` adds columns that
    only separate the rows.
    """
    p = "2147483647"
    number = "cast('0x' || substr({md5}, {at}, 8) as bigint)"
    row = f"md5(concat_ws(':', '{seed}', {key}))"
    grp = f"md5(concat_ws(':', '{seed}:group', {group}))"
    part = f"{extra}{group}"

    def steps(name: str, src: str, turn: str, by: str) -> str:
        return f"""{name}_a as (select *, {_sql_power(f'(g + ({turn}) * 48271 + 1) % {p}')} % 2147483646 + 1 as ka,
    {_sql_power(f'(g + ({turn}) * 16807 + 2) % {p}')} as kb from {src}),
  {name}_b as (select *, (h * ka + kb) % {p} as kx from {name}_a),
  {name} as (select *, row_number() over (partition by {by} order by {_sql_power('kx')} * 4294967296 + tie) as place from {name}_b)"""

    return f"""hashed as (select *, {number.format(md5=row, at=1)} % {p} as h, {number.format(md5=row, at=9)} as tie,
    {number.format(md5=grp, at=1)} % {p} as g from {source}),
  again as (select * from hashed, range({first}, {last + 1}) t(repeat)),
  {steps('fixed', 'hashed', '0', part)},
  {steps('turned', 'again', 'repeat + 1', part + ', repeat')}"""


def sql_ols2(source: str, x1: str, x2: str, y: str, group: str = "", ridge: float = 0.0) -> str:
    """Two-feature least squares (or ridge) in closed form: columns b0, b1, b2."""
    by = f"{group}, " if group else ""
    tail = f"group by {group}" if group else ""
    return f"""select {by}my - b1 * m1 - b2 * m2 as b0, b1, b2 from (
  select *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as b1,
            (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as b2
  from (select {by}avg({x1}) as m1, avg({x2}) as m2, avg({y}) as my,
          covar_pop({x1}, {x1}) * count(*) + {ridge}::double as s11, covar_pop({x2}, {x2}) * count(*) + {ridge}::double as s22,
          covar_pop({x1}, {x2}) * count(*) as s12, covar_pop({x1}, {y}) * count(*) as s1y,
          covar_pop({x2}, {y}) * count(*) as s2y
        from {source} {tail}))"""


def sql_adjust(source: str, group: str, columns: str, p: str = "p_value") -> str:
    """Step-up adjusted p-values."""
    return f"""select {columns}, {p}, least(1.0, min(ratio) over (partition by {group} order by i desc
    rows between unbounded preceding and current row)) as p_adjusted from (
  select *, {p} * count(*) over (partition by {group}) / i as ratio from (
    select *, row_number() over (partition by {group} order by {p}) as i from {source}))"""
