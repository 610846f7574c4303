"""Queries: sources, cleaning, joins, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import annotate, clean, sampling
from ..session import materialise, scratch_path
from ..sources import models as store
from ..sources import tables as src
from . import base as B
from .base import rnd, sql_rnd
from .registry import query

# -- sources -----------------------------------------------------------------


@query(
    "ingest_join",
    f"with {B.INTEGRATED_SQL} select * from joined",
)
def ingest_join(spark, sf):
    return B.integrated_rows(spark, sf)


def _chromosome_files(spark, rows, prefix):
    """Rows as gzipped files named after their chromosome, several per chromosome where tasks wrote several."""
    written, named = scratch_path(spark, "written"), scratch_path(spark, "named")
    rows.write.partitionBy("Chromosome").options(header=True, sep=" ", compression="gzip").csv(written)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path
    files = place(written).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place(named))
    for folder in files.listStatus(place(written)):
        value = folder.getPath().getName().partition("=")[2]
        if value:
            for i, part in enumerate(files.listStatus(folder.getPath())):
                files.rename(part.getPath(), place(f"{named}/{prefix}.{i}.{value}.csv.gz"))
    return named


@query(
    "read_results_scan",
    """select 'rs' || l_partkey as SNP, l_returnflag as ALLELE, l_quantity as iscores, l_extendedprice as beta,
       l_tax as se, l_discount as pv, l_linestatus as extra, 'chr' || l_linenumber as Chromosome from lineitem""",
)
def read_results_scan(spark, sf):
    """Result files of each chromosome, with their columns in another order and one more."""
    li = B.table(spark, sf, "lineitem")
    rows = li.select(
        F.col("l_linestatus").alias("extra"), F.col("l_discount").alias("PV-50-0.0"), F.concat(F.lit("rs"), "l_partkey").alias("SNP"),
        F.col("l_tax").alias("NSE-50-0.0"), F.col("l_extendedprice").alias("NBETA-50-0.0"), F.col("l_quantity").alias("iscores"),
        F.col("l_returnflag").alias("ALLELE"), F.concat(F.lit("chr"), "l_linenumber").alias("Chromosome"),
    )
    got = src.read_results(spark, _chromosome_files(spark, rows, "imputed.allWhites"))
    return got.withColumnsRenamed({"NBETA-50-0.0": "beta", "NSE-50-0.0": "se", "PV-50-0.0": "pv"})


@query(
    "read_variants_scan",
    """select 'rs' || p_partkey as SNP, p_partkey * 10 as Position, p_brand as A1, p_type as A2, p_retailprice as hwe,
       p_size::double as iscore, 'chr' || (p_partkey % 7 + 1) as Chromosome from part""",
)
def read_variants_scan(spark, sf):
    """Variant files of each chromosome, with the alleles in the other order."""
    part = B.table(spark, sf, "part")
    rows = part.select(
        F.concat(F.lit("rs"), "p_partkey").alias("SNP"), (F.col("p_partkey") * 10).alias("Position"), F.col("p_type").alias("A2"),
        F.col("p_brand").alias("A1"), F.col("p_retailprice").alias("HWE-P"), F.col("p_size").cast("double").alias("iscore"),
        F.concat(F.lit("chr"), F.col("p_partkey") % 7 + 1).alias("Chromosome"),
    )
    return src.read_variants(spark, _chromosome_files(spark, rows, "snps.imputed")).withColumnRenamed("HWE-P", "hwe")


@query(
    "association_summary",
    f"""with {B.INTEGRATED_SQL},
    floor_p as (select min(p_value) / 2 as low from joined where p_value <> 0),
    stats as (select avg(Beta) as mb, stddev_pop(Beta) as sb, avg(SE) as ms, stddev_pop(SE) as ss from joined)
    select Chromosome, count(*) as n_variants,
      {sql_rnd('avg(-log10(case when p_value = 0 then low else p_value end))')} as mean_log_p,
      {sql_rnd('max(-log10(case when p_value = 0 then low else p_value end))')} as max_log_p,
      {sql_rnd('avg((Beta - mb) / sb)')} as mean_beta, {sql_rnd('avg((SE - ms) / ss)')} as mean_se,
      {sql_rnd('avg(iscores)')} as mean_score
    from joined, floor_p, stats group by Chromosome""",
)
def association_summary(spark, sf):
    """Flagship: join, clean, floor, scale, transform and summarise per chromosome."""
    from ..operators.features import scale_numeric

    # written once: the floor, the scaling and the summary each scan it
    joined = materialise(
        B.integrated_rows(spark, sf).select("Chromosome", "Beta", "SE", "iscores", "p_value"), "integrated"
    )
    scaled = scale_numeric(clean.zero_floor(joined), ["Beta", "SE"])
    log_p = S.neg_log10("p_value")
    return scaled.groupBy("Chromosome").agg(
        F.count(F.lit(1)).alias("n_variants"),
        rnd(F.avg(log_p)).alias("mean_log_p"),
        rnd(F.max(log_p)).alias("max_log_p"),
        rnd(F.avg("Beta")).alias("mean_beta"),
        rnd(F.avg("SE")).alias("mean_se"),
        rnd(F.avg("iscores")).alias("mean_score"),
    )


@query(
    "chrom_from_path",
    """with f as (select case when l_linenumber = 7 then 'imputed.allWhites.50-0.0.chrX.csv.gz'
        else 'imputed.allWhites.50-0.0.chr' || l_linenumber || '.csv.gz' end as path from lineitem)
    select path, 'chr' || regexp_extract(path, '\\.chr(\\d+)\\.csv', 1) as Chromosome, count(*) as n_rows
    from f where regexp_extract(path, '\\.chr(\\d+)\\.csv', 1) <> '' group by 1, 2""",
)
def chrom_from_path(spark, sf):
    path = F.when(F.col("l_linenumber") == 7, F.lit("imputed.allWhites.50-0.0.chrX.csv.gz")).otherwise(
        F.concat(F.lit("imputed.allWhites.50-0.0.chr"), F.col("l_linenumber"), F.lit(".csv.gz"))
    )
    rows = B.table(spark, sf, "lineitem").select(path.alias("path"))
    return (
        rows.withColumn("Chromosome", src.chromosome_of("path"))
        .where(F.col("Chromosome").isNotNull())
        .groupBy("path", "Chromosome")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


@query(
    "max_files_cap",
    f"""with {B.RESULTS_SQL}, {B.VARIANTS_SQL},
    kept as (select distinct Chromosome from res order by Chromosome
             limit (select least(3, count(distinct Chromosome)) from var))
    select Chromosome, count(*) as n_rows, {sql_rnd('sum("NBETA-50-0.0")')} as total_beta
    from res where Chromosome in (select Chromosome from kept) group by Chromosome""",
)
def max_files_cap(spark, sf):
    kept = clean.keep_first_chromosomes(B.result_rows(spark, sf), B.variant_rows(spark, sf), 3)
    return kept.groupBy("Chromosome").agg(
        F.count(F.lit(1)).alias("n_rows"), rnd(F.sum(F.col("`NBETA-50-0.0`"))).alias("total_beta")
    )


@query("tsv_csv_roundtrip", "select p_partkey, p_brand, p_type, p_size, p_retailprice from part")
def tsv_csv_roundtrip(spark, sf):
    schema = "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double"
    part = B.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    tsv, csv = scratch_path(spark, "tsv"), scratch_path(spark, "csv")
    src.write_csv(part, tsv, "\t")
    src.write_csv(src.read_tsv(spark, tsv, schema), csv)
    return src.read_integrated(spark, csv, schema)


@query("name_list_roundtrip", "select distinct p_name as name from part")
def name_list_roundtrip(spark, sf):
    path = scratch_path(spark, "names")
    src.write_name_list(B.table(spark, sf, "part").select(F.col("p_name").alias("SNP")).distinct(), path)
    return spark.read.schema("name string").csv(path)


@query(
    "annotation_scan",
    """select p_partkey, nullif(p_type, 'ECONOMY') as p_type, nullif(p_brand, 'Brand#2') as p_brand from part""",
)
def annotation_scan(spark, sf):
    """Annotation file with a missing token, written and read back in each text column."""
    path = scratch_path(spark, "anno")
    part = B.table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    src.write_csv(
        part.replace("ECONOMY", ".", ["p_type"]).replace("Brand#2", ".", ["p_brand"]), path
    )
    return src.read_annotation(spark, path, "p_partkey long, p_type string, p_brand string", ".")


@query(
    "null_tokens",
    """select p_partkey, nullif(p_type, 'ECONOMY') as p_type,
       case when p_brand in ('Brand#1', 'Brand#2') then null else p_brand end as p_brand,
       case when p_size between 1 and 22 then p_size end as p_size from part""",
)
def null_tokens(spark, sf):
    part = B.table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    coded = src.recode_missing(part, ["ECONOMY", "Brand#1", "Brand#2"])
    return coded.withColumn("p_size", S.within_domain("p_size", 1, 22))


@query(
    "paired_samples",
    f"""with k as (select o_orderkey from orders order by md5(concat_ws(':', '1', o_orderkey)) limit 500),
    st as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders)
    select o_orderkey, 'merged' as frame, {sql_rnd('o_totalprice')} as value from orders where o_orderkey in (select * from k)
    union all
    select o_orderkey, 'processed', {sql_rnd('(o_totalprice - m) / s')} from orders, st where o_orderkey in (select * from k)""",
)
def paired_samples(spark, sf):
    from ..operators.features import scale_numeric

    merged = B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    processed = scale_numeric(merged, ["o_totalprice"])
    a, b = sampling.paired_samples([merged, processed], ["o_orderkey"], 500, seed=1)
    tagged = [
        f.select("o_orderkey", F.lit(t).alias("frame"), rnd("o_totalprice").alias("value"))
        for f, t in ((a, "merged"), (b, "processed"))
    ]
    return clean.append_frames(*tagged)


@query(
    "model_roundtrip",
    f"""with {B.LI_SQL}, o as ({B.sql_ols2('li', 'l_quantity', 'l_tax', 'y')}),
    r as ({B.sql_ols2('li', 'l_quantity', 'l_tax', 'y', ridge=1000.0)})
    select 'Linear Regression' as model, 'l_quantity' as feature, {sql_rnd('b1')} as coef, 'fitted' as state from o
    union all select 'Linear Regression', 'l_tax', {sql_rnd('b2')}, 'fitted' from o
    union all select 'Ridge', 'l_quantity', {sql_rnd('b1')}, 'fitted' from r
    union all select 'Ridge', 'l_tax', {sql_rnd('b2')}, 'fitted' from r
    union all select 'Ridge', 'l_quantity', {sql_rnd('b1')}, 'reset' from r
    union all select 'Ridge', 'l_tax', {sql_rnd('b2')}, 'reset' from r""",
)
def model_roundtrip(spark, sf):
    """Save, load, and refit from the untrained form."""
    from ..operators.linear import coef_table, fit_linear

    li = B.line_items(spark, sf).select("l_quantity", "l_tax", "y")
    features = ["l_quantity", "l_tax"]
    root = scratch_path(spark, "models")
    store.save_models(
        spark,
        root,
        [
            fit_linear(li, features, "y", "ols", name="Linear Regression"),
            fit_linear(li, features, "y", "ridge", {"alpha": 1000.0}, name="Ridge"),
        ],
    )
    fitted = store.load_models(spark, root)
    again = store.load_models(spark, root, fitted=False)["Ridge"].fit(li, features, "y")
    rows = coef_table(spark, list(fitted.values())).withColumn("state", F.lit("fitted"))
    rows = rows.union(coef_table(spark, [again]).withColumn("state", F.lit("reset")))
    return rows.withColumn("coef", rnd("coef"))


_MODEL_OF_LINE = "[" + ", ".join(f"'{n}'" for n in store.MODEL_NAMES) + "][l_linenumber]"


def _model_rates(spark, sf):
    """Mean discount per registered model (one per line number) and return flag."""
    names = F.array(*[F.lit(n) for n in store.MODEL_NAMES])
    return (
        B.table(spark, sf, "lineitem")
        .select(
            F.element_at(names, F.col("l_linenumber")).alias("model"),
            F.col("l_returnflag").alias("feature"),
            "l_discount",
        )
        .groupBy("model", "feature")
        .agg(rnd(F.avg("l_discount"), 9).alias("p_value"))
    )


_RATES_SQL = f"""rates as (select {_MODEL_OF_LINE} as model, l_returnflag as feature,
    {sql_rnd('avg(l_discount)', 9)} as p_value from lineitem group by 1, 2)"""


@query(
    "results_by_model",
    f"""with {_RATES_SQL} select model, feature, p_value, cast(list_position({list(store.MODEL_NAMES)}, model) - 1 as int) as model_order
    from rates where model in {tuple(store.MODEL_NAMES[:5])}""",
)
def results_by_model(spark, sf):
    """One dataset partitioned by model, read in registry order up to the first gap."""
    path = scratch_path(spark, "results")
    src.write_results(_model_rates(spark, sf).where("model <> 'Random Forest'"), path)
    done = src.complete_prefix(src.collect_results(spark, path), store.MODEL_NAMES)
    return done.select("model", "feature", "p_value", "model_order")


@query(
    "results_missing",
    "select 'Random Forest' as model",
)
def results_missing(spark, sf):
    """Registered models that have no result yet."""
    done = _model_rates(spark, sf).where("model <> 'Random Forest'")
    return src.missing_models(done, store.MODEL_NAMES)


_PIVOT_COLUMNS = ", ".join(
    f"max(case when model = '{n}' then p_value end) as \"{n}\"" for n in store.MODEL_NAMES
)


@query("results_pivot", f"with {_RATES_SQL} select feature, {_PIVOT_COLUMNS} from rates group by feature")
def results_pivot(spark, sf):
    return src.results_matrix(_model_rates(spark, sf), store.MODEL_NAMES)


@query(
    "results_aligned",
    f"""with {_RATES_SQL}, a as (select feature, p_value as lasso from rates where model = 'Lasso' and feature <> 'A'),
    b as (select feature, p_value as ridge from rates where model = 'Ridge' and feature <> 'R')
    select feature, lasso, ridge from a full outer join b using (feature)""",
)
def results_aligned(spark, sf):
    """Index-aligned outer join of two result columns."""
    rates = _model_rates(spark, sf)
    a = rates.where("model = 'Lasso' and feature <> 'A'").select("feature", F.col("p_value").alias("lasso"))
    b = rates.where("model = 'Ridge' and feature <> 'R'").select("feature", F.col("p_value").alias("ridge"))
    return src.align_on_index(a, b)


@query(
    "results_union",
    f"""select 'a' as model_id, l_returnflag as feature, {sql_rnd('avg(l_discount)', 9)} as score, null::double as extra from lineitem group by 2
    union all select 'b', l_linestatus, {sql_rnd('avg(l_tax)', 9)}, {sql_rnd('max(l_tax)', 9)} from lineitem group by 2""",
)
def results_union(spark, sf):
    li = B.table(spark, sf, "lineitem")
    a = li.groupBy(F.col("l_returnflag").alias("feature")).agg(rnd(F.avg("l_discount"), 9).alias("score"))
    b = li.groupBy(F.col("l_linestatus").alias("feature")).agg(
        rnd(F.avg("l_tax"), 9).alias("score"), rnd(F.max("l_tax"), 9).alias("extra")
    )
    return clean.append_frames(
        a.select(F.lit("a").alias("model_id"), "*"), b.select(F.lit("b").alias("model_id"), "*")
    )


# -- projections and filters ---------------------------------------------------


@query(
    "rename_map",
    f"""with {B.RESULTS_SQL} select SNP, ALLELE as Allele, iscores, "NBETA-50-0.0" as Beta,
    "NSE-50-0.0" as SE, "PV-50-0.0" as p_value, row_key, Chromosome from res""",
)
def rename_map(spark, sf):
    return clean.rename_results(B.result_rows(spark, sf))


@query(
    "coalesce_twin",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       coalesce(nullif(l_tax, 0), l_discount) as iscores from lineitem""",
)
def coalesce_twin(spark, sf):
    li = B.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("iscores"), F.col("l_discount").alias("iscore"),
    )
    return clean.fill_twin_score(li)


@query(
    "drop_reorder",
    "select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount from lineitem",
)
def drop_reorder(spark, sf):
    li = B.table(spark, sf, "lineitem").drop(
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    return clean.order_columns(li, ["l_partkey", "l_suppkey"], ["l_discount"])


_FLOORED_SQL = f"""{B.LI_SQL}, low as (select min(l_discount) / 2 as low from lineitem where l_discount <> 0),
    fl as (select li.*, case when l_discount = 0 then low else l_discount end as p_value from li, low)"""


def _floored(spark, sf):
    li = B.line_items(spark, sf).withColumn("p_value", F.col("l_discount"))
    return clean.zero_floor(li)


@query("zero_floor", f"with {_FLOORED_SQL} select row_key, p_value from fl")
def zero_floor(spark, sf):
    return _floored(spark, sf).select("row_key", "p_value")


@query("neg_log10", f"with {_FLOORED_SQL} select row_key, {sql_rnd('-log10(p_value)', 9)} as log_p from fl")
def neg_log10(spark, sf):
    return _floored(spark, sf).select("row_key", rnd(S.neg_log10("p_value"), 9).alias("log_p"))


@query(
    "aligned_targets",
    f"""with {_FLOORED_SQL}, t as (
      select 1.0::double as Intercept, 'p_value' as target_name, p_value as y from fl
      union all select 1.0::double, '-log10_p', -log10(p_value) from fl)
    select target_name, count(*) as n_rows, {sql_rnd('sum(Intercept)')} as n_intercept, {sql_rnd('avg(y)')} as mean_y,
      {sql_rnd('stddev_samp(y)')} as sd_y from t group by 1""",
)
def aligned_targets(spark, sf):
    """Raw and log target from the same row, with an intercept column, in long form."""
    rows = _floored(spark, sf).select("p_value", S.neg_log10("p_value").alias("log_p"))
    both = clean.add_intercept(
        clean.stack_targets(rows, {"p_value": "p_value", "-log10_p": "log_p"})
    )
    return both.groupBy("target_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        rnd(F.sum("Intercept")).alias("n_intercept"),
        rnd(F.avg("y")).alias("mean_y"),
        rnd(F.stddev_samp("y")).alias("sd_y"),
    )


_REPORT_SQL = f"""rep as (select {_MODEL_OF_LINE} as model, row_key, l_discount as p_value from li),
    low as (select least(min(p_value), 2e-30) / 2 as low from rep where p_value > 0)"""


def _report_rows(spark, sf):
    names = F.array(*[F.lit(n) for n in store.MODEL_NAMES])
    return B.line_items(spark, sf).select(
        F.element_at(names, F.col("l_linenumber")).alias("model"),
        "row_key",
        F.col("l_discount").alias("p_value"),
    )


@query(
    "report_log_p",
    f"""with {B.LI_SQL}, {_REPORT_SQL} select model, row_key, p_value,
    {sql_rnd('-log10(case when p_value = 0 then low else p_value end)', 9)} as log_p from rep, low""",
)
def report_log_p(spark, sf):
    return clean.report_log_p(_report_rows(spark, sf)).withColumn("log_p", rnd("log_p", 9))


@query(
    "signif_flags",
    f"""with {B.LI_SQL}, {_REPORT_SQL} select model, row_key, p_value, p_value < 0.05 as signif
    from rep where model in {store.SELECTED_PAIR}""",
)
def signif_flags(spark, sf):
    return clean.flag_significant(_report_rows(spark, sf), models=store.SELECTED_PAIR)


@query(
    "rare_recode",
    """select p_partkey, case when p_size < 5 then null when p_type in ('ECONOMY', 'SMALL') then p_type else 'Other' end as p_type_v2 from part""",
)
def rare_recode(spark, sf):
    part = B.table(spark, sf, "part").withColumn("t", F.when(F.col("p_size") >= 5, F.col("p_type")))
    return part.select("p_partkey", S.rare_to_other("t", ["ECONOMY", "SMALL"]).alias("p_type_v2"))


@query(
    "category_domain",
    """select case when l_suppkey between 1 and 22 then l_suppkey end as chr_no, count(*) as n_rows from lineitem group by 1""",
)
def category_domain(spark, sf):
    li = B.table(spark, sf, "lineitem").select(S.within_domain("l_suppkey", 1, 22).alias("chr_no"))
    return li.groupBy("chr_no").agg(F.count(F.lit(1)).alias("n_rows"))


_LI_TYPED = [
    ("l_partkey", "numeric"), ("l_suppkey", "numeric"), ("l_linenumber", "numeric"), ("l_quantity", "numeric"),
    ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"),
    ("l_returnflag", "nominal"), ("l_linestatus", "nominal"),
]


@query(
    "typed_columns",
    " union all ".join(
        f"select '{c}' as \"column\", '{k}' as kind, count({c}) as n_present from lineitem" for c, k in _LI_TYPED
    ),
)
def typed_columns(spark, sf):
    return clean.column_kinds(B.table(spark, sf, "lineitem"), exceptions=["l_orderkey", "l_shipdate"])


_ANNO_SQL = """an as (select p_partkey,
    case when p_size % 3 > 0 then p_brand || ';' || p_type else p_brand end as genes,
    ['UTR3','downstream','exonic','intergenic','intronic','ncRNA_intronic','upstream','UTR5'][p_size % 8 + 1] as func,
    nullif(p_type, 'ECONOMY') as note, case when p_size < 0 then 1.0 end as empty, case when p_size > 25 then p_retailprice end as half
    from part)"""


def _annotation(spark, sf):
    classes = ["UTR3", "downstream", "exonic", "intergenic", "intronic", "ncRNA_intronic", "upstream", "UTR5"]
    size = F.col("p_size")
    return B.table(spark, sf, "part").select(
        "p_partkey",
        F.when(size % 3 > 0, F.concat_ws(";", "p_brand", "p_type")).otherwise(F.col("p_brand")).alias("genes"),
        F.element_at(F.lit(classes), size % 8 + 1).alias("func"),
        S.null_tokens("p_type", ["ECONOMY"]).alias("note"),
        F.when(size < 0, F.lit(1.0)).alias("empty"),
        F.when(size > 25, F.col("p_retailprice")).alias("half"),
    )


@query(
    "split_gene",
    f"""with {_ANNO_SQL} select p_partkey, str_split(genes, ';')[1] as Gene1, str_split(genes, ';')[2] as Gene2 from an""",
)
def split_gene(spark, sf):
    return _annotation(spark, sf).select("p_partkey", *S.split_fixed("genes", ";", ["Gene1", "Gene2"]))


@query(
    "split_gene_three",
    """with g as (select p_partkey, p_type || ';' || p_brand || ';' || p_name as genes from part)
    select p_partkey, unnest(range(0, 3))::int as pos, unnest(str_split(genes, ';')) as gene from g""",
)
def split_gene_three(spark, sf):
    """Every part of a list of names as a row, however many there are."""
    names = F.concat_ws(";", "p_type", "p_brand", "p_name").alias("genes")
    rows = B.table(spark, sf, "part").select("p_partkey", names)
    return rows.select("p_partkey", S.split_parts("genes", ";").alias("pos", "gene"))


@query(
    "func_class_counts",
    f"""with {_ANNO_SQL} select func, count(*) as n_rows, count(half) as n_half from an
    where func not in ('upstream', 'UTR5') group by func""",
)
def func_class_counts(spark, sf):
    return clean.by_function_class(_annotation(spark, sf), "func").groupBy("func").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("half").alias("n_half")
    )


@query("drop_sparse", f"with {_ANNO_SQL} select p_partkey, genes, func, note, half from an")
def drop_sparse(spark, sf):
    return clean.drop_sparse(_annotation(spark, sf))


@query(
    "missing_summary",
    f"with {_ANNO_SQL} "
    + " union all ".join(
        f"select func, '{c}' as \"column\", {sql_rnd(f'avg(case when {c} is null then 1.0 else 0.0 end)', 9)} as missing_share from an group by func"
        for c in ("p_partkey", "genes", "note", "empty", "half")
    ),
)
def missing_summary(spark, sf):
    return clean.missing_summary(_annotation(spark, sf), ["func"]).withColumn(
        "missing_share", rnd("missing_share", 9)
    )


@query(
    "hwe_threshold",
    " union all ".join(
        f"select {b}::double as bound, {sql_rnd(f'avg(case when nullif(p_size, 1) / 50.0::double <= {b}::double then 1.0 else 0.0 end)', 9)} as share from part"
        for b in (0.05, 0.005, 0.5)
    ),
)
def hwe_threshold(spark, sf):
    part = B.table(spark, sf, "part").select(
        (F.nullif(F.col("p_size"), F.lit(1)) / F.lit(50.0)).alias("HWE_P")
    )
    return clean.threshold_share(part, "HWE_P", [0.05, 0.005, 0.5]).withColumn("share", rnd("share", 9))


@query(
    "outlier_rows",
    f"""with x as (select o_orderkey, exp(o_totalprice / 50000) as v from orders),
    s as (select avg(v) as m, stddev_pop(v) as s from x)
    select o_orderkey, {sql_rnd('(v - m) / s')} as z from x, s where abs((v - m) / s) >= 2.5""",
)
def outlier_rows(spark, sf):
    rows = B.table(spark, sf, "orders").select(
        "o_orderkey", F.exp(F.col("o_totalprice") / F.lit(50000.0)).alias("v")
    )
    return clean.outlier_rows(rows, "v", 2.5).select("o_orderkey", rnd("z").alias("z"))


@query(
    "trait_key_norm",
    "select p_partkey, regexp_replace('(' || p_brand || '/' || p_size || ')-0.0', '[()/]', '_', 'g') as trait from part",
)
def trait_key_norm(spark, sf):
    raw = F.concat(F.lit("("), F.col("p_brand"), F.lit("/"), F.col("p_size"), F.lit(")-0.0"))
    return B.table(spark, sf, "part").select("p_partkey", S.trait_key(raw).alias("trait"))


@query(
    "file_labels",
    "select p_partkey, replace(p_name, ' ', '_') as label, p_partkey * 10 + length(p_brand) - length(p_type) as end_position from part",
)
def file_labels(spark, sf):
    return B.table(spark, sf, "part").select(
        "p_partkey",
        S.file_label("p_name").alias("label"),
        S.allele_length_end(F.col("p_partkey") * 10, "p_brand", "p_type").alias("end_position"),
    )


# -- annotation joins ------------------------------------------------------------

_VARIANT_POS_SQL = f"vp as (select {B.ROW_KEY_SQL} as row_key, 'chr' || l_linenumber as Chromosome, l_partkey * 50 as Position, l_returnflag as A1, l_linestatus as A2 from lineitem)"
_GENES_SQL = """genes as (select 'chr' || (s_suppkey % 7 + 1) as Chromosome, s_suppkey * 1000 as "start",
    s_suppkey * 1000 + 400 + (s_suppkey % 5) * 4000 as "end", s_name as name,
    ['exonic','UTR5','UTR3','intronic','ncRNA_intronic','downstream'][s_nationkey % 6 + 1] as class,
    list_position(['exonic','splicing','ncRNA_exonic','ncRNA_splicing','ncRNA_intronic','UTR5','UTR3','intronic','upstream','downstream','intergenic'],
      ['exonic','UTR5','UTR3','intronic','ncRNA_intronic','downstream'][s_nationkey % 6 + 1]) as rank
    from supplier)"""


def _variant_positions(spark, sf):
    return B.line_items(spark, sf).select(
        "row_key", "Chromosome", (F.col("l_partkey") * 50).alias("Position"),
        F.col("l_returnflag").alias("A1"), F.col("l_linestatus").alias("A2"),
    )


def _genes(spark, sf):
    classes = ["exonic", "UTR5", "UTR3", "intronic", "ncRNA_intronic", "downstream"]
    k = F.col("s_suppkey")
    return B.table(spark, sf, "supplier").select(
        F.concat(F.lit("chr"), k % 7 + 1).alias("Chromosome"),
        (k * 1000).alias("start"),
        (k * 1000 + 400 + (k % 5) * 4000).alias("end"),
        F.col("s_name").alias("name"),
        F.element_at(F.lit(classes), F.col("s_nationkey") % 6 + 1).alias("class"),
    )


@query(
    "gene_annotate",
    f"""with {_VARIANT_POS_SQL}, {_GENES_SQL},
    xr as (select s_name as name, n_name as xref from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 0),
    hits as (select vp.*, g.name, g.class, g.rank, xr.xref,
               min(g.rank) over (partition by vp.row_key) as best
             from vp left join genes g on vp.Chromosome = g.Chromosome and vp.Position between g."start" and g."end"
             left join xr on xr.name = g.name)
    select row_key, Chromosome, Position, A1, A2, coalesce(min(class), 'intergenic') as func_class,
      coalesce(string_agg(distinct name, ';' order by name), '-') as gene_names,
      coalesce(string_agg(distinct xref, ';' order by xref), '-') as gene_xref
    from hits where rank is null or rank = best group by all""",
)
def gene_annotate(spark, sf):
    xref = (
        B.table(spark, sf, "supplier")
        .where("s_acctbal > 0")
        .join(B.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_name").alias("name"), F.col("n_name").alias("xref"))
    )
    return annotate.annotate_genes(
        _variant_positions(spark, sf), _genes(spark, sf), xref=xref, width=5000, salt_by=["row_key"]
    )


@query(
    "region_annotate",
    f"""with {_VARIANT_POS_SQL}, bands as (
      select 'chr' || c as Chromosome, s_suppkey * 1000 as "start", s_suppkey * 1000 + 899 as "end", 'q' || (s_suppkey % 40) as name
      from supplier, range(1, 7) t(c))
    select row_key, vp.Chromosome, Position, A1, A2, coalesce(string_agg(distinct name, ';' order by name), '-') as cytoBand
    from vp left join bands b on vp.Chromosome = b.Chromosome and vp.Position between b."start" and b."end" group by all""",
)
def region_annotate(spark, sf):
    k = F.col("s_suppkey")
    supplier = B.table(spark, sf, "supplier").withColumn(
        "c", F.explode(F.sequence(F.lit(1), F.lit(6)))
    )
    bands = supplier.select(
        F.concat(F.lit("chr"), F.col("c")).alias("Chromosome"),
        (k * 1000).alias("start"), (k * 1000 + 899).alias("end"),
        F.concat(F.lit("q"), k % 40).alias("name"),
    )
    return annotate.annotate_regions(
        _variant_positions(spark, sf), bands, out="cytoBand", width=5000, salt_by=["row_key"]
    )


_ALLELE_DB_SQL = """db as (select 'chr' || (p_partkey % 7 + 1) as Chromosome, p_partkey * 50 as Position,
    ['A','N','R'][p_partkey % 3 + 1] as A1, ['O','F'][p_partkey % 2 + 1] as A2, p_size, p_name, p_brand from part)"""


@query(
    "filter_annotate",
    f"""with {_VARIANT_POS_SQL}, {_ALLELE_DB_SQL}
    select row_key, Chromosome, Position, A1, A2, coalesce(cast(e.p_size as varchar), '-') as exac03_freq,
      coalesce(s.p_name, '-') as avsnp147_id, coalesce(n.p_brand, '-') as dbnsfp30a_score
    from vp left join (select * from db where p_size > 10) e using (Chromosome, Position, A1, A2)
    left join (select * from db where p_size < 40) s using (Chromosome, Position, A1, A2)
    left join (select * from db) n using (Chromosome, Position, A1, A2)""",
)
def filter_annotate(spark, sf):
    k = F.col("p_partkey")
    db = B.table(spark, sf, "part").select(
        F.concat(F.lit("chr"), k % 7 + 1).alias("Chromosome"),
        (k * 50).alias("Position"),
        F.element_at(F.lit(["A", "N", "R"]), (k % 3 + 1).cast("int")).alias("A1"),
        F.element_at(F.lit(["O", "F"]), (k % 2 + 1).cast("int")).alias("A2"),
        "p_size", "p_name", "p_brand",
    )
    on = ["Chromosome", "Position", "A1", "A2"]
    return annotate.annotate_alleles(
        _variant_positions(spark, sf),
        {
            "exac03": db.where("p_size > 10").select(*on, F.col("p_size").alias("freq")),
            "avsnp147": db.where("p_size < 40").select(*on, F.col("p_name").alias("id")),
            "dbnsfp30a": db.select(*on, F.col("p_brand").alias("score")),
        },
        on,
        salt_by=["row_key"],
    )


# -- sampling --------------------------------------------------------------------


@query(
    "per_group_sample",
    f"""with {B.LI_SQL} select row_key, Chromosome from li
    qualify row_number() over (partition by Chromosome order by md5(concat_ws(':', '0', row_key))) <= 1000""",
)
def per_group_sample(spark, sf):
    li = B.line_items(spark, sf).select("row_key", "Chromosome")
    return sampling.sample_rows(li, ["row_key"], 1000, seed=0, group=["Chromosome"])


@query(
    "per_group_sample_null",
    f"""with {B.LI_SQL}, g as (select row_key, nullif(Chromosome, 'chr1') as Chromosome from li) select row_key, Chromosome from g
    qualify row_number() over (partition by Chromosome order by md5(concat_ws(':', '0', row_key))) <= 1000""",
)
def per_group_sample_null(spark, sf):
    """A missing group is a group."""
    li = B.line_items(spark, sf).select("row_key", F.nullif("Chromosome", F.lit("chr1")).alias("Chromosome"))
    return sampling.sample_rows(li, ["row_key"], 1000, seed=0, group=["Chromosome"])


@query(
    "global_sample",
    "select o_orderkey, o_totalprice from orders order by md5(concat_ws(':', '1010', o_orderkey)) limit 400",
)
def global_sample(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sampling.sample_rows(o, ["o_orderkey"], 400, seed=1010)


@query("train_test_split", f"with {B.ORD_SQL} select o_orderkey, is_test from od")
def train_test_split(spark, sf):
    return B.order_rows(spark, sf).select("o_orderkey", "is_test")


@query(
    "exact_split",
    """select o_orderkey, row_number() over (order by md5(concat_ws(':', '1010', o_orderkey)))
       <= ceil(count(*) over () * 0.3::double) as is_test from orders""",
)
def exact_split(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey")
    return sampling.split_rows(o, ["o_orderkey"], exact=True)


@query(
    "subsample_members",
    f"with {B.sql_draws(5, 6)}, {B.sql_members('orders', 'o_orderkey', 5)} select sample_id::int as sample_id, o_orderkey from members",
)
def subsample_members(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey")
    return sampling.subsample_members(o, ["o_orderkey"], 6, seed=5).select("sample_id", "o_orderkey")


@query(
    "exact_subsample",
    """select sample_id::int as sample_id, o_orderkey from (select o_orderkey, sample_id, count(*) over (partition by sample_id) as n,
      row_number() over (partition by sample_id order by md5(concat_ws(':', '5', sample_id, o_orderkey))) as i
      from orders, range(1, 5) t(sample_id)) where i <= floor(n * 0.3::double)""",
)
def exact_subsample(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey")
    return sampling.subsample_members(o, ["o_orderkey"], 4, seed=5, exact=True).select("sample_id", "o_orderkey")


@query(
    "kfold_assign",
    "select o_orderkey, cast((cast('0x' || substr(md5(concat_ws(':', '1010', o_orderkey)), 1, 8) as bigint) * 10) >> 32 as int) as fold from orders",
)
def kfold_assign(spark, sf):
    return sampling.fold_rows(B.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query(
    "exact_kfold",
    """select o_orderkey, cast(ntile(7) over (order by md5(concat_ws(':', '1010', o_orderkey))) - 1 as int) as fold from orders""",
)
def exact_kfold(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey")
    return sampling.fold_rows(o, ["o_orderkey"], folds=7, exact=True)


@query(
    "child_seeds",
    "select o_orderkey, cast('0x' || substr(md5(concat_ws(':', '42', o_orderkey)), 1, 8) as bigint) as child_seed from orders",
)
def child_seeds(spark, sf):
    return sampling.child_seeds(B.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 42)
