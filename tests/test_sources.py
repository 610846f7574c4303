import gzip

from pyspark.sql import functions as F

from traitspark.operators import clean
from traitspark.sources import tables as src


def _write(path, lines):
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines) + "\n")


def test_partitioned_scan_join_and_tidy(spark, tmp_path):
    head = "SNP ALLELE iscores NBETA-50-0.0 NSE-50-0.0 PV-50-0.0"
    _write(tmp_path / "imputed.allWhites.50.chr1.csv.gz", [head, "rs1 A 0.9 0.1 0.01 0.5", "rs2 C  0.2 0.02 0"])
    _write(tmp_path / "imputed.allWhites.50.chr12.csv.gz", [head, "rs1 G 0.7 0.3 0.03 0.25", "rs9 T 0.6 0.4 0.04 1"])
    _write(tmp_path / "imputed.allWhites.50.chrX.csv.gz", [head, "rs1 G 0.7 0.3 0.03 0.25"])
    _write(tmp_path / "imputed.allWhites.50.chr2x.csv.gz", [head, "rs1 G 0.7 0.3 0.03 0.25"])
    vhead = "SNP Position A1 A2 HWE-P iscore"
    _write(tmp_path / "snps.imputed.a.chr1.csv.gz", [vhead, "rs1 100 A G 0.3 0.91", "rs2 200 AT C 0.04 0.88"])
    (tmp_path / "snps.imputed.a.chr12.csv").write_text(vhead + "\nrs1 300 G T 0.002 0.71\n")
    results = src.read_results(spark, str(tmp_path))
    variants = src.read_variants(spark, str(tmp_path))
    assert {r[0] for r in results.select("Chromosome").distinct().collect()} == {"chr1", "chr12"}
    assert results.count() == 4 and variants.count() == 3
    out = clean.tidy_integrated(clean.integrate(results, variants))
    assert out.columns == ["Chromosome", "Position", "A1", "A2", "SNP", "iscores", "Beta", "SE", "HWE_P", "p_value"]
    rows = {(r["SNP"], r["Chromosome"]): r for r in out.collect()}
    assert set(rows) == {("rs1", "chr1"), ("rs2", "chr1"), ("rs1", "chr12")}
    assert rows["rs2", "chr1"]["iscores"] == 0.88  # from the twin
    floored = {r["SNP"] + r["Chromosome"]: r["p_value"] for r in clean.zero_floor(out).collect()}
    assert floored == {"rs1chr1": 0.5, "rs2chr1": 0.125, "rs1chr12": 0.25}


def test_annotation_tokens_and_sparse_columns(spark, tmp_path):
    (tmp_path / "anno.csv").write_text(
        "Func,Gene,empty,half\nexonic,A;B,.,1\nintronic,C,.,.\nUTR3,.,.,3\nupstream,D;E;F,.,.\n"
    )
    df = src.read_annotation(spark, str(tmp_path / "anno.csv"), "Func string, Gene string, empty string, half int")
    kept, summary = clean.drop_sparse(df, return_summary=True)
    assert kept.columns == ["Func", "Gene", "half"]
    assert {r["column"]: r["missing_share"] for r in summary.collect()} == {
        "Func": 0.0, "Gene": 0.25, "empty": 1.0, "half": 0.5,
    }
    assert clean.drop_sparse(df, 0.5).columns == ["Func", "Gene"]
    assert clean.drop_sparse(df, 7).columns == ["Func", "Gene", "half"]
    assert clean.by_function_class(df, "Func").count() == 3


def test_results_stop_at_first_missing(spark, tmp_path):
    rows = spark.createDataFrame([("Lasso", 0.1), ("Linear Regression", 0.2), ("MLP", 0.3)], "model string, rate double")
    src.write_results(rows, str(tmp_path / "r"))
    names = ["Linear Regression", "Lasso", "Ridge", "MLP"]
    back = src.collect_results(spark, str(tmp_path / "r"))
    done = src.complete_prefix(back, names).orderBy("model_order")
    assert [r["model"] for r in done.collect()] == ["Linear Regression", "Lasso"]
    assert [r[0] for r in src.missing_models(back, names).collect()] == ["Ridge"]


def test_name_list_has_no_header(spark, tmp_path):
    df = spark.createDataFrame([("rs1", 1), ("rs2", 2)], "SNP string, n int")
    src.write_name_list(df, str(tmp_path / "l"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["rs1", "rs2"]


def test_integrated_csv_drops_row_number(spark, tmp_path):
    (tmp_path / "i.csv").write_text(",Chromosome,p_value\n0,chr1,0.5\n1,chr2,0.25\n")
    df = src.read_integrated(spark, str(tmp_path / "i.csv"), "_c0 int, Chromosome string, p_value double")
    assert df.columns == ["Chromosome", "p_value"]
    assert df.agg(F.sum("p_value")).first()[0] == 0.75


def test_columns_are_found_by_name(spark, tmp_path):
    import pytest

    _write(tmp_path / "snps.imputed.a.chr1.csv.gz", ["SNP Position A2 A1 maf HWE-P iscore", "rs1 100 G A 0.25 0.3 0.91"])
    row = src.read_variants(spark, str(tmp_path)).first()
    assert (row["A1"], row["A2"], row["iscore"], row["maf"]) == ("A", "G", 0.91, "0.25")
    lacking = tmp_path / "lacking"
    lacking.mkdir()
    _write(lacking / "snps.imputed.a.chr1.csv.gz", ["SNP Position A1 A2 iscore", "rs1 100 A G 0.9"])
    with pytest.raises(ValueError, match="HWE-P"):
        src.read_variants(spark, str(lacking))


def test_files_with_another_header_are_refused(spark, tmp_path):
    import pytest

    _write(tmp_path / "snps.imputed.a.chr1.csv.gz", ["SNP Position A1 A2 HWE-P iscore", "rs1 100 A G 0.3 0.91"])
    _write(tmp_path / "snps.imputed.a.chr2.csv.gz", ["SNP Position A2 A1 HWE-P iscore", "rs1 100 G A 0.3 0.91"])
    with pytest.raises(Exception, match="header"):
        src.read_variants(spark, str(tmp_path)).collect()
