"""Sinks on small datasets."""

from textloom.sources import readers, sinks as S


def test_dataset_manifest_and_amendment(spark, tmp_path):
    base = f"file://{tmp_path}"
    rows = spark.createDataFrame([("a", "train", "x", 1, None), ("b", "dev", "y", 2, None), ("n", "train", "x", 1, "a")], "id string, split string, text string, cells int, noise_base_id string")
    S.write_dataset(rows, f"{base}/d")
    assert S.verify_dataset(spark, f"{base}/d").count() == 0
    back = readers.read_records(spark, f"{base}/d/data")
    assert sorted(r["id"] for r in back.collect()) == ["a", "b", "n"]
    S.write_amended(rows, rows.where("id = 'a'"), f"{base}/e", "leak", base="noise_base_id")
    assert [r["id"] for r in readers.read_records(spark, f"{base}/e/data").collect()] == ["b"]
    assert spark.read.json(f"{base}/e/amendments").first()["dropped"] == 1


def test_registry_keeps_sealed_hashes_out(spark, tmp_path):
    base = f"file://{tmp_path}"
    keys = spark.createDataFrame([("wiki", 1, False), ("wiki", 1, False), ("test", 7, True), ("test", 8, True)], "source string, h long, sealed boolean")
    S.write_registry(keys, f"{base}/r")
    assert spark.read.parquet(f"{base}/r/public").count() == 1
    assert (r := spark.read.json(f"{base}/r/sealed").first())["n"] == 2 and r["digest"]


def test_reports_and_pages(spark):
    rows = spark.createDataFrame([("a|b", 0.5), ("c_d", None)], "k string, v double")
    assert S.markdown(rows).splitlines()[2] == "| a\\|b | 0.5 |" and "c\\_d & -- \\\\" in S.tex_rows(rows) and '"k": "a|b"' in S.report_json(rows)
    p = S.pages(spark.createDataFrame([("d", "⠁⠃ ⠉")], "k string, b string"), "k", "b", width=2, height=1).orderBy("page").collect()
    assert [(r["page"], r["brf"]) for r in p] == [(0, "AB"), (1, "C")]
