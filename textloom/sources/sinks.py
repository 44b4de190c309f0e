"""Sinks: datasets by split with a manifest, amended copies, reports as JSON, CSV, Markdown and TeX, page files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import edits as E, text as T
from textloom.sources.readers import file_digests, write_records

MOST_REPORT_ROWS = 100_000


def write_dataset(records: DataFrame, path: str, by: list[str] | None = None, gzip: bool = False) -> None:
    """Records as JSON lines by split, and a manifest of counts and file digests beside them."""
    by = by or ["split"]
    write_records(records, f"{path}/data", gzip, by)
    spark = records.sparkSession
    counts = records.groupBy(*by).agg(F.count("*").alias("records"), F.sum("cells").alias("cells"))
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/counts")
    file_digests(spark, f"{path}/data/*/*").write.mode("overwrite").parquet(f"{path}/digests")


def verify_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(file, state) of the dataset's files that differ from its manifest."""
    from textloom.operators.audit import changed_files

    return changed_files(file_digests(spark, f"{path}/data/*/*"), spark.read.parquet(f"{path}/digests"))


def write_amended(records: DataFrame, dropped: DataFrame, path: str, reason: str, key: str = "id", base: str | None = None) -> None:
    """The dataset without the dropped rows, and without rows that are based on them; the amendment is written down."""
    gone = dropped.select(key).distinct()
    kept = records.join(gone, key, "left_anti")
    if base:
        kept = kept.join(gone.withColumnRenamed(key, base), base, "left_anti")
    write_dataset(kept, path)
    gone.agg(F.count("*").alias("dropped")).select(F.lit(reason).alias("reason"), "dropped").coalesce(1).write.mode("append").json(f"{path}/amendments")


def write_registry(keys: DataFrame, path: str) -> None:
    """(source, h, sealed): hashes of public sources; of sealed ones only their number and digest."""
    public, sealed = keys.where("not sealed"), keys.where("sealed")
    public.select("source", "h").distinct().write.mode("overwrite").partitionBy("source").parquet(f"{path}/public")
    parts = sealed.select("source", "h").distinct().groupBy("source").agg(F.count("*").alias("n"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).cast("string").alias("digest"))
    parts.coalesce(1).write.mode("overwrite").json(f"{path}/sealed")


def _small(rows: DataFrame) -> list:
    got = rows.take(MOST_REPORT_ROWS + 1)
    if len(got) > MOST_REPORT_ROWS:
        raise ValueError(f"a report has at most {MOST_REPORT_ROWS} rows")
    return got


def markdown(rows: DataFrame) -> str:
    """A small table as Markdown."""
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    body = ["| " + " | ".join(show(v) for v in r) + " |" for r in _small(rows)]
    return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *body]) + "\n"


def tex_rows(rows: DataFrame) -> str:
    """A small table as rows of a TeX tabular."""
    special = {c: "\\" + c for c in "&%$#_{}"} | {"~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}
    show = lambda v: "--" if v is None else f"{v:.2f}" if isinstance(v, float) else "".join(special.get(c, c) for c in str(v))
    return "\n".join(" & ".join(show(v) for v in r) + r" \\" for r in _small(rows)) + "\n"


def report_json(rows: DataFrame) -> str:
    return json.dumps([r.asDict(True) for r in _small(rows)], ensure_ascii=False, default=str, sort_keys=True)


def pages(rows: DataFrame, key: str, braille: str, width: int = 40, height: int = 25) -> DataFrame:
    """(key, page, brf): cells wrapped to lines and pages, as braille ASCII with form feeds between pages left to the writer."""
    lines = rows.select(key, F.posexplode(E.wrapped_lines(braille, F.lit(width))).alias("n", "line"))
    paged = lines.withColumn("page", F.floor(F.col("n") / height))
    ordered = paged.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    return ordered.select(key, "page", T.cells_ascii(F.array_join(F.transform("l", lambda x: x["line"]), "\r\n")).alias("brf"))


def write_inventory(inventory: DataFrame, path: str, root: str) -> None:
    """One JSON object per table, sorted by name, with paths relative to ``root``."""
    relative = F.when(F.startswith("file_path", F.lit(root)), F.substring("file_path", len(root) + 1, 1 << 20)).otherwise(F.col("file_path"))
    inventory.withColumn("file_path", relative).orderBy("table_id").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_with_summary(rows: DataFrame, path: str, gzip: bool = True) -> dict:
    """Rows as (compressed) JSON lines, and a summary beside them: how many, and name, size and digest of each file."""
    write_records(rows, f"{path}/data", gzip)
    files = [r.asDict() for r in _small(file_digests(rows.sparkSession, f"{path}/data/part-*").orderBy("file"))]
    summary = {"rows": rows.count(), "files": files}
    rows.sparkSession.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    return summary


def cells_with_places(cells: str, width: int = 40, lines: int = 25) -> dict:
    """The lines of a page file with the place in the source of each of their cells, and how many pages they fill."""
    wrapped = E.wrapped_with_places(cells, list(range(len(cells))), width)
    return {"lines": [line for line, _ in wrapped], "places": [p for _, p in wrapped], "pages": -(-len(wrapped) // lines)}
