"""Readers and writers: text lines, JSON lines, CSV, Parquet, braille page files, file digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as t

from textloom.functions import text as T

SEGMENT = t.StructType([t.StructField(n, k) for n, k in (("table_id", t.StringType()), ("lang", t.StringType()), ("text", t.StringType()), ("braille", t.StringType()), ("confusable_set", t.ArrayType(t.StringType())))])
# The record schema; always passed to readers, as inference would take a null array for a string.
RECORD = t.StructType(
    [
        t.StructField("id", t.StringType()),
        t.StructField("doc_type", t.StringType()),
        t.StructField("k", t.IntegerType()),
        t.StructField("regime", t.StringType()),
        t.StructField("switch_density", t.StringType()),
        t.StructField("len_bucket", t.StringType()),
        t.StructField("cells", t.IntegerType()),
        t.StructField("text", t.StringType()),
        t.StructField("braille", t.StringType()),
        t.StructField("tables", t.ArrayType(t.StringType())),
        t.StructField("langs", t.ArrayType(t.StringType())),
        t.StructField("confusable_set", t.ArrayType(t.StringType())),
        t.StructField("segments", t.ArrayType(SEGMENT)),
        t.StructField("fiber_ambiguous", t.BooleanType()),
        t.StructField("source", t.StringType()),
        t.StructField("n_sentences", t.IntegerType()),
        t.StructField("tag", t.StringType()),
        t.StructField("table_status", t.ArrayType(t.StringType())),
        t.StructField("form", t.StringType()),
        t.StructField("split", t.StringType()),
        t.StructField("engine", t.StringType()),
        t.StructField("seg_join", t.StringType()),
    ]
)


def read_lines(spark: SparkSession, path: str, least: int = 20, most: int = 600) -> DataFrame:
    """(file, line): stripped lines of acceptable length of text files, plain or compressed."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), T.stripped(T.nfc("value")).alias("line"))
    return rows.where(F.length("line").between(least, most))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; broken lines come out in ``_corrupt_record``."""
    return spark.read.schema(t.StructType([*RECORD.fields, t.StructField("_corrupt_record", t.StringType())])).option("mode", "PERMISSIVE").json(path)


def write_records(rows: DataFrame, path: str, gzip: bool = False, by: list[str] | None = None) -> None:
    """JSON lines, one folder per value of ``by``."""
    out = rows.write.mode("overwrite").option("compression", "gzip" if gzip else "none").option("ignoreNullFields", "false")
    (out.partitionBy(*by) if by else out).json(path)


def write_table(rows: DataFrame, path: str, gzip: bool = True) -> None:
    """CSV with a header, sorted by all columns over ranges; one file per partition."""
    rows.orderBy(*rows.columns).write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files at a path."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_brf(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, line_no, cells): braille page files, form feeds between pages, as cells."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    pages = whole.select("file", F.posexplode(F.split("value", "\f")).alias("page", "p"))
    lines = pages.select("file", "page", F.posexplode(F.split("p", "\r?\n")).alias("line_no", "l"))
    return lines.where(F.length("l") > 0).select("file", "page", "line_no", T.ascii_cells("l").alias("cells"))


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
