"""Table files and build inputs: headers, exclusions, include graphs, configuration, identities, lineage, replies of services."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textloom.functions.prose import base_language
from textloom.operators.ranking import ordered_rank

HEADER_LINES = 60
MOST_ROWS = 1_000_000


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, bytes, changed) of the files at a path; their contents aren't read."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def sides(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(side, file, path, bytes, changed): the files of each side of a build."""
    out = None
    for side, path in paths.items():
        part = listing(spark, path).select(F.lit(side).alias("side"), "*")
        out = part if out is None else out.unionAll(part)
    return out


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, n, line): numbered lines of small files (tables, configurations), each read as one row."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "value")
    return whole.select("path", "file", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def table_headers(lines: DataFrame, priority: dict[str, int] | None = None) -> DataFrame:
    """One row per table file: the ``#+key: value`` entries of its first lines (the first of a key counts) as a map and as columns.

    Of files of one name the one in the folder of the least priority number stays.
    """
    meta = lines.where(F.col("n") < HEADER_LINES).withColumn("key", F.lower(F.regexp_extract("line", r"^#\+\s*([A-Za-z_-]+)\s*:", 1))).where("key <> ''")
    value = F.trim(F.regexp_extract("line", r"^#\+\s*[A-Za-z_-]+\s*:\s*(.*?)\s*$", 1))
    first = meta.groupBy("path", "file", "key").agg(F.min_by(value, "n").alias("value"))
    rows = first.groupBy("path", "file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("meta"))
    rank = F.lit(0)
    for part, number in (priority or {}).items():
        rank = F.when(F.col("path").contains(part), number).otherwise(rank)
    best = rows.groupBy("file").agg(F.min_by(F.struct("path", "meta"), F.struct(rank, F.col("path"))).alias("r")).select("file", "r.*")
    return best.select(F.col("file").alias("table_id"), "path", "meta", *[F.col("meta")[k].alias(k) for k in ("language", "type", "grade", "contraction", "direction")])


def usable_headers(headers: DataFrame, excluded: list[str] | None = None, injected: DataFrame | None = None) -> DataFrame:
    """Literary tables that translate forward, without those whose name fits an excluded glob, with further rows of the same columns."""
    glob = lambda g: "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in g) + "$"
    kept = headers.where((F.col("type") == "literary") & F.col("language").isNotNull() & (F.coalesce("direction", F.lit("both")).rlike("forward|both")))
    for g in excluded or []:
        kept = kept.where(~F.col("table_id").rlike(glob(g)))
    kept = kept.withColumn("base_lang", base_language("language"))
    return kept.unionByName(injected, allowMissingColumns=True) if injected is not None else kept


def include_edges(lines: DataFrame) -> DataFrame:
    """(file, target, n): which files a table includes, in order."""
    return lines.withColumn("target", F.regexp_extract("line", r"^\s*include\s+(\S+)", 1)).where("target <> ''").select("file", "target", "n")


def shadow_errors(tables: DataFrame, shadows: DataFrame, forbidden: str = "undefined") -> DataFrame:
    """(file, why) of shadow tables whose includes differ from their table's, or that still hold an active rule of a forbidden opcode."""
    a, b = include_edges(tables).select("file", "target"), include_edges(shadows).select("file", "target")
    differs = a.exceptAll(b).unionAll(b.exceptAll(a)).select("file", F.lit("includes").alias("why"))
    active = shadows.where(F.col("line").rlike(rf"^\s*{forbidden}\b")).select("file", F.lit("active_rule").alias("why"))
    return differs.unionAll(active).distinct()


def load_config(path: str) -> dict:
    """A configuration in YAML, or in JSON where no YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def override_rows(spark: SparkSession, overrides: dict) -> DataFrame:
    """(pattern, status, ord) of a mapping of name patterns to states; YAML's false for ``no`` is that word again."""
    word = lambda v: "no" if v is False else "yes" if v is True else str(v)
    return spark.createDataFrame([(str(k), word(v), i) for i, (k, v) in enumerate(overrides.items())], "pattern string, status string, ord int")


def content_id(rows: DataFrame, prefix: str = "id-") -> str:
    """Prefix and 16 digits of SHA-256 over the sorted rows as JSON: equal rows have one id, in any order.

    For tables of at most MOST_ROWS rows (more are an error).
    """
    lines = rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})).take(MOST_ROWS + 1)
    if len(lines) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    return prefix + hashlib.sha256("\n".join(sorted(r[0] for r in lines)).encode()).hexdigest()[:16]


def lineage(root: str, files: list[str]) -> dict:
    """Digests of files below ``root`` and the state of the version control there (nulls where there is none)."""
    digests = {}
    for f in sorted(files):
        with open(os.path.join(root, f), "rb") as handle:
            digests[f] = hashlib.file_digest(handle, "sha256").hexdigest()

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, check=True, timeout=30).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    changed = git("status", "--porcelain", "--", *files)
    whole = hashlib.sha256("\n".join(f"{d} {f}" for f, d in digests.items()).encode()).hexdigest()
    return {"head": git("rev-parse", "HEAD"), "dirty": None if changed is None else bool(changed), "files": digests, "sha256": whole}


def changed_entries(now: DataFrame, then: DataFrame, label: str = "label", digest: str = "sha256") -> DataFrame:
    """(label, why): entries that are missing, new or of another digest than they were."""
    a, b = now.select(label, F.col(digest).alias("_a")), then.select(label, F.col(digest).alias("_b"))
    why = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "new").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, label, "full").select(label, why.alias("why")).where("why is not null")


def rows_at(rows: DataFrame, order: list[str], places: DataFrame, at: str = "at") -> DataFrame:
    """The rows at the given places (from 0) of an order."""
    numbered = ordered_rank(rows.withColumn("_all", F.lit(0)), ["_all"], order, out="_n").drop("_all")
    return numbered.withColumn(at, F.col("_n") - 1).drop("_n").join(places.select(F.col(at).cast("bigint").alias(at)).distinct(), at, "left_semi")


def reply_text(body: str | Column) -> Column:
    """The text of a service's reply in JSON: its choices' messages, or its content blocks of kind text; null if it has none."""
    x = F.col(body) if isinstance(body, str) else body
    reply = F.from_json(x, "choices array<struct<message:struct<content:string>>>, content array<struct<type:string,text:string>>")
    blocks = F.array_join(F.transform(F.filter(reply["content"], lambda b: b["type"] == "text"), lambda b: b["text"]), "")
    return F.coalesce(F.get(reply["choices"], F.lit(0))["message"]["content"], blocks)


def best_tables(inventory: DataFrame) -> DataFrame:
    """(base_lang, table_id): of each language's current tables, or of all where none is current, the one of highest grade, then fullest contraction, then first name."""
    rank = F.coalesce(F.element_at(F.create_map(F.lit("no"), F.lit(0), F.lit("partial"), F.lit(1), F.lit("full"), F.lit(2)), F.col("contraction")), F.lit(-1))
    order = Window.partitionBy("base_lang").orderBy(F.desc(F.col("status") == "current"), F.desc(F.coalesce(F.try_to_number("grade", F.lit("9")).cast("int"), F.lit(-1))), F.desc(rank), "table_id")
    return inventory.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("base_lang", "table_id")
