"""Records with nested segments: latest delivery, flattening and assembly, keys, constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import text as T
from textloom.operators.ranking import ordered_rank

# Enumerations of the record schema.
FORMS_ID = "^u1-[A-Za-z0-9]+-[0-9]{7}$"
DOC_TYPES = ["single", "intra_switch", "inter", "identifier", "snippet", "noise", "embedded", "formula"]
SPLITS = ["train", "dev", "eval"]


def latest(rows: DataFrame, key: list[str], arrived: str) -> DataFrame:
    """The last delivered row of each key, as an aggregate (no window over a hot key)."""
    rest = [c for c in rows.columns if c not in key]
    picked = F.max_by(F.struct(*rest), F.struct(F.col(arrived), F.hash(*[c for c in rest])))
    return rows.groupBy(*key).agg(picked.alias("_r")).select(*key, "_r.*")


def segments_long(records: DataFrame) -> DataFrame:
    """(id, pos, table_id, text, braille): one row per segment; one-segment records give themselves."""
    own = F.array(F.struct(F.get("tables", F.lit(0)).alias("table_id"), "text", "braille"))
    parts = F.transform("segments", lambda s: F.struct(s["table_id"].alias("table_id"), s["text"].alias("text"), s["braille"].alias("braille")))
    return records.select("id", F.posexplode(F.coalesce(parts, own)).alias("pos", "s")).select("id", "pos", "s.*")


def assembled(segments: DataFrame, joint: str = "\n") -> DataFrame:
    """(id, text, k): segments joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return segments.groupBy("id").agg(parts.alias("p")).select("id", F.array_join(F.transform("p", lambda s: s["text"]), joint).alias("text"), F.size("p").alias("k"))


def joint_key(tables: Column, text: Column) -> Column:
    """Deduplication key of a whole record: tables and text."""
    return F.sha1(F.concat(F.array_join(tables, "\u001f"), F.lit("\u001e"), text))


def schema_errors(records: DataFrame) -> DataFrame:
    """(id, errors): names of the constraints that the record breaks, in a fixed order."""
    n = F.size("segments")
    rules = [
        ("id", ~F.coalesce(F.col("id").rlike(FORMS_ID), F.lit(False))),
        ("split", ~F.coalesce(F.col("split").isin(SPLITS), F.lit(False))),
        ("text", F.coalesce(F.length("text"), F.lit(0)) == 0),
        ("braille", F.col("braille").isNull()),
        ("braille_cells", F.col("braille").isNotNull() & ~T.is_cells("braille")),
        ("cells", F.col("braille").isNotNull() & (T.cell_count("braille") != F.col("cells"))),
        ("k", F.col("segments").isNotNull() & (n != F.col("k"))),
        ("tables", F.coalesce(F.size("tables"), F.lit(0)) == 0),
        ("tables_segments", F.col("segments").isNotNull() & (n != F.size("tables"))),
        ("langs", F.size("langs") != F.size("tables")),
        ("len_bucket", F.col("len_bucket").isNull()),
        ("source", F.col("source").isNull()),
        ("sentences", F.col("n_sentences") <= 0),
        ("confusable_sorted", F.col("confusable_set").isNotNull() & (F.array_sort("confusable_set") != F.col("confusable_set"))),
        ("confusable_self", F.arrays_overlap("confusable_set", "tables")),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())
    return records.select("id", found.alias("errors"))


def numbered(rows: DataFrame, group: str, order: list[str], prefix: str) -> DataFrame:
    """A sequence id per group in the given order."""
    ranked = ordered_rank(rows, [group], order, out="_n")
    return ranked.withColumn("seq_id", F.concat(F.lit(prefix), F.col(group), F.lit("-"), F.lpad(F.col("_n").cast("string"), 7, "0"))).drop("_n")


# Enumerations of the strict rules.
REGIMES, DENSITIES = ["single", "anchor", "uniform", "confusable", "math"], ["none", "light", "heavy"]
FORM_ID = "^u1-([A-Za-z0-9]+)-[0-9]{7}$"


def strict_errors(records: DataFrame) -> DataFrame:
    """(id, errors): names of the strict constraints that the record breaks, in a fixed order; a null that a rule needs breaks it.

    Enumerations, equal lengths, segments that join to the record's text and cells,
    counts worked out again, confusable codes that are the sorted union of the
    segments', and line breaks only between segments.
    """
    segs, joint = F.col("segments"), F.coalesce("seg_join", F.lit("\n"))
    many = segs.isNotNull()
    joined = lambda part: F.array_join(F.transform(segs, lambda s: F.coalesce(s[part], F.lit(""))), "\u001d")
    breaks = lambda c: F.length(F.col(c)) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    lined = many & (joint == "\n")
    union = F.array_sort(F.array_distinct(F.flatten(F.transform(segs, lambda s: F.coalesce(s["confusable_set"], F.array().cast("array<string>"))))))
    own = F.coalesce(F.col("confusable_set"), F.array().cast("array<string>"))
    rules = [
        ("id_pattern", ~F.coalesce(F.col("id").rlike(FORM_ID), F.lit(False))),
        ("id_form", F.col("id").rlike(FORM_ID) & ~F.coalesce(F.regexp_extract("id", FORM_ID, 1) == F.col("form"), F.lit(False))),
        ("split", ~F.coalesce(F.col("split").isin(SPLITS), F.lit(False))),
        ("doc_type", ~F.coalesce(F.col("doc_type").isin("single", "intra_switch", "inter", "math"), F.lit(False))),
        ("regime", ~F.coalesce(F.col("regime").isin(REGIMES), F.lit(False))),
        ("switch_density", ~F.coalesce(F.col("switch_density").isin(DENSITIES), F.lit(False))),
        ("tables", F.coalesce(F.size("tables"), F.lit(0)) <= 0),
        ("langs_length", F.coalesce(F.size("langs"), F.lit(-1)) != F.coalesce(F.size("tables"), F.lit(-1))),
        ("status_length", F.coalesce(F.size("table_status"), F.lit(-1)) != F.coalesce(F.size("tables"), F.lit(-1))),
        ("k", ~F.coalesce(F.col("k") == F.size("tables"), F.lit(False))),
        ("segments_missing", ~many & (F.col("k") != 1) & (F.col("doc_type") != "math")),
        ("segments_few", many & (F.size(segs) < 2)),
        ("segments_text", many & (F.replace(joined("text"), F.lit("\u001d"), joint) != F.col("text"))),
        ("segments_cells", many & (F.replace(joined("braille"), F.lit("\u001d"), joint) != F.coalesce("braille", F.lit("")))),
        ("segments_tables", lined & (F.transform(segs, lambda s: s["table_id"]) != F.col("tables"))),
        ("cells_stale", F.coalesce(T.cell_count("braille"), F.lit(0)) != F.coalesce("cells", F.lit(-1))),
        ("len_bucket_stale", ~F.coalesce(T.len_bucket("cells", "n_sentences") == F.col("len_bucket"), F.lit(False))),
        ("confusable_self", F.when(many, F.exists(segs, lambda s: F.coalesce(F.array_contains(s["confusable_set"], s["table_id"]), F.lit(False)))).otherwise(F.array_contains(own, F.get("tables", F.lit(0))))),
        ("text_empty", F.coalesce(F.length("text"), F.lit(0)) == 0),
        ("cells_empty", F.coalesce(F.length("braille"), F.lit(0)) == 0),
        ("sentences", F.coalesce("n_sentences", F.lit(0)) < 1),
        ("tag_empty", F.coalesce(F.length("tag"), F.lit(0)) == 0),
        ("source_type", F.col("source").isNull()),
        ("ambiguous_type", F.col("fiber_ambiguous").isNull()),
        ("items_null", F.exists(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("tables", "langs", "confusable_set", "table_status")]), lambda x: x.isNull())),
        ("confusable_order", own != F.array_sort(F.array_distinct(own))),
        ("confusable_union", many & (union != own)),
        ("seg_join_alone", ~many & F.col("seg_join").isNotNull() & (F.col("seg_join") != "\n")),
        ("break_count", lined & ((breaks("text") != F.size(segs) - 1) | (F.coalesce(breaks("braille"), F.lit(-1)) != F.size(segs) - 1))),
        ("break_inline", many & (joint != "\n") & (F.col("text").contains("\n") | F.col("braille").contains("\n"))),
        ("break_single", ~many & (F.col("text").contains("\n") | F.coalesce(F.col("braille").contains("\n"), F.lit(False)))),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())
    return records.select("id", found.alias("errors"))
