"""Checks of a whole dataset: each gives its violations, the report one row per check."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.functions import text as T
from textloom.operators import lines as L, records as R


def changed_files(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, state): files whose digest differs from the manifest's, missing ones, and ones it doesn't know."""
    a, b = now.select("file", F.col("sha256").alias("now")), manifest.select("file", F.col("sha256").alias("then"))
    state = F.when(F.col("then").isNull(), "unknown").when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("then"), "changed")
    return a.join(b, "file", "full").select("file", state.alias("state")).where("state is not null")


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def unknown_codes(records: DataFrame, inventory: DataFrame) -> DataFrame:
    """(id, table_id, why): codes missing in the inventory, and held-out or weightless ones in train and dev."""
    used = records.select("id", "split", F.explode("tables").alias("table_id"))
    known = inventory.select("table_id", F.coalesce("holdout", F.lit(False)).alias("holdout"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.lit(True).alias("known"))
    joined = used.join(known, "table_id", "left")
    why = F.when(F.col("known").isNull(), "unknown").when(F.col("split").isin("train", "dev") & F.col("holdout"), "holdout").when(F.col("split").isin("train", "dev") & (F.col("weight") <= 0), "weightless")
    return joined.select("id", "table_id", why.alias("why")).where("why is not null")


def shared_units(a: DataFrame, b: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, hits): rows of ``a`` that share a line or sub-sentence with ``b``."""
    units = lambda rows, distinct: L.text_units(rows.select(F.col(key), F.explode(F.split(T.nfc(text), "\n")).alias("line")), key, distinct)
    return L.units_in(units(a, False), units(b, True), key)


def one_code_per_text(records: DataFrame) -> DataFrame:
    """Texts that stand under more than one code."""
    s = R.segments_long(records)
    return s.groupBy("text").agg(F.count_distinct("table_id").alias("codes")).where("codes > 1")


def incomplete_pairs(rows: DataFrame, pair: str, text: str, code: str, wanted: list[str]) -> DataFrame:
    """Pairs that aren't one text under exactly the wanted codes."""
    return rows.groupBy(pair).agg(F.count("*").alias("n"), F.count_distinct(text).alias("texts"), F.array_sort(F.collect_set(code)).alias("codes")).where(
        (F.col("n") != len(wanted)) | (F.col("texts") != 1) | (F.col("codes") != F.array_sort(F.array(*[F.lit(w) for w in wanted])))
    )


def bad_noise(noisy: DataFrame, base: DataFrame) -> DataFrame:
    """(id, why) of noise rows: base gone, other text, other length, no change, more flips than said, eight-dot cells."""
    b = base.select(F.col("id").alias("noise_base_id"), F.col("text").alias("b_text"), F.col("braille").alias("b_braille"))
    j = noisy.join(b, "noise_base_id", "left")
    codes = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    flips = F.aggregate(F.zip_with(codes(F.col("braille")), codes(F.col("b_braille")), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    why = (
        F.when(F.col("b_text").isNull(), "no_base")
        .when(F.col("text") != F.col("b_text"), "text")
        .when(F.length("braille") != F.length("b_braille"), "length")
        .when(F.col("braille") == F.col("b_braille"), "unchanged")
        .when(flips != F.col("noise_n_flips"), "flips")
        .when(F.col("braille").rlike("[\\x{2840}-\\x{28FF}]"), "dots")
    )
    return j.select("id", why.alias("why")).where("why is not null")


def missed_targets(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, target, got): groups whose count isn't the target's, with groups on either side only."""
    got = rows.groupBy(key).agg(F.count("*").alias("got"))
    return targets.select(key, "target").join(got, key, "full").select(key, F.coalesce("target", F.lit(0)).alias("target"), F.coalesce("got", F.lit(0)).alias("got")).where("target <> got")


def wrong_joiners(texts: DataFrame, lines: DataFrame, key: str = "id", text: str = "text", head: int = 8) -> DataFrame:
    """Blanks between ideographs after which a known line starts: the joint should have had none.

    The rest of the text is met with lines by their first ``head`` characters, then in full.
    """
    ideograph = "[\\x{3400}-\\x{9FFF}]"
    parts = F.split(text, f"(?<={ideograph}) (?={ideograph})")
    cut = texts.select(key, parts.alias("p")).where(F.size("p") > 1).select(key, "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("n"))
    rest = cut.select(key, (F.length(F.array_join(F.slice("p", F.lit(1), F.col("n")), " ")) + 1).alias("i"), F.array_join(F.slice("p", F.col("n") + 1, F.size("p")), " ").alias("rest"))
    known = lines.select(F.col("line")).where(F.length("line") >= head).distinct().withColumn("h", F.substring("line", 1, head))
    return rest.withColumn("h", F.substring("rest", 1, head)).join(known, "h").where(F.startswith("rest", "line")).select(key, "i").distinct()


def registry_difference(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(side, source, n): hashes of each source only in the stored or only in the recomputed registry."""
    a, b = stored.select("source", "h").distinct(), recomputed.select("source", "h").distinct()
    only = a.join(b, ["source", "h"], "left_anti").withColumn("side", F.lit("stored")).unionByName(b.join(a, ["source", "h"], "left_anti").withColumn("side", F.lit("recomputed")))
    return only.groupBy("side", "source").agg(F.count("*").alias("n"))


def report(checks: dict[str, DataFrame], gates: set[str], examples: int = 20) -> DataFrame:
    """(check_name, violations, gate, passed, examples): one row per check, with a few rows as JSON."""
    out = None
    for name, rows in checks.items():
        shown = rows.select(F.to_json(F.struct(*rows.columns)).alias("j"))
        # The smallest few by a running bounded set: partial per task, so no task holds all violations.
        few = shown.orderBy("j").limit(examples).agg(F.array_sort(F.collect_list("j")).alias("examples"))
        part = shown.agg(F.count("*").alias("violations")).crossJoin(few).select(
            F.lit(name).alias("check_name"), "violations", F.lit(name in gates).alias("gate"), (F.col("violations") == 0).alias("passed"), "examples"
        )
        out = part if out is None else out.unionAll(part)
    return out


def verdict(reported: DataFrame) -> DataFrame:
    """One row: whether all gates and all checks passed."""
    return reported.agg(F.every(F.col("passed") | ~F.col("gate")).alias("freezable"), F.every("passed").alias("clean"), F.count("*").alias("checks"), F.sum("violations").alias("violations"))


def real_row_checks(rows: DataFrame, group: str) -> DataFrame:
    """Violation counts of one-line external rows per group."""
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))
    return rows.groupBy(group).agg(
        F.count("*").alias("rows"),
        count(F.col("text").contains("\n")).alias("line_breaks"),
        count(F.col("text").isNull() | (F.trim("text") == "")).alias("empty"),
        count(~T.is_cells("braille", False)).alias("not_cells"),
        count(F.col("braille").isNull()).alias("no_cells"),
        F.count_distinct("text").alias("texts"),
    )


def gates_met(report: DataFrame, gates: dict[str, tuple[str, float]]) -> DataFrame:
    """(name, value, passed): named figures of a report against their gates (=, <, <=, >, >=); one that is missing or null fails."""
    spark = report.sparkSession
    wanted = spark.createDataFrame([(n, op, float(v)) for n, (op, v) in gates.items()], "name string, op string, bound double")
    met = wanted.join(report.select("name", F.col("value").cast("double").alias("value")), "name", "left")
    v, b = F.col("value"), F.col("bound")
    ok = F.when(F.col("op") == "=", v == b).when(F.col("op") == "<", v < b).when(F.col("op") == "<=", v <= b).when(F.col("op") == ">", v > b).otherwise(v >= b)
    return met.select("name", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


def flag_errors(rows: DataFrame, flag: str, provider: str = "builtin") -> DataFrame:
    """(rows whose stored flag of agreement with the provider's cells is wrong); rows that it refuses agree with nothing."""
    from textloom.operators.builder import feasible

    return feasible(rows, provider).where(F.col(flag).isNull() | (F.col(flag) != F.col("feasible"))).select(*[c for c in rows.columns if c != "braille"], "feasible")
