"""Building records: a provider of transcriptions, plans, verified assembly, greedy spreading, quota filling.

The transcription function is opaque: a provider maps (table, text) to cells or a
reason for refusal.  The built-in one knows one 64-cell table; others plug in by
the same protocol and are called once per distinct (table, text).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as t
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators.sampling import hash_rank

Transcribe = Callable[[str, str], "tuple[str | None, str | None]"]
_RESULT = t.StructType([t.StructField("braille", t.StringType()), t.StructField("reason", t.StringType())])
# Languages written without blanks between words.
UNSPACED = ["zh", "ja", "th", "lo", "my", "km", "bo", "yue"]
# Codes whose sentences are joined without a blank, and the characters between which none stands.
JOINED = ["cmn", "yue", "ja", "zh", "lzh", "wuu"]
WIDE = "[\\x{3000}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FFEF}]"


def builtin(table: str, text: str) -> tuple[str | None, str | None]:
    """ASCII letters, digits and marks to the 64 cells; anything else is refused."""
    folded = "".join(c.upper() if c.isascii() else c for c in text)
    if any(c not in T.ASCII64 for c in folded):
        return None, "undefined"
    return folded.translate(str.maketrans(T.ASCII64, T.CELLS64)), None


PROVIDERS: dict[str, Transcribe] = {"builtin": builtin}


def transcribe(rows: DataFrame, table: str, text: str, provider: str = "builtin") -> DataFrame:
    """The rows with ``braille`` and ``reason``: each distinct (table, text) is transcribed once, twice for the check of determinism.

    Columns of those names that the rows have are replaced.
    Reasons: missing (null input), undefined, charset (no cells), inconsistent.
    An unknown provider gives ``pending``; no stand-in is used.
    """
    rows = rows.drop(*[c for c in ("braille", "reason") if c not in (table, text)])
    if provider not in PROVIDERS:
        return rows.withColumn("braille", F.lit(None).cast("string")).withColumn("reason", F.lit("pending"))
    run = PROVIDERS[provider]

    @F.pandas_udf(_RESULT)
    def call(tables: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(tables, texts):
            if a is None or b is None:
                out.append((None, "missing"))
                continue
            cells, reason = run(a, b)
            if reason is None and run(a, b) != (cells, None):
                cells, reason = None, "inconsistent"
            if reason is None and not all("⠀" <= c <= "⣿" or c == "\n" for c in cells or "?"):
                cells, reason = None, "charset"
            out.append((cells, reason))
        return pd.DataFrame(out, columns=["braille", "reason"])

    distinct = rows.select(F.col(table).alias("_t"), F.col(text).alias("_x")).distinct().withColumn("_r", call("_t", "_x"))
    joined = rows.join(distinct, F.col(table).eqNullSafe(F.col("_t")) & F.col(text).eqNullSafe(F.col("_x")), "left")
    return joined.select(*[rows[c] for c in rows.columns], F.col("_r.braille").alias("braille"), F.col("_r.reason").alias("reason"))


def rejections(rows: DataFrame, group: str, most_examples: int = 5) -> DataFrame:
    """(group, reason, n, examples): counts of refusals with a few of the smallest texts."""
    counted = rows.where("reason is not null").groupBy(group, "reason", "text").agg(F.count("*").alias("_n"))
    # Partial tops by hash, so no task sorts all texts of one group.
    part = Window.partitionBy(group, "reason", F.pmod(F.xxhash64("text"), F.lit(64))).orderBy("text")
    few = counted.withColumn("_at", F.row_number().over(part)).where(F.col("_at") <= most_examples)
    examples = few.groupBy(group, "reason").agg(F.slice(F.array_sort(F.collect_list("text")), 1, most_examples).alias("examples"))
    sums = counted.groupBy(group, "reason").agg(F.sum("_n").alias("n"))
    return sums.join(examples.select(F.col(group).alias("_g"), F.col("reason").alias("_r"), "examples"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("reason") == F.col("_r"))).drop("_g", "_r")


def joined_sentences(lang: Column, parts: Column) -> Column:
    """Sentences joined without a blank in Chinese and Japanese, or where both sides of a joint are ideographs, kana or full-width; else with one."""
    step = lambda a, p: F.when(a == "", p).when(lang.isin(JOINED) | (F.right(a, F.lit(1)).rlike(WIDE) & F.left(p, F.lit(1)).rlike(WIDE)), F.concat(a, p)).otherwise(F.concat(a, F.lit(" "), p))
    return F.aggregate(parts, F.lit(""), step)


def snippet(text: Column, lang: Column, n: Column, u: Column) -> Column:
    """n consecutive words (characters in unspaced languages) from a place chosen by u."""
    words = F.split(T.squeezed_blanks(text), " ")
    start = F.least(F.floor(u * F.greatest(F.size(words) - n + 1, F.lit(1))).cast("int"), F.greatest(F.size(words) - n, F.lit(0)))
    at = F.least(F.floor(u * F.greatest(F.length(text) - n + 1, F.lit(1))).cast("int"), F.greatest(F.length(text) - n, F.lit(0)))
    return F.when(lang.isin(UNSPACED), text.substr(at + 1, n)).otherwise(F.array_join(F.slice(words, start + 1, n), " "))


def mixed(segments: DataFrame, k: int, seed: str, key: str = "id") -> DataFrame:
    """(doc, k segments): segments in groups of k of different tables: sorted by hash within each table, met by rank."""
    ranked = hash_rank(segments, ["table_id"], seed, key, "_r")
    slot = F.row_number().over(Window.partitionBy("_r").orderBy(T.uniform(seed, "table_id"), "table_id")) - 1
    grouped = ranked.withColumn("_g", F.floor(slot / k))
    docs = grouped.groupBy("_r", "_g").agg(F.array_sort(F.collect_list(F.struct("table_id", "text", key))).alias("segments")).where(F.size("segments") == k)
    return docs.select(F.concat_ws("-", F.lit(f"m{k}"), "_r", "_g").alias("doc"), "segments")


def spread_lines(lines: DataFrame, needs: DataFrame, accepts: DataFrame, seed: str) -> DataFrame:
    """(line, table): each line to one accepting table, none above its need.

    A set-based stand-in for giving each line to the neediest table one by one:
    every line picks, by hash weighted with the need, one of its tables; each
    table keeps its need's worth by hash.  Needs and disjointness hold; the
    choice of lines is not that of the serial order.
    """
    offers = accepts.join(needs, "table").withColumn("_k", -F.log(T.uniform(seed, "line", "table")) / F.col("need"))
    picked = offers.groupBy("line").agg(F.min_by(F.struct("table", "need"), F.struct("_k", "table")).alias("p")).select("line", "p.*")
    return hash_rank(picked, ["table"], seed + "2", "line", "_at").where(F.col("_at") <= F.col("need")).select("line", "table")


def filled(candidates: DataFrame, stratum: str, target: DataFrame, seed: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, shortfall): up to the target of each stratum in hash order, and the strata that fell short."""
    ranked = hash_rank(candidates.join(target, stratum), [stratum], seed, key, "_at")
    accepted = ranked.where(F.col("_at") <= F.col("target")).drop("_at", "target")
    got = accepted.groupBy(stratum).agg(F.count("*").alias("got"))
    short = target.join(got, stratum, "left").select(stratum, "target", F.coalesce("got", F.lit(0)).alias("got")).where("got < target")
    return accepted, short


def feasible(hyps: DataFrame, provider: str = "builtin") -> DataFrame:
    """Hypotheses re-encoded: whether their cells equal the input's, and the distance of the cells (null if refused)."""
    done = transcribe(hyps.withColumnRenamed("braille", "given"), "table_id", "text", provider)
    return done.withColumn("feasible", F.coalesce(F.col("braille") == F.col("given"), F.lit(False))).withColumn("d_cell", F.levenshtein("braille", "given"))
