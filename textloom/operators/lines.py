"""Lines, units and runs of a text corpus: cleaning, first-wins deduplication, windows over consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line): each line of each text in NFC; null texts have none."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(T.nfc(text), "\n")).alias("pos", "line"))


def clean_lines(lines: DataFrame, least: int = 20, most: int = 600) -> DataFrame:
    """Stripped lines of an acceptable length."""
    return lines.withColumn("line", T.stripped("line")).where(F.length("line").between(least, most))


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order.

    An aggregate with partial results in the map stage, so a key that holds a
    third of all rows costs no more than any other.
    """
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def text_units(lines: DataFrame, key: str = "doc_id", distinct: bool = True) -> DataFrame:
    """(key, h): keys of the lines (in NFC) and of their sub-sentences, each once per key if ``distinct``."""
    pieces = F.concat(F.array(T.squeezed_blanks("line")), T.sub_sentences("line"))
    units = lines.select(key, F.explode(F.array_distinct(pieces)).alias("unit")).where("unit <> ''").withColumn("lo", T.loose("unit"))
    keys = units.select(key, F.explode(T.unit_keys("unit", "lo")).alias("h"))
    return keys.distinct() if distinct else keys


def units_in(units: DataFrame, registry: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose units occur in the registry, with how many of them do.

    The semi-join comes first, so only units of the registry are shuffled to be told apart.
    """
    return units.join(registry.select("h").distinct(), "h", "left_semi").distinct().groupBy(key).agg(F.count("*").alias("hits"))


def prefer_sources(lines: DataFrame, priority: dict[str, int], group: str, source: str = "source") -> DataFrame:
    """Per group only the lines of its best available source."""
    ranks = F.create_map(*[F.lit(v) for kv in priority.items() for v in kv])
    ranked = lines.withColumn("_p", ranks[F.col(source)]).where("_p is not null")
    best = ranked.groupBy(group).agg(F.min("_p").alias("_p"))
    return ranked.join(best, [group, "_p"]).drop("_p")


def clean_runs(flags: DataFrame, key: str, order: str, flag: str, longest: int = 8) -> DataFrame:
    """(key, k, runs): windows of k consecutive rows whose flag holds throughout, for k up to ``longest``."""
    w = Window.partitionBy(key).orderBy(order)
    # Rows of one stretch of holding flags have one difference of rank and count: n of them hold n - k + 1 windows of k.
    stretch = F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w)
    held = flags.withColumn("_s", stretch).where(flag).groupBy(key, "_s").agg(F.count("*").alias("_n"))
    sizes = F.array(*[F.lit(k) for k in range(1, longest + 1)])
    runs = held.select(key, "_n", F.explode(sizes).alias("k")).groupBy(key, "k").agg(F.sum(F.greatest(F.col("_n") - F.col("k") + 1, F.lit(0))).alias("runs"))
    every = flags.select(key).distinct().select(key, F.explode(sizes).alias("k"))
    return every.join(runs, [key, "k"], "left").select(key, F.coalesce("runs", F.lit(0)).alias("runs"), "k")


def consecutive(lines: DataFrame, n: int, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """Each start position with the n lines from it on, where there are that many."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(0, n - 1)
    return lines.withColumn("run", F.collect_list("line").over(w)).where(F.size("run") == n).select(key, order, F.array_join("run", " ").alias("run"))


def carve_blocks(lines: DataFrame, share: float, block: int, seed: str, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """Marks the lines of a seeded share of blocks of consecutive lines as held out."""
    numbered = lines.withColumn("block", F.floor(F.col(order) / block).cast("bigint"))
    return numbered.withColumn("held_out", T.uniform(seed, key, "block") < share)


def word_ngrams(lines: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """(gram, uses): frequency of n successive words."""
    words = F.split(T.squeezed_blanks("line"), " ")
    grams = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " ")))
    return lines.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("uses"))


def running_distinct(rows: DataFrame, group: str, order: list[str], value: str, target: int) -> DataFrame:
    """Rows of each group up to the one with which the number of distinct values reaches the target.

    The first places of the values are found by an aggregate, the target-th of
    them by partial tops, so only rows up to it are numbered.
    """
    place = F.struct(*order)
    firsts = rows.groupBy(group, value).agg(F.min(place).alias("_first"))
    part = Window.partitionBy(group, F.pmod(F.xxhash64(value), F.lit(64))).orderBy("_first")
    few = firsts.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= target).drop("_r")
    whole = Window.partitionBy(group).orderBy("_first")
    first = few.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= target)
    last = first.groupBy(group).agg(F.max("_first").alias("_last"))
    read = rows.join(last, group).where(place <= F.col("_last")).drop("_last")
    marked = read.join(first.select(group, value, "_first"), [group, value], "left").withColumn("_new", (F.col("_first") == place).cast("int"))
    return marked.withColumn("distinct_so_far", F.sum("_new").over(Window.partitionBy(group).orderBy(*order))).select(*rows.columns, "distinct_so_far")


def reject_reasons(rows: DataFrame, rules: list[tuple[str, "F.Column"]]) -> DataFrame:
    """The first rule each row breaks, in order; null if none."""
    return rows.withColumn("reason", F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def reason_table(rows: DataFrame, group: str, names: list[str]) -> DataFrame:
    """Counts of reasons per group as columns, zero-filled."""
    return rows.groupBy(group).agg(*[F.sum((F.col("reason") == n).cast("bigint")).alias(n) if n else F.count("*") for n in names], F.sum(F.col("reason").isNull().cast("bigint")).alias("accepted")).na.fill(0)
