"""Quotas, stratified and weighted draws; all randomness is a hash of a seed and the row's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators.ranking import spread_rank


def largest_remainder(groups: DataFrame, total: int, weight: str, key: str) -> DataFrame:
    """Seats of each group by largest remainders; ties go to the smaller key.  ``groups`` has one row per group."""
    everything = Window.partitionBy()
    exact = F.lit(total) * F.col(weight) / F.sum(weight).over(everything)
    out = groups.withColumn("_floor", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 9))
    out = out.withColumn("_left", F.lit(total) - F.sum("_floor").over(everything)).withColumn("_at", F.row_number().over(everything.orderBy(F.desc("_rest"), key)))
    return out.withColumn("seats", (F.col("_floor") + (F.col("_at") <= F.col("_left")).cast("int")).cast("bigint")).drop("_floor", "_rest", "_left", "_at")


def hash_rank(rows: DataFrame, group: list[str], seed: str, key: str, out: str = "rank") -> DataFrame:
    """Rank within each group by the seeded hash of the key; a group may hold any share of the rows."""
    text = F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))
    ordered = rows.withColumn("_u", F.shiftleft(F.conv(F.substring(F.sha1(text), 1, 13), 16, 10).cast("bigint"), 11))
    return spread_rank(ordered, group, "_u", key, out=out).drop("_u")


def stratified(rows: DataFrame, strata: list[str], n: int, seed: str, key: str) -> DataFrame:
    """About n rows in proportion to the strata, at least one of each."""
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("_size"))
    quota = sizes.withColumn("_quota", F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("_size") / F.sum("_size").over(Window.partitionBy())).cast("int"))).drop("_size")
    joined = hash_rank(rows, strata, seed, key, "_rank").alias("r").join(quota.alias("q"), [F.col(f"r.{s}").eqNullSafe(F.col(f"q.{s}")) for s in strata])
    return joined.where("_rank <= _quota").select("r.*").drop("_rank")


def round_robin(rows: DataFrame, stratum: str, n: int, seed: str, key: str) -> DataFrame:
    """n rows, one of each stratum in turn."""
    return hash_rank(rows, [stratum], seed, key, "_turn").orderBy("_turn", stratum).limit(n).drop("_turn")


def nested_shots(rows: DataFrame, group: str, sizes: list[int], seed: str, key: str) -> DataFrame:
    """(shots, ...): for each size the first rows of one seeded order per group, so smaller sets lie within larger ones."""
    ranked = hash_rank(rows, [group], seed, key, "_rank").where(F.col("_rank") <= max(sizes))
    return ranked.withColumn("shots", F.explode(F.filter(F.array(*[F.lit(s) for s in sorted(sizes)]), lambda s: F.col("_rank") <= s))).drop("_rank")


def without_replacement(rows: DataFrame, n: int, weight: str, seed: str, key: str) -> DataFrame:
    """n rows drawn without replacement, likelier with larger weight (exponential keys)."""
    drawn = rows.where(F.col(weight) > 0).withColumn("draw", F.round(-F.log(T.uniform(seed, key)) / F.col(weight), 6))
    return drawn.orderBy("draw", key).limit(n)


def _few(rows: DataFrame, most: int) -> DataFrame:
    """The rows, to be broadcast; an error if there are more than ``most``."""
    if len(rows.limit(most + 1).select(F.lit(1)).collect()) > most:
        raise ValueError(f"more than {most} choices")
    return F.broadcast(rows)


def weighted_choice(draws: DataFrame, choices: DataFrame, weight: str, key: str, u: str, most: int = 100_000) -> DataFrame:
    """Each draw u in [0, 1) takes the choice whose cumulated weight range holds it.

    ``choices`` has at most ``most`` rows (more are an error); it is cumulated in the order of its key.
    """
    order = Window.partitionBy().orderBy(key)
    ranges = choices.withColumn("_high", F.round(F.sum(weight).over(order) / F.sum(weight).over(Window.partitionBy()), 9))
    ranges = ranges.withColumn("_low", F.coalesce(F.lag("_high").over(order), F.lit(0.0)))
    return draws.join(_few(ranges, most), (F.col(u) >= F.col("_low")) & (F.col(u) < F.col("_high"))).drop("_low", "_high")


def table_weights(tables: DataFrame, anchors: dict[str, float], head_share: float) -> DataFrame:
    """Weight of each table: anchor languages split the head share, the others the tail evenly, each among its tables; held-out ones get 0."""
    anchor = F.create_map(*[F.lit(x) for kv in anchors.items() for x in kv])
    live = tables.withColumn("live", ~F.coalesce("holdout", F.lit(False)))
    langs = live.where("live").groupBy("base_lang").agg(F.count("*").alias("_n"))
    tail = langs.where(~F.col("base_lang").isin(list(anchors))).agg(F.count("*").alias("_tail"))
    share = F.when(anchor[F.col("base_lang")].isNotNull(), F.lit(head_share) * anchor[F.col("base_lang")] / F.lit(sum(anchors.values()))).otherwise(F.lit(1 - head_share) / F.col("_tail"))
    out = live.join(langs, "base_lang", "left").join(tail)
    return out.withColumn("table_weight", F.when(F.col("live"), share / F.col("_n")).otherwise(F.lit(0.0))).drop("_n", "_tail", "live")
