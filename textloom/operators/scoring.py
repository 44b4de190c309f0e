"""Scores of generated texts: candidate choice, error rates, summaries, intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from textloom.functions import edits as E
from textloom.session import cut


def candidates_long(pools: DataFrame) -> DataFrame:
    """(id, idx, text, lp, finish, greedy): one row per candidate."""
    return pools.select("id", F.posexplode("cands").alias("idx", "c")).select("id", "idx", "c.*")


POLICIES = ("greedy", "oracle", "likely", "verified", "closest")


def _policy_order(policy: str, weight: float) -> Column:
    lp = F.coalesce("lp", F.lit(-1e9))
    far = F.coalesce("d", F.lit(1_000_000))
    order: dict[str, Column] = {
        "greedy": F.struct(F.col("idx")),
        "oracle": F.struct(F.round("cer", 9), F.col("idx")),
        "likely": F.struct(-lp, F.col("idx")),
        "verified": F.struct((far != 0).cast("int").alias("o"), F.when(far == 0, -lp).otherwise(-(lp - weight * far)).alias("s"), F.col("idx")),
        "closest": F.struct((far != 0).cast("int").alias("o"), F.when(far == 0, F.lit(0)).otherwise(far).alias("s"), (-lp).alias("l"), F.col("idx")),
    }
    return order[policy]


def choose(cands: DataFrame, *policies: str, key: str = "id", weight: float = 2.0) -> DataFrame:
    """(key, policy, ...): one candidate per pool and policy, all in one pass; ``d`` is the distance of its cells (0: feasible), null where unparsable.

    greedy: the first.  oracle: least error.  likely: greatest lp.  verified:
    likeliest feasible one, else greatest lp - weight * d, else the first.
    closest: likeliest feasible one, else least d, then lp.  Ties go to the first;
    a null lp counts as the least.
    """
    row = F.struct(*[c for c in cands.columns if c != key])
    picked = cands.groupBy(key).agg(*[F.min_by(row, _policy_order(p, weight)).alias(p) for p in policies])
    each = F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("r")) for p in policies])
    return picked.select(key, F.explode(each).alias("x")).select(key, "x.policy", "x.r.*")


def with_references(rows: DataFrame, *references: DataFrame, key: str = "id") -> DataFrame:
    """The rows with the columns of their reference: of several reference tables the last that has the key counts; a row without any is an error."""
    placed = None
    for n, ref in enumerate(references):
        part = ref.withColumn("_n", F.lit(n))
        placed = part if placed is None else placed.unionByName(part)
    rest = [c for c in references[0].columns if c != key]
    last = placed.groupBy(key).agg(F.max_by(F.struct(*rest), "_n").alias("_r"))
    missing = rows.join(last.select(key), key, "left_anti").limit(1).count()
    if missing:
        raise ValueError("a row has no reference")
    return rows.join(last, key).select(*rows.columns, *[F.col(f"_r.{c}").alias(c) for c in rest if c not in rows.columns])


def micro(num: str, den: str) -> Column:
    """Ratio of sums; null where the denominator is 0."""
    return F.try_divide(F.sum(num), F.sum(den))


def order_statistics(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Upper median, 90th percentile by rank and 5 % trimmed mean, none of them interpolated.

    Worked out on the counts of distinct values, so no group is sorted row by row;
    round the value before if it has very many.
    """
    counts = rows.groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_m"))
    w = Window.partitionBy(*group)
    placed = counts.withColumn("_hi", F.sum("_m").over(w.orderBy("_v"))).withColumn("_n", F.sum("_m").over(w)).withColumn("_lo", F.col("_hi") - F.col("_m"))
    at = lambda k: F.max(F.when((F.col("_lo") <= k) & (k < F.col("_hi")), F.col("_v")))
    low, high = F.floor(F.col("_n") * 0.05), F.floor(F.col("_n") * 0.95)
    kept = F.greatest(F.least(F.col("_hi"), high) - F.greatest(F.col("_lo"), low), F.lit(0))
    return placed.groupBy(*group).agg(
        at(F.floor(F.col("_n") / 2)).alias("median"), at(F.floor(F.col("_n") * 0.9)).alias("p90"), F.try_divide(F.sum(F.col("_v") * kept), F.sum(kept)).alias("trimmed"), F.max("_n").alias("n")
    )


def long_metrics(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value): metrics as rows."""
    return rows.unpivot(keys, metrics, "metric", "value")


def _resampled(rows: DataFrame, group: list[str], sums: list[str], unit: str, resamples: int, seed: int) -> DataFrame:
    """(group, b, s0, s1 ...): sums of the columns in each of ``resamples`` Poisson resamples of the units.

    The weight of a unit in a resample is a hash of (seed, resample, unit), so no
    group is gathered: each batch adds its weighted sums per resample.
    """
    cuts = np.cumsum([np.exp(-1.0)] + [np.exp(-1.0) / np.prod(range(1, k + 1)) for k in range(1, 7)])
    steps = np.array([(seed * 1_000_003 + b) * 0x9E3779B97F4A7C15 % 2**64 for b in range(resamples)], np.uint64)
    names = [f"s{i}" for i in range(len(sums))]
    least = 256

    def add(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            code = pdf.groupby(group, dropna=False, sort=False).ngroup().to_numpy()
            named = pdf[group][~pd.Series(code, index=pdf.index).duplicated()].reset_index(drop=True)
            values = pdf[sums].to_numpy(np.float64)
            total = np.zeros((len(named), resamples, len(sums)))
            h = pd.util.hash_array(pdf[unit].astype(str).to_numpy(dtype=object)).astype(np.uint64)
            for at in range(0, len(h), least):
                u = h[at : at + least, None] ^ steps[None, :]
                for shift, mult in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB), (32, 1)):
                    u ^= u >> np.uint64(shift)
                    u *= np.uint64(mult)
                w = np.searchsorted(cuts, (u >> np.uint64(11)) / 2.0**53).astype(np.float64)
                for g in np.unique(code[at : at + least]):
                    mine = code[at : at + least] == g
                    total[g] += w[mine].T @ values[at : at + least][mine]
            for g in range(len(named)):
                mine = named.iloc[[g] * resamples].reset_index(drop=True)
                yield pd.concat([mine.assign(b=np.arange(resamples, dtype=np.int32)), pd.DataFrame(total[g], columns=names)], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group).schema.fields)
    drawn = rows.select(*group, unit, *sums).mapInPandas(add, f"{kinds}, b int, " + ", ".join(f"{n} double" for n in names))
    return drawn.groupBy(*group, "b").agg(*[F.sum(n).alias(n) for n in names])


def _interval(each: DataFrame, group: list[str], value: Column, *more: Column) -> DataFrame:
    ends = each.groupBy(*group).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("p"), *more)
    return ends.withColumn("low", F.col("p")[0]).withColumn("high", F.col("p")[1]).drop("p")


def bootstrap(rows: DataFrame, group: list[str], num: str, den: str, unit: str, *, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """Ratio of sums with its 95 % percentile interval over Poisson resamples of units."""
    each = _resampled(rows, group, [num, den], unit, resamples, seed)
    return _interval(each, group, F.col("s0") / F.col("s1")).join(rows.groupBy(*group).agg(micro(num, den).alias("point")), group)


def paired_bootstrap(rows: DataFrame, group: list[str], a: tuple[str, str], b: tuple[str, str], unit: str, *, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """Difference of two ratios of sums over the same units (b less a), its 95 % interval, and the share of resamples in which it isn't below 0.

    Each row has the numerators and denominators of both; a resample weights both
    alike, so what makes a unit hard for both cancels out.
    """
    each = _resampled(rows, group, [*a, *b], unit, resamples, seed).withColumn("v", F.col("s2") / F.col("s3") - F.col("s0") / F.col("s1"))
    out = _interval(each, group, F.col("v"), F.avg((F.col("v") >= 0).cast("double")).alias("not_below"))
    return out.join(rows.groupBy(*group).agg((micro(*b) - micro(*a)).alias("difference"), F.count("*").alias("units")), group)


def running_clock(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """A clock that starts anew at times, as one that never does: what was lost at each fall is added on.

    Rows are cut into ranges of (group, order), so a group of any size is spread;
    only the last value of each range crosses to the next.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id()))
    last = ranged.groupBy(group, "_range").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    earlier = Window.partitionBy(group).orderBy("_range")
    before = last.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.lag("_last").over(earlier).alias("_prior"))
    met = ranged.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r"))).drop("_g", "_r")
    w = Window.partitionBy(group, "_range").orderBy(*order)
    prior = F.coalesce(F.lag(value).over(w), "_prior")
    fallen = met.withColumn("_fall", F.when(F.col(value) < prior, prior).otherwise(0))
    totals = fallen.groupBy(group, "_range").agg(F.sum("_fall").alias("_sum"))
    lost = totals.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lost"))
    out = fallen.join(lost, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("clock", F.col(value) + F.col("_lost") + F.sum("_fall").over(w)).select(*rows.columns, "clock")


def bleu(pairs: DataFrame, ref: str, hyp: str, tokenize: str = "none") -> DataFrame:
    """(bleu, hyp_words, ref_words): corpus BLEU of order 4 with the brevity penalty; tokenize is none, 13a or zh.

    Each pair's counts are taken in its Arrow batch and only summed, so no n-gram
    is shuffled.  Without any match of an order the score is that of the smoothing
    by halves (1/2, 1/4 ... of a match).
    """
    sums = pairs.select(E.bleu_counts(F.col(ref), F.col(hyp), F.lit(tokenize)).alias("c")).agg(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(10)])
    hits, alls, score, halves = [F.col(f"c{i}") for i in range(4)], [F.col(f"c{i}") for i in range(4, 8)], F.lit(0.0), F.lit(1.0)
    for hit, every in zip(hits, alls):
        halves = F.when((hit == 0) & (every > 0), halves * 2).otherwise(halves)
        score = score + F.log(F.when(hit == 0, 1 / (halves * every)).otherwise(hit / every))
    brevity = F.when(F.col("c8") < F.col("c9"), F.exp(1 - F.col("c9") / F.col("c8"))).otherwise(1.0)
    whole = F.when((F.col("c7") > 0) & (F.col("c0") > 0), 100 * brevity * F.exp(score / 4)).otherwise(0.0)
    return sums.select(F.round(whole, 4).alias("bleu"), F.col("c8").alias("hyp_words"), F.col("c9").alias("ref_words"))


def chrf(pairs: DataFrame, ref: str, hyp: str, word_order: int = 2) -> DataFrame:
    """(chrf, pairs): corpus character n-gram F-score of orders 1 to 6, with words of orders 1 to ``word_order`` (0: characters alone), recall counting twice."""
    orders = 6 + word_order
    sums = pairs.select(E.chrf_counts(F.col(ref), F.col(hyp), F.lit(word_order)).alias("c")).agg(F.count("*").alias("pairs"), *[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(3 * orders)])
    precision, recall, used = F.lit(0.0), F.lit(0.0), F.lit(0)
    for o in range(orders):
        there = (F.col(f"c{3 * o}") > 0) & (F.col(f"c{3 * o + 1}") > 0)
        precision = precision + F.when(there, F.col(f"c{3 * o + 2}") / F.col(f"c{3 * o}")).otherwise(0.0)
        recall = recall + F.when(there, F.col(f"c{3 * o + 2}") / F.col(f"c{3 * o + 1}")).otherwise(0.0)
        used = used + there.cast("int")
    p, r = precision / F.greatest(used, F.lit(1)), recall / F.greatest(used, F.lit(1))
    return sums.select(F.round(F.when(p + r > 0, 100 * 5 * p * r / (4 * p + r)).otherwise(0.0), 4).alias("chrf"), "pairs")
