"""Problem 7: mixing sources to target weights, by capped water-filling.

A source may be given at most ``max_repeats`` times its tokens.  Sources whose
target exceeds that are clamped there and their excess is passed on to the
others in proportion to their targets, again until none exceeds its cap.  The
epochs of a source then become whole repetitions of all its documents and one
more of a seeded part of them, taken in hash order until the fraction of its
tokens is reached.

Documents of sources without a target, and those without tokens, are left out.
Targets of sources without documents pass to the others.  If all sources are
clamped the mixture is smaller than asked; the report tells the shares reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.llm.tokens import token_counts
from textloom.operators.ranking import seeded_hash, spread_running_sum
from textloom.session import cut, table

MOST_SOURCES = 100_000


def water_fill(sources: list[tuple[str, float, float, float]], budget: float) -> dict[str, float]:
    """Tokens given to each (source, target, tokens, most repeats) of the budget."""
    given: dict[str, float] = {}
    free = {s: (t, n * m) for s, t, n, m in sources if t > 0}
    left = budget
    while free:
        weight = sum(t for t, _ in free.values())
        over = [s for s, (t, cap) in free.items() if left * t / weight >= cap]
        if not over:
            given.update({s: left * t / weight for s, (t, _) in free.items()})
            break
        for s in over:
            given[s] = free.pop(s)[1]
        left = budget - sum(given.values())
    return {s: given.get(s, 0.0) for s, *_ in sources}


def _planned(docs: DataFrame, targets: DataFrame, budget: int | None, vocabulary: str | None):
    columns = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string")}
    counted = cut(token_counts(docs.where("source is not null"), columns, "text", vocabulary)).where("tokens > 0")
    totals = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    totals = totals.join(counted.groupBy("source").agg(F.sum("tokens").alias("tokens")), "source", "left")
    rows = totals.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens")).take(MOST_SOURCES + 1)
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if budget is None:
        budget = sum(r["tokens"] for r in rows)
    given = water_fill([(r["source"], r["target_share"] or 0.0, r["tokens"], r["max_repeats"] or 0) for r in rows], budget)
    plan = []
    for r in rows:
        epochs = given[r["source"]] / r["tokens"] if r["tokens"] else 0.0
        whole = min(int(epochs + 1e-9), r["max_repeats"] or 0)
        part = max(0.0, epochs - whole) * r["tokens"] if whole < (r["max_repeats"] or 0) else 0.0
        plan.append((r["source"], r["target_share"], r["max_repeats"], r["tokens"], float(given[r["source"]]), whole, float(part)))
    schema = "source string, target_share double, max_repeats int, available_tokens long, given_tokens double, whole int, part_tokens double"
    return counted, docs.sparkSession.createDataFrame(plan, schema)


def _repeated(counted: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Copies of each document; the extra copy goes to those whose middle lies within the part, in hash order."""
    ordered = spread_running_sum(counted.withColumn("_h", seeded_hash(seed, "doc_id")), ["source"], "_h", "doc_id", "tokens")
    extra = (F.col("running") + F.col("tokens") / 2 <= F.col("part_tokens")).cast("int")
    return ordered.join(F.broadcast(plan), "source").withColumn("copies", F.col("whole") + extra)


def mixture(docs: DataFrame, targets: DataFrame, *, budget: int | None = None, seed: int = 47, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, copies) of every document in the mixture.

    ``budget`` is its size in tokens, by default that of the targeted sources' documents.
    """
    return _repeated(*_planned(docs, targets, budget, vocabulary), seed).where("copies > 0").select("doc_id", "source", "tokens", "copies")


def mixture_report(docs: DataFrame, targets: DataFrame, *, budget: int | None = None, seed: int = 47, vocabulary: str | None = None) -> DataFrame:
    """Per target source: what was asked, the epochs given, and the share reached."""
    counted, plan = _planned(docs, targets, budget, vocabulary)
    reached = _repeated(counted, plan, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    total = reached.agg(F.sum("mixed_tokens").alias("all_tokens"))
    return plan.join(reached, "source", "left").join(F.broadcast(total)).select(
        "source",
        "target_share",
        "max_repeats",
        "available_tokens",
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.round(F.coalesce(F.try_divide("mixed_tokens", "all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
        (F.col("given_tokens") >= F.col("available_tokens") * F.col("max_repeats")).alias("clamped"),
    )


def p7_mixture(spark, sf_dir) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p7_report(spark, sf_dir) -> DataFrame:
    return mixture_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))
