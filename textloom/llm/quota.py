"""Problem 5: a sample that follows target proportions, by divisor-method priorities.

Records of a cell are put in a random order (a seeded hash); the record of rank
r in a cell of target t has priority (r - 0.5) / t.  Each cell's first
``min_rows`` records go first, then the smallest priorities of all cells until
the sample is full, so seats of an exhausted cell pass to the others by
themselves.  Only counts per cell reach the driver (one row per target cell):
they fix how many records each cell gives, and the rank within the cell then
tells whether a record is taken, without sorting all priorities in one place.

Cells without a target give no records.  Null cell fields match no target.
Records delivered again under one id count once per cell.  With fewer records
than the sample size all records of targeted cells are taken.
"""

from __future__ import annotations

import heapq
from math import floor

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from textloom.operators.ranking import seeded_hash, spread_rank
from textloom.session import table

MOST_CELLS = 100_000


def seats(cells: list[tuple[int, float, int, int]], size: int) -> dict[int, int]:
    """Seats of each (cell, target, floor, available) of a sample of ``size``, by the divisor method.

    Floors come first (by priority, should even they exceed the size), then the
    smallest priorities; equal priorities go to the smaller cell id.
    """
    got = {c: 0 for c, *_ in cells}
    floors = {c: min(f, n) for c, _, f, n in cells}
    target = {c: t for c, t, _, _ in cells}
    available = {c: n for c, _, _, n in cells}

    def priority(c: int, rank: int) -> float:
        return (rank - 0.5) / target[c] if target[c] > 0 else float("inf")

    def fill(limit: dict[int, int], left: int) -> int:
        """Give the smallest priorities up to each cell's limit; returns what is left."""
        room = sum(limit.values()) - sum(got.values())
        if room <= left:
            got.update(limit)
            return left - room

        def at(x: float) -> dict[int, int]:
            return {c: max(got[c], min(limit[c], floor(x * target[c] + 0.5) if target[c] > 0 else got[c])) for c in got}

        low, high = 0.0, 1.0
        base = sum(got.values())
        while sum(at(high).values()) - base < left and high < 1e300:
            high *= 2
        for _ in range(200):
            mid = (low + high) / 2
            if sum(at(mid).values()) - base > left:
                high = mid
            else:
                low = mid
        now = at(low * (1 - 1e-9))  # a little before: rounding must not decide ties, the queue does
        left -= sum(now.values()) - base
        got.update(now)
        queue = [(priority(c, got[c] + 1), c) for c in got if got[c] < limit[c]]
        heapq.heapify(queue)
        while left and queue:
            _, c = heapq.heappop(queue)
            got[c] += 1
            left -= 1
            if got[c] < limit[c]:
                heapq.heappush(queue, (priority(c, got[c] + 1), c))
        return left

    fill(available, fill(floors, size))
    return got


def _cells(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, cell_id) of the records that fall into a target cell, each once."""
    fields = records.select(F.col("id").cast("string").alias("id"), F.get("tables", F.lit(0)).alias("_code"), F.col("form").alias("_form"), F.col("len_bucket").alias("_len")).where("id is not null")
    goal = targets.select("cell_id", F.col("table_id").alias("_code"), F.col("form").alias("_form"), F.col("len_bucket").alias("_len"))
    return fields.join(goal, ["_code", "_form", "_len"]).select("id", "cell_id").distinct()


def _plan(records: DataFrame, targets: DataFrame, share: float, size: int | None):
    """The records by cell, and one row per cell: (cell_id, target_share, min_rows, available, seats), with the sample size."""
    if size is None:
        size = int(records.agg(F.countDistinct("id").alias("n")).first()["n"] * share)
    placed = _cells(records, targets)
    counted = targets.join(placed.groupBy("cell_id").agg(F.count("*").alias("available")), "cell_id", "left")
    rows = counted.select("cell_id", "target_share", "min_rows", F.coalesce("available", F.lit(0)).alias("available")).take(MOST_CELLS + 1)
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} target cells")
    given = seats([(r["cell_id"], r["target_share"] or 0.0, r["min_rows"] or 0, r["available"]) for r in rows], size)
    plan = [(r["cell_id"], r["target_share"] or 0.0, r["min_rows"] or 0, r["available"], given[r["cell_id"]], size) for r in rows]
    schema = "cell_id int, target_share double, min_rows int, available long, seats long, sample_size long"
    return placed, records.sparkSession.createDataFrame(plan, schema)


def quota_sample(records: DataFrame, targets: DataFrame, *, share: float = 0.1, size: int | None = None, seed: int = 20) -> DataFrame:
    """(id, cell_id, rank, priority) of the sampled records; ``size`` defaults to ``share`` of the distinct ids, rounded down."""
    placed, plan = _plan(records, targets, share, size)
    ranked = spread_rank(placed.withColumn("_h", seeded_hash(seed, "id")), ["cell_id"], "_h", "id")
    return (
        ranked.join(F.broadcast(plan.select("cell_id", "target_share", "seats")), "cell_id")
        .where("rank <= seats")
        .select("id", "cell_id", "rank", F.round((F.col("rank") - 0.5) / F.col("target_share"), 6).alias("priority"))
    )


def quota_report(records: DataFrame, targets: DataFrame, *, share: float = 0.1, size: int | None = None) -> DataFrame:
    """Per cell: what was asked, available and given, and what could not be met."""
    _, plan = _plan(records, targets, share, size)
    wanted = F.col("target_share") * F.col("sample_size")
    return plan.select(
        "cell_id",
        "target_share",
        "min_rows",
        "available",
        "seats",
        F.round(F.try_divide(F.col("seats"), F.sum("seats").over(Window.partitionBy())), 6).alias("actual_share"),
        (F.col("available") < wanted).alias("short_of_share"),
        (F.col("available") < F.col("min_rows")).alias("short_of_minimum"),
    )


def _train(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "records").where("split = 'train'")


def p5_found(spark, sf_dir) -> DataFrame:
    return quota_report(_train(spark, sf_dir), table(spark, sf_dir, "sample_targets")).where("short_of_share or short_of_minimum").select("cell_id")


def p5_sample(spark, sf_dir) -> DataFrame:
    return quota_sample(_train(spark, sf_dir), table(spark, sf_dir, "sample_targets"))


def p5_report(spark, sf_dir) -> DataFrame:
    return quota_report(_train(spark, sf_dir), table(spark, sf_dir, "sample_targets"))


ORACLES = {
    "p5_found": """
        WITH t AS (SELECT id, tables[1] AS code, form, len_bucket FROM records WHERE split = 'train'),
        s AS (SELECT floor(count(DISTINCT id) * 0.1) AS size FROM t),
        n AS (
            SELECT g.cell_id, count(DISTINCT t.id) AS available
            FROM sample_targets g LEFT JOIN t ON t.code = g.table_id AND t.form = g.form AND t.len_bucket = g.len_bucket
            GROUP BY g.cell_id
        )
        SELECT g.cell_id FROM sample_targets g JOIN n USING (cell_id), s
        WHERE n.available < g.target_share * s.size OR n.available < g.min_rows
    """,
}
