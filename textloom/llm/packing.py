"""Problem 6: filling containers of fixed capacity.

The plan is made over the histogram of lengths, not over documents: lengths go
from long to short, all items of one length at once, each into the fullest kind
of container that still has room (best fit), a new container where none has.
Containers filled alike are one group with a count, so the plan's size depends
on the capacity alone.  Documents then take the planned slots: the r-th document
of a length (by a seeded order) takes the r-th slot of that length.

A document longer than the capacity is cut into full containers of its own and
one remainder, which is packed like a document.  Null and empty texts have no
tokens and take no container.  Capacities below 1 are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.tokens import token_counts
from textloom.operators.ranking import seeded_hash, spread_rank, spread_running_sum
from textloom.session import cut, table

MOST_LENGTHS = 1_000_000


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Groups (items per length, number of containers) that hold every item of the histogram."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    room: list[int] = []  # distinct free sizes with an open group, ascending

    def put(pattern: dict[int, int], count: int, free: int) -> None:
        if free not in open_:
            open_[free] = []
            insort(room, free)
        open_[free].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(room, length)
            if at == len(room):
                each = capacity // length
                if left >= each:
                    put({length: each}, left // each, capacity - each * length)
                if left % each:
                    put({length: left % each}, 1, capacity - left % each * length)
                break
            free = room[at]
            pattern, count = open_[free].pop()
            if not open_[free]:
                del open_[free]
                room.pop(at)
            used = min(count, left)
            if used < count:
                put(pattern, count - used, free)
            put({**pattern, length: pattern.get(length, 0) + 1}, used, free - length)
            left -= used
    return [g for free in sorted(open_) for g in open_[free]]


def _slots(groups: list[tuple[dict[int, int], int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first slot, first container, items per container, offset in the container), and the containers used."""
    rows, given, first = [], {}, 0
    for pattern, count in groups:
        offset = 0
        for length in sorted(pattern, reverse=True):
            each = pattern[length]
            rows.append((length, given.get(length, 0), first, each, offset))
            given[length] = given.get(length, 0) + each * count
            offset += each * length
        first += count
    return rows, first


_OUT = "container_kind string, container_id long, doc_id long, piece int, token_start long, token_end long, offset long"


def pack(docs: DataFrame, sizes: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 31, vocabulary: str | None = None) -> DataFrame:
    """One row per document piece and container kind: its container, token range and place there.

    ``sizes`` has container_kind and capacity_tokens.  The histogram that comes to
    the driver has at most one row per kind and length up to the capacity.
    """
    spark = docs.sparkSession
    kinds = [(r["container_kind"], int(r["capacity_tokens"])) for r in sizes.select("container_kind", "capacity_tokens").distinct().take(1000) if r["capacity_tokens"] and r["capacity_tokens"] > 0]
    if sum(c for _, c in kinds) > MOST_LENGTHS:
        raise ValueError(f"capacities add up to more than {MOST_LENGTHS}")
    counted = cut(token_counts(docs, {"doc_id": F.col(key).cast("long")}, text, vocabulary)).where("tokens > 0")
    if not kinds:
        return spark.createDataFrame([], _OUT)
    capacities = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(c).cast("long").alias("capacity")) for i, (_, c) in enumerate(kinds)]))
    sized = counted.withColumn("_h", seeded_hash(seed, "doc_id")).select("doc_id", "tokens", "_h", capacities.alias("c")).select("doc_id", "tokens", "_h", "c.kind", "c.capacity")
    sized = sized.withColumn("full", F.when(F.col("tokens") > F.col("capacity"), F.expr("tokens div capacity")).otherwise(0)).withColumn("length", F.col("tokens") - F.col("full") * F.col("capacity"))

    histogram: dict[int, dict[int, int]] = {i: {} for i in range(len(kinds))}
    for r in sized.where("length > 0").groupBy("kind", "length").agg(F.count("*").alias("n")).collect():
        histogram[r["kind"]][r["length"]] = r["n"]
    starts, shape, used = [], [], []
    base = np.cumsum([0] + [c + 1 for _, c in kinds])  # each kind's lengths get their own numbers, 40 bits are left for slots
    for i, (_, capacity) in enumerate(kinds):
        rows, containers = _slots(plan_containers(histogram[i], capacity))
        used.append(containers)
        rows.sort()
        starts.extend(((int(base[i]) + length) << 40) | slot for length, slot, *_ in rows)
        shape.extend(r[1:] for r in rows)
    plan = spark.sparkContext.broadcast((base, np.array(starts, np.int64), np.array(shape, np.int64).reshape(-1, 4), [k for k, _ in kinds]))

    ranked = spread_rank(sized.where("length > 0"), ["kind", "length"], "_h", "doc_id", bits=6)

    def place(batches):
        base, starts, shape, names = plan.value
        names = np.array(names, dtype=object)
        for batch in batches:
            kind, length, rank, full, doc, tokens = (batch.column(i).to_numpy() for i in range(6))
            slot = rank - 1
            at = np.searchsorted(starts, ((base[kind] + length) << 40) | slot, side="right") - 1
            first_slot, container, each, offset = shape[at].T
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names[kind], pa.string()),
                    pa.array(container + (slot - first_slot) // each),
                    batch.column(4),
                    pa.array(full.astype(np.int32)),
                    pa.array(tokens - length),
                    batch.column(5),
                    pa.array(offset + (slot - first_slot) % each * length),
                ],
                names=[f.split()[0] for f in _OUT.split(", ")],
            )

    packed = ranked.select("kind", "length", "rank", "full", "doc_id", "tokens").mapInArrow(place, _OUT)
    cut_up = spread_running_sum(sized.where("full > 0"), ["kind"], "_h", "doc_id", "full")
    named = F.element_at(F.array(*[F.lit(k) for k, _ in kinds]), F.col("kind") + 1)
    after = F.element_at(F.array(*[F.lit(u).cast("long") for u in used]), F.col("kind") + 1)
    whole = cut_up.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("p")).select(
        named.alias("container_kind"),
        (after + F.col("running") + F.col("p")).alias("container_id"),
        "doc_id",
        F.col("p").cast("int").alias("piece"),
        (F.col("p") * F.col("capacity")).alias("token_start"),
        ((F.col("p") + 1) * F.col("capacity")).alias("token_end"),
        F.lit(0).cast("long").alias("offset"),
    )
    return packed.unionAll(whole)


def p6_containers(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p6_report(spark, sf_dir) -> DataFrame:
    """Containers and filled share of each kind."""
    sizes = table(spark, sf_dir, "pack_sizes")
    packed = pack(table(spark, sf_dir, "documents"), sizes)
    return (
        packed.groupBy("container_kind")
        .agg(F.countDistinct("container_id").alias("containers"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), F.count("*").alias("pieces"))
        .join(sizes, "container_kind")
        .select("container_kind", "containers", "pieces", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))
    )
