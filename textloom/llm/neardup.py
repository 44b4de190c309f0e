"""Problem 2: near-duplicate documents with small edits, insertions or moves.

Documents are compared as sets of ``k``-character runs of their squeezed text.

1. Each text gets a content hash, the number of its distinct runs, bands of a
   one-permutation min-hash, and a bitmap of sampled runs.  Equal texts
   become one class, represented by its smallest id.
2. Classes that share a band fall into one bucket.  In each bucket the bitmaps
   are compared tile by tile with exclusive-or and bit counts; tile pairs whose
   population counts differ by more than the largest possible radius are
   skipped, and only pairs within the radius leave the tile.  Large buckets are
   cut into tiles of about ``tile`` rows by population count and their tile
   pairs spread over the cluster.
3. The remaining pairs are decided by their exact run sets.

The exclusive-or of two presence bitmaps never has more bits than the sampled
runs in which the texts differ, so with all runs sampled (up to 128 of them) the
radius loses nothing; with fewer sampled the radius is five deviations wide.
Comparing every tile with every other one would be quadratic in the documents,
so tiles are formed within buckets.  A pair at the threshold of 0.7 shares no
band with a chance of 0.3 %; at 0.8 that is below one in 100,000.

``exact=True`` loses nothing: buckets are then the least run hashes of each text,
as many as remain beyond the share that two texts of the similarity must have in
common, so every such pair shares one; and a tile leaves out only what sizes, or
all runs sampled, rule out.  It shuffles about 0.3 rows for each run instead of
32 for each text.

Null texts, and texts shorter than ``k`` characters, have no runs: they take
part in no pair and are groups of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from textloom.functions.forms import batches_by_size, runs_by_text, squeezed
from textloom.functions.sketches import OnePermutation, distinct_sorted
from textloom.operators.components import connected_components
from textloom.session import cut, table

K, SIMILARITY = 8, 0.7
BANDS, BAND_ROWS = 32, 5
BITS = 512
SAMPLED = 128
TILE = 1024
COPIES = 64
CACHED = 2000
_HALF = BITS // 2
_ODD = np.uint64(0xD6E8FEB86659FD93)


_SKETCH = OnePermutation(BANDS * BAND_ROWS)


def distinct_runs(texts: list[str], k: int = K) -> list[np.ndarray]:
    """Sorted distinct run hashes of each (already squeezed) text."""
    return [distinct_sorted(h) for h in runs_by_text(texts, k)]


def bitmaps(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Size class of each run set, and its presence bitmap (texts x BITS/64).

    Class c holds sets of 2^c to 2^(c+1) runs and samples at the rate that gives
    SAMPLED of 2^c.  The half of the sample that the next class's rate keeps fills
    the first half of the bitmap, the rest the second; so a set meets the next
    class by its first half against that class's two halves folded together.
    """
    level = np.array([len(h).bit_length() - 1 for h in runs], np.int16)
    maps = np.zeros((len(runs), BITS // 64), np.uint64)
    shift = np.uint64(64 - (_HALF.bit_length() - 1))
    for i, h in enumerate(runs):
        c = int(level[i])
        chosen = h if (1 << c) <= SAMPLED else h[: np.searchsorted(h, np.uint64((SAMPLED << 64 >> c) - 1))]
        kept = len(chosen) if (2 << c) <= SAMPLED else np.searchsorted(chosen, np.uint64((SAMPLED << 63 >> c) - 1))
        bit = (chosen * _ODD) >> shift
        bit[kept:] += np.uint64(_HALF)
        np.bitwise_or.at(maps[i], (bit >> np.uint64(6)).astype(np.intp), np.uint64(1) << (bit & np.uint64(63)))
    return level, maps


_FEATURES = "key long, content binary, runs int, level short, bits binary, bands array<long>"


def _features(similarity: float, exact: bool):
    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches_by_size(texts, 400_000):
                plain = [squeezed(t) for t in texts[a:b]]
                chosen = [i for i, t in enumerate(plain) if len(t) >= K]
                if not chosen:
                    continue
                runs = distinct_runs([plain[i] for i in chosen])
                level, maps = bitmaps(runs)
                if exact:
                    least = [h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1].view(np.int64) for h in runs]
                    bands = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(h) for h in least]).astype(np.int32)), pa.array(np.concatenate(least)))
                else:
                    keyed = (_SKETCH.bands(runs, BAND_ROWS) >> np.uint64(32)) | (np.arange(BANDS, dtype=np.uint64) << np.uint64(32))
                    bands = pa.FixedSizeListArray.from_arrays(pa.array(keyed.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[a + i] for i in chosen], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(plain[i]) for i in chosen], pa.binary()),
                        pa.array([len(h) for h in runs], pa.int32()),
                        pa.array(level, pa.int16()),
                        pa.array([m.tobytes() for m in maps], pa.binary()),
                        bands,
                    ],
                    names=["key", "content", "runs", "level", "bits", "bands"],
                )

    return run


def within_radius(level, runs, maps, i: np.ndarray, j: np.ndarray, similarity: float, exact: bool = False) -> np.ndarray:
    """Which row pairs (i, j) may reach the similarity, by exclusive-or and bit counts; with ``exact`` a sample rules nothing out."""
    top = np.maximum(level[i], level[j])
    near = (np.abs(level[i] - level[j]) <= 1) & (np.minimum(runs[i], runs[j]) >= similarity * np.maximum(runs[i], runs[j]))
    i, j, top = i[near], j[near], top[near]
    half = BITS // 128
    same = level[i] == level[j]
    x, y = maps[i], maps[j]
    low_i, low_j = (level[i] < top)[:, None], (level[j] < top)[:, None]
    x = np.where(same[:, None], x, np.concatenate([np.where(low_i, x[:, :half], x[:, :half] | x[:, half:]), np.zeros_like(x[:, half:])], axis=1))
    y = np.where(same[:, None], y, np.concatenate([np.where(low_j, y[:, :half], y[:, :half] | y[:, half:]), np.zeros_like(y[:, half:])], axis=1))
    apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32)
    rate = np.minimum(1.0, SAMPLED / np.exp2(top))
    mean = (1 - similarity) / (1 + similarity) * (runs[i].astype(np.float64) + runs[j]) * rate
    most = np.where(rate < 1, BITS if exact else mean + 5 * np.sqrt(mean) + 2, mean)
    ok = np.zeros(len(near), bool)
    ok[np.flatnonzero(near)[apart <= most]] = True
    return ok


def _tiles(similarity: float, exact: bool):
    """Compare rows sorted by (bucket, tile pair); side 0 with 1, or all rows of side 2 among themselves."""

    def pairs_of(group: np.ndarray, side: np.ndarray):
        """Row index pairs inside each run of equal group numbers, by growing distance."""
        n = len(group)
        gap = 1
        alive = np.arange(n)
        while True:
            alive = alive[alive + gap < n]
            alive = alive[group[alive] == group[alive + gap]]
            if not len(alive):
                return
            hit = alive[(side[alive] == 2) | (side[alive] != side[alive + gap])]
            if len(hit):
                yield hit, hit + gap
            gap += 1

    def compare(t: pa.Table):
        bucket, pair = t.column("bucket").to_numpy(), t.column("pair").to_numpy()
        group = np.cumsum(np.concatenate(([0], (bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1]))))
        side, key = t.column("side").to_numpy(), t.column("key").to_numpy()
        level, runs = t.column("level").to_numpy().astype(np.intp), t.column("runs").to_numpy()
        maps = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(key), BITS // 64)
        seen = []
        for i, j in pairs_of(group, side):
            ok = within_radius(level, runs, maps, i, j, similarity, exact)
            a, b = key[i[ok]], key[j[ok]]
            seen.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        found = np.unique(np.concatenate(seen, axis=1), axis=1) if seen else np.empty((2, 0), np.int64)
        found = found[:, found[0] != found[1]]
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            bucket, pair = t.column("bucket").to_numpy(), t.column("pair").to_numpy()
            last = len(bucket) - int(np.argmax(((bucket != bucket[-1]) | (pair != pair[-1]))[::-1])) if len(bucket) else 0
            whole = last if len(bucket) and (bucket[0] != bucket[-1] or pair[0] != pair[-1]) else 0
            if whole:
                yield compare(t.slice(0, whole))
            held = t.slice(whole)
        if held is not None and len(held):
            yield compare(held)

    return run


def _tiled(joined: DataFrame, similarity: float, tile: int, exact: bool) -> DataFrame:
    """Rows (bucket, pair, side, ...) of every tile pair that its population counts don't rule out."""
    cold = joined.where(F.col("n") <= tile).select("bucket", F.lit(0).cast("long").alias("pair"), F.lit(2).cast("byte").alias("side"), *_ROW)
    hot = joined.where(F.col("n") > tile)
    # Position of each population count in its bucket, from the bounded histogram of counts.
    histogram = hot.groupBy("bucket", "level", "pop").agg(F.count("*").alias("m"))
    order = Window.partitionBy("bucket").orderBy("level", "pop").rowsBetween(Window.unboundedPreceding, -1)
    histogram = histogram.withColumn("before", F.coalesce(F.sum("m").over(order), F.lit(0)))
    placed = (
        hot.join(histogram, ["bucket", "level", "pop"])
        .withColumn("tile", F.floor((F.col("before") + F.pmod(F.xxhash64("key"), F.col("m"))) / tile))
    )
    tiles = placed.groupBy("bucket", "tile").agg(
        F.min("level").alias("lo"), F.max("level").alias("hi"), F.min("runs").alias("least"), F.max("runs").alias("most"), F.min("pop").alias("pop_lo"), F.max("pop").alias("pop_hi")
    )
    other = tiles.select([F.col(c).alias(c if c == "bucket" else f"_{c}") for c in tiles.columns])
    one_level = (F.col("lo") == F.col("hi")) & (F.col("_lo") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))
    mean = (1 - similarity) / (1 + similarity) * (F.col("most") + F.col("_most")) * F.least(F.lit(1.0), SAMPLED / F.pow(F.lit(2.0), F.col("lo")))
    gap = F.greatest(F.col("pop_lo") - F.col("_pop_hi"), F.col("_pop_lo") - F.col("pop_hi"))
    apart = one_level & (gap > mean + 5 * F.sqrt(mean) + 2) & (F.lit(not exact) | (F.pow(F.lit(2.0), F.col("lo")) <= SAMPLED))
    unlike = (F.col("lo") > F.col("_hi") + 1) | (F.col("_lo") > F.col("hi") + 1) | (F.col("most") < similarity * F.col("_least")) | (F.col("_most") < similarity * F.col("least"))
    both = tiles.join(other, "bucket").where((F.col("tile") <= F.col("_tile")) & ~apart & ~unlike)
    both = both.select("bucket", F.col("tile").alias("t0"), F.col("_tile").alias("t1"), (F.col("tile") * (1 << 31) + F.col("_tile") + 1).cast("long").alias("pair"))
    ends = both.select(
        "bucket",
        "pair",
        F.explode(
            F.when(F.col("t0") == F.col("t1"), F.array(F.struct(F.col("t0").alias("tile"), F.lit(2).cast("byte").alias("side")))).otherwise(
                F.array(F.struct(F.col("t0").alias("tile"), F.lit(0).cast("byte").alias("side")), F.struct(F.col("t1").alias("tile"), F.lit(1).cast("byte").alias("side")))
            )
        ).alias("end"),
    ).select("bucket", "pair", "end.tile", "end.side")
    spread = placed.join(ends, ["bucket", "tile"]).select("bucket", "pair", "side", *_ROW)
    return cold.unionAll(spread)


_ROW = ["key", "runs", "level", "bits"]


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose exact run sets reach the similarity, with it."""
    one = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches):
        known: dict[int, np.ndarray] = {}  # run sets of texts met before; a text of a large group comes often

        def runs_of(key: int, text: str) -> np.ndarray:
            if key not in known:
                if len(known) >= CACHED:
                    known.clear()
                known[key] = distinct_runs([squeezed(text)])[0]
            return known[key]

        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            kept = []
            for i, (x, y) in enumerate(zip(ta, tb)):
                s, t = runs_of(a[i], x), runs_of(b[i], y)
                if min(len(s), len(t)) < similarity * max(len(s), len(t)):
                    continue
                small, large = (s, t) if len(s) <= len(t) else (t, s)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int(np.count_nonzero(large[at] == small)) if len(large) else 0
                if both and both / (len(s) + len(t) - both) >= similarity:
                    kept.append((a[i], b[i], both / (len(s) + len(t) - both)))
            cols = list(zip(*kept)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])

    return two.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, tile: int = TILE, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of each document, and the linked pairs of classes.

    ``members`` has key, class (the smallest id with the same squeezed text) and
    copies; ``links`` has a < b (classes) and their exact similarity.  ``exact``
    finds every pair of the similarity, at a higher cost.
    """
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("text is not null")
    found = cut(texts.mapInArrow(_features(similarity, exact), _FEATURES))
    classes = found.groupBy("content").agg(F.min("key").alias("class"), F.count("*").alias("copies"))
    members = found.select("key", "content").join(classes, "content").select("key", "class", "copies")
    reps = found.join(classes.select(F.col("class").alias("key")), "key", "left_semi")

    banded = reps.select("key", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    signed = reps.select(*_ROW, _population("bits").alias("pop"))
    # An exploded array counts as one element in Spark's estimates; without the hints all bands might be broadcast through the driver.
    rows = banded.hint("merge").join(sizes, "bucket").join(signed.hint("merge"), "key")
    tiles = _tiled(rows, similarity, tile, exact)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = tiles.repartition(parts, "bucket", "pair").sortWithinPartitions("bucket", "pair").mapInArrow(_tiles(similarity, exact), "a long, b long").distinct()
    return members, _verified(near, texts, similarity)


def _population(column: str):
    """Bits set in a bitmap, by its eight-byte words."""
    words = [F.conv(F.hex(F.substring(F.col(column), 8 * w + 1, 8)), 16, -10).cast("long") for w in range(BITS // 64)]
    total = F.bit_count(words[0])
    for w in words[1:]:
        total = total + F.bit_count(w)
    return total


def all_pairs(members: DataFrame, links: DataFrame, copies: int = COPIES) -> DataFrame:
    """Pairs of documents (a < b).

    Copies of one text are expanded into all their pairs up to ``copies`` per
    class; a larger class is given by its representative: each copy paired with
    it, and the links of its text drawn from it alone.  No link is lost by that.
    """
    large = F.col("copies") > copies
    drawn = members.where(~large | (F.col("key") == F.col("class")))
    same_small = members.where(~large & (F.col("copies") > 1))
    same = same_small.alias("x").join(same_small.alias("y"), F.expr("x.class = y.class and x.key < y.key")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    star = members.where(large & (F.col("key") != F.col("class"))).select(F.col("class").alias("a"), F.col("key").alias("b"))
    one = links.select("a", "b").join(drawn.select(F.col("class").alias("a"), F.col("key").alias("x")), "a")
    two = one.join(drawn.select(F.col("class").alias("b"), F.col("key").alias("y")), "b")
    across = two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionAll(star).unionAll(across)


def p2_found(spark, sf_dir) -> DataFrame:
    members, links = near_duplicates(table(spark, sf_dir, "documents"))
    return all_pairs(members, links).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p2_groups(spark, sf_dir) -> DataFrame:
    """One row per document with its group (smallest id), class, and number of linked classes."""
    docs = table(spark, sf_dir, "documents")
    members, links = near_duplicates(docs)
    links = cut(links)
    groups = connected_components(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    placed = members.join(groups.select(F.col("node").alias("class"), F.col("component").alias("group_id")), "class", "left").join(degree, "class", "left")
    return docs.select("doc_id").join(placed, F.col("doc_id") == F.col("key"), "left").select(
        "doc_id",
        F.coalesce("group_id", "class", "doc_id").alias("group_id"),
        F.coalesce("class", "doc_id").alias("class_id"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
