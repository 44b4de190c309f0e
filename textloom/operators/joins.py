"""Joins by shared pieces, similarity, ranges and closure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.functions.forms import batches_by_size, runs_by_text
from textloom.functions.sketches import distinct_sorted
from textloom.operators.keyfilter import KeyFilter
from textloom.session import cut

QUERIES = 20_000


def shingles(rows: DataFrame, key: str, text: str, k: int, known=None) -> DataFrame:
    """(key, t, n, hs): content hash of the loose text, number of its distinct k-character runs, and their hashes.

    A text shorter than a run is one run; empty and null ones are left out.  With
    ``known``, a broadcast filter, only the hashes that it may hold are given.
    """
    loose = rows.select(F.col(key).cast("string").alias("key"), T.loose(text).alias("t")).where("t is not null and t <> ''")

    def cut_runs(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in batches_by_size(texts, 400_000):
                part = texts[a:b]
                runs = [distinct_sorted(h) if len(h) else np.array([xxhash.xxh64_intdigest(t)], np.uint64) for h, t in zip(runs_by_text(part, k), part)]
                kept = [h[known.value.holds(h)] for h in runs] if known is not None else runs
                ends = np.cumsum([0] + [len(h) for h in kept]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(a, b - a),
                        pa.array([xxhash.xxh3_128_digest(t) for t in part], pa.binary()),
                        pa.array([len(h) for h in runs], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).view(np.int64))),
                    ],
                    names=["key", "t", "n", "hs"],
                )

    return loose.mapInArrow(cut_runs, "key string, t binary, n int, hs array<long>")


def near_duplicate_reasons(train: DataFrame, test: DataFrame, key: str, text: str, k: int = 20, share: float = 0.8) -> DataFrame:
    """(key, reason) of training rows to leave out, by the first reason that holds.

    loose_exact: the loose text is a test text's.  covered: at least ``share`` of
    its runs stand anywhere in the test texts.  contains: at least ``share`` of
    one test text's runs stand in it.

    Training runs that the test texts lack are dropped by a bit filter before any
    shuffle.  A row that contains a test text has at least one of any n - s + 1 of
    its n runs (s being the share of them), so rows meet test texts only on the
    runs that are rarest in training: common runs bring no pairs.
    """
    items = cut(shingles(test, key, text, k).select(F.col("key").alias("item"), "t", F.col("n").alias("nb"), F.col("hs").alias("item_hs")))
    known = cut(items.select(F.explode("item_hs").alias("h")).distinct())
    bits = train.sparkSession.sparkContext.broadcast(KeyFilter.of(known, known.count()))
    rows = cut(shingles(train, key, text, k, bits))
    held = cut(rows.select("key", "n", F.explode("hs").alias("h")).join(known, "h", "left_semi"))
    exact = rows.join(items.select("t").distinct(), "t", "left_semi").select("key", F.lit(1).alias("o"))
    covered = held.groupBy("key").agg(F.count("*").alias("m"), F.first("n").alias("n")).where(F.col("m") >= share * F.col("n")).select("key", F.lit(2).alias("o"))
    uses = held.groupBy("h").agg(F.count("*").alias("uses"))
    of_item = items.select("item", "nb", F.explode("item_hs").alias("h")).join(uses, "h", "left")
    rarest = Window.partitionBy("item").orderBy(F.coalesce("uses", F.lit(0)), "h")
    met_on = of_item.withColumn("_r", F.row_number().over(rarest)).where(F.col("_r") <= F.col("nb") - F.ceil(F.lit(share) * F.col("nb") - 1e-9) + 1).where("uses is not null")
    pairs = held.select("key", "h").join(met_on.select("item", "h"), "h").select("key", "item").distinct()
    both = pairs.join(rows.select("key", "hs"), "key").join(items.select("item", "nb", "item_hs"), "item")
    contains = both.where(F.size(F.array_intersect("hs", "item_hs")) >= share * F.col("nb")).select("key", F.lit(3).alias("o")).distinct()
    best = exact.unionAll(covered).unionAll(contains).groupBy("key").agg(F.min("o").alias("o"))
    return best.select("key", F.element_at(F.array(F.lit("loose_exact"), F.lit("covered"), F.lit("contains")), F.col("o")).alias("reason"))


def _in_blocks(queries: DataFrame, key: str, value: str, most: int) -> Iterator[list[tuple]]:
    """The (key, value) rows of a query set, in blocks of about ``most`` rows, one in the driver at a time."""
    blocks = max(1, -(-queries.count() // most))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = [(r[0], r[1]) for r in part.select(key, value).toLocalIterator()]
        if rows:
            yield rows


def _top(scored: DataFrame | None, score: str, top: int, spark, schema: str) -> DataFrame:
    """The best ``top`` items of each query among the best of each batch."""
    if scored is None:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    w = Window.partitionBy("query").orderBy(F.desc(score), "item")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def gram_retrieval(queries: DataFrame, pool: DataFrame, key: str, text: str, n: int = 4, top: int = 3, block: int = QUERIES) -> DataFrame:
    """(query, item, shared, rank): pool rows with the most distinct n-grams in common; ties go to the smaller id.

    The queries are a stated set; an inverted index of them is shipped block by
    block, and the best of each batch of pool rows are found where the rows are.
    No gram is shuffled, so a gram that a third of the rows have costs no task more.
    """
    schema, out = "query string, item string, shared long", None
    for rows in _in_blocks(queries.where(F.col(text).isNotNull()), key, text, block):
        names = np.array([str(i) for i, _ in rows], dtype=object)
        grams = [distinct_sorted(h) for h in runs_by_text([t for _, t in rows], n)]
        owner = np.repeat(np.arange(len(rows)), [len(h) for h in grams])
        h = np.concatenate(grams)
        order = np.argsort(h, kind="stable")
        shipped = queries.sparkSession.sparkContext.broadcast((names, h[order], owner[order]))

        def scan(batches, shipped=shipped):
            names, known, owner = shipped.value
            for batch in batches:
                items, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in batches_by_size(texts, 20_000):
                    at = [distinct_sorted(h) for h in runs_by_text(texts[a:b], n)]
                    row = np.repeat(np.arange(len(at)), [len(h) for h in at])
                    h = np.concatenate(at)
                    low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
                    size = high - low
                    if not size.any():
                        continue
                    place = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                    pair, shared = np.unique(owner[place] * (b - a) + np.repeat(row, size), return_counts=True)
                    query, item = pair // (b - a), np.array(items[a:b], dtype=object)[pair % (b - a)]
                    keep = names[query] != item
                    yield _best(names[query][keep], item[keep], shared[keep], top, pa.string(), pa.int64(), "shared")

        part = pool.select(F.col(key).cast("string").alias("item"), F.col(text).alias("t")).where("t is not null").mapInArrow(scan, schema)
        out = part if out is None else out.unionAll(part)
    return _top(out, "shared", top, queries.sparkSession, schema)


def _best(query: np.ndarray, item: np.ndarray, score: np.ndarray, top: int, kind: pa.DataType, number: pa.DataType, name: str) -> pa.RecordBatch:
    """The ``top`` best items of each query; ties go to the smaller item."""
    import pandas as pd

    best = pd.DataFrame({"query": query, "item": item, name: score}).sort_values(["query", name, "item"], ascending=[True, False, True]).groupby("query", sort=False).head(top)
    return pa.RecordBatch.from_arrays([pa.array(best["query"], kind), pa.array(best["item"], kind), pa.array(best[name], number)], names=["query", "item", name])


def agreement(rows: DataFrame, group: str, name: str, item: str, value: str, least: int = 1) -> DataFrame:
    """(group, a, b, both, same, rate): how often two names of a group give the same value to the same item."""
    left = rows.select(group, item, F.col(name).alias("a"), F.col(value).alias("va"))
    right = rows.select(group, item, F.col(name).alias("b"), F.col(value).alias("vb"))
    met = left.join(right, [group, item]).where("a < b")
    out = met.groupBy(group, "a", "b").agg(F.count("*").alias("both"), F.sum((F.col("va") == F.col("vb")).cast("bigint")).alias("same"))
    return out.where(F.col("both") >= least).withColumn("rate", F.round(F.col("same") / F.col("both"), 9))


def within_ranges(points: DataFrame, ranges: DataFrame, group: str, at: str, low: str, high: str, width: int = 64) -> DataFrame:
    """Points inside [low, high) of a range of their group: an equi-join on buckets of ``width`` that the range touches."""
    spread = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.greatest(F.col(high) - 1, F.col(low))) / width))))
    return points.withColumn("_b", F.floor(F.col(at) / width)).join(spread, [group, "_b"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_b")


def nearest(vectors: DataFrame, key: str, vector: str, every: int = 50, top: int = 5, block: int = QUERIES) -> DataFrame:
    """(query, item, cosine, rank): the ``top`` most similar vectors of every row whose id is divisible by ``every``.

    The queries are shipped in blocks of bounded size, each met with all vectors
    by matrix products; only the best of each batch leave it.  Null vectors have none.
    """
    schema, out = "query long, item long, cosine double", None
    rows = vectors.select(F.col(key).cast("long").alias("item"), F.col(vector).alias("v")).where("item is not null and v is not null")
    for queries in _in_blocks(rows.where(F.col("item") % every == 0), "item", "v", block):
        ids, m = np.array([i for i, _ in queries], np.int64), np.array([v for _, v in queries], np.float64)
        shipped = vectors.sparkSession.sparkContext.broadcast((ids, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)))

        def scan(batches, shipped=shipped):
            ids, m = shipped.value
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    keys = batch.column(0).slice(at, 2000).to_numpy()
                    x = batch.column(1).slice(at, 2000).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)
                    s = m @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                    s[ids[:, None] == keys[None, :]] = -np.inf
                    # Ties at the last place must all stay until ids decide.
                    least = np.partition(s, max(0, s.shape[1] - top), axis=1)[:, max(0, s.shape[1] - top)]
                    q, i = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                    yield _best(ids[q], keys[i], s[q, i], top, pa.int64(), pa.float64(), "cosine")

        part = rows.mapInArrow(scan, schema)
        out = part if out is None else out.unionAll(part)
    return _top(out, "cosine", top, vectors.sparkSession, schema)
