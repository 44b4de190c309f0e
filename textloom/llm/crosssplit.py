"""Problem 3: records of evaluation splits that also stand, exactly or almost, in training.

1. Every record's bare text becomes winnowing fingerprints: of each ``window``
   successive hashes of ``SEED``-character runs the least is selected.  The window
   follows from the number of distinct ``K``-character runs (``window_of``): it is
   so small that a pair of the similarity has a stretch of common runs that
   yields a fingerprint selected in both, short texts included.  Equal bare texts
   form one class.
2. Classes of the two sides are joined on (fingerprint, shared code), all pairs
   of every fingerprint.  Training fingerprints that evaluation hasn't are left out
   by a bit filter of bounded size (one kept by chance joins with nothing).
   Fingerprints that a sample shows to be heavy are joined in tiles of about
   ``TILE`` classes a side, so that no task gets a whole one.
3. Joined pairs whose sizes or one-bit min-hash sketches rule the similarity out
   (beyond five deviations, those of small sets included) are left, and so are
   pairs whose parity bitmaps differ in more bits than their sets may.  The others
   are compared by text: the share of common ``K``-character runs decides, and of
   linked pairs shared fingerprints are chained collinearly and extended by
   alignment for the coverage.

Null texts and bare texts under ``LEAST_CHARS`` take no part.  Records delivered
again under one id count once; if their texts differ, each text counts.  Null or
empty ``tables`` share no code with anything.
"""

from __future__ import annotations

import bisect
import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.forms import bare, batches_by_size, mix, run_hashes, runs_by_text
from textloom.functions.sketches import OnePermutation, distinct_sorted, winnowed
from textloom.operators.keyfilter import KeyFilter
from textloom.session import cut, table

K, SIMILARITY, LEAST_CHARS = 5, 0.6, 20
SEED, WINDOW = 9, 12
TILE, SAMPLE, HEAVY = 1024, 64, 64
COPIES, CACHED = 64, 2000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BINS, _PARITIES = 128, 512
_WORDS = _PARITIES // 64
_SKETCH = OnePermutation(_BINS)

_LIGHT = "id string, train boolean, codes array<string>, source string, exact long, content binary"
_FEATURES = "id string, content binary, train_codes array<long>, eval_codes array<long>, runs int, s0 long, s1 long, parity array<long>, seeds array<long>"


def _plain(texts: list[str]) -> tuple[list[int], list[str]]:
    """Positions and bare forms of the texts that are long enough."""
    plain = [bare(t) for t in texts]
    chosen = [i for i, t in enumerate(plain) if len(t) >= LEAST_CHARS]
    return chosen, [plain[i] for i in chosen]


def _contents(batches):
    for batch in batches:
        chosen, plain = _plain(batch.column(5).to_pylist())
        take = pa.array(chosen, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(5)), pa.array([xxhash.xxh3_128_digest(t) for t in plain], pa.binary())], names=_names(_LIGHT))


@functools.lru_cache(4096)
def window_of(n: int, similarity: float = SIMILARITY) -> int:
    """Winnowing window of a text with ``n`` distinct K-character runs.

    Texts of n and m <= n runs have at least o = s (n + m) / (1 + s) in common,
    so the smaller misses m - o of the other's.  Where two common runs that follow
    each other in one text don't do so in the other, at least K - 1 runs are
    missed, so the common runs stand in at most (m - o) / (K - 1) + 1 stretches and
    the longest has the average's length at least.  The window is the number of
    SEED-character runs in that stretch.  Two texts may have different windows:
    the smaller one selects all that the larger selects.  (Texts that repeat
    their own runs may break the count; they are the only ones to.)
    """
    n = min(n, 512)  # beyond, the stretch no longer grows
    least = n
    for m in range(max(1, math.ceil(similarity * n - 1e-9)), int(n / similarity + 1e-9) + 1):
        common = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
        least = min(least, math.ceil(common / ((min(n, m) - common) // (K - 1) + 1)))
    return max(1, min(WINDOW, least + K - SEED))


def fingerprints(runs: np.ndarray, seeds: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Distinct fingerprints of a text with the distinct hashes ``runs`` of its K-character runs and ``seeds`` of its SEED-character ones."""
    return np.unique(seeds[winnowed(seeds, window_of(len(runs), similarity))])


def parities(runs: list[np.ndarray]) -> np.ndarray:
    """For each set the parity of its number of hashes in each of _PARITIES ranges, packed (sets x _WORDS).

    Each hash that only one of two sets has flips one bit, so the exclusive-or
    never has more bits than the sets differ in.
    """
    of = np.repeat(np.arange(len(runs)), [len(h) for h in runs])
    at = (np.concatenate(runs) * _STEP >> np.uint64(64 - _PARITIES.bit_length() + 1)).astype(np.intp)
    odd = (np.bincount(of * _PARITIES + at, minlength=len(runs) * _PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(runs), _PARITIES), axis=1, bitorder="little").view(np.uint64)


def _features(similarity: float):
    """From rows (id, content, train_codes, eval_codes, text)."""

    def run(batches):
        for batch in batches:
            contents, texts = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            for a, b in batches_by_size(texts, 400_000):
                chosen, plain = _plain(texts[a:b])
                own = [i for i, t in zip(chosen, plain) if xxhash.xxh3_128_digest(t) == contents[a + i]]
                if not own:
                    continue
                if len(own) < len(chosen):  # texts under one id that only their 64-bit hash has in common
                    plain = [t for i, t in zip(chosen, plain) if i in set(own)]
                take = pa.array([a + i for i in own], pa.int64())
                runs = [distinct_sorted(h) for h in runs_by_text(plain, K)]
                bits = _SKETCH.bits(runs).view(np.int64)
                seeds = [fingerprints(r, h, similarity) for r, h in zip(runs, runs_by_text(plain, SEED))]
                ends = np.cumsum([0] + [len(s) for s in seeds]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).take(take) for i in range(4)),
                        pa.array([len(h) for h in runs], pa.int32()),
                        pa.array(bits[:, 0]),
                        pa.array(bits[:, 1]),
                        pa.FixedSizeListArray.from_arrays(pa.array(parities(runs).ravel().view(np.int64)), _WORDS).cast(pa.list_(pa.int64())),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(seeds).view(np.int64))),
                    ],
                    names=_names(_FEATURES),
                )

    return run


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _keys(batch: pa.RecordBatch, codes: str):
    """(row numbers, keys) of all fingerprints under all of the named codes of a batch of classes; none comes twice."""
    seeds, codes = batch.column("seeds"), batch.column(codes)
    values = seeds.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    row = np.repeat(np.arange(len(seeds)), np.diff(seeds.offsets.to_numpy()))
    code = codes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    number = np.diff(codes.offsets.to_numpy())
    code_first = np.cumsum(number) - number
    times = number[row]
    which = np.repeat(np.arange(len(row)), times)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    c = code[code_first[row[which]] + nth]
    return row[which], mix((values[which] * np.uint64(3)) ^ (c * _STEP))


def _postings(classes: DataFrame, codes: str, known=None, sample: bool = False) -> DataFrame:
    """(key, cls, size, s0, s1): keys of the fingerprints under each of the named codes.

    ``size`` is the number of runs, ``s0`` and ``s1`` are the first words of the
    sketch.  With ``known`` only the keys that it holds remain, of a sample one
    key and class of SAMPLE by hash.
    """

    def emit(batches):
        for batch in batches:
            cls, runs, s0, s1 = (batch.column(c).to_numpy() for c in ("cls", "runs", "s0", "s1"))
            row, key = _keys(batch, codes)
            keep = known.value.holds(key) if known is not None else np.ones(len(row), bool)
            if sample:
                keep &= mix(key ^ (cls[row].view(np.uint64) * _STEP)) % np.uint64(SAMPLE) == 0
            row, key = row[keep], key[keep]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(x[row]) for x in (cls, runs, s0, s1))], names=["key", "cls", "size", "s0", "s1"])

    return classes.where(F.size(codes) > 0).select("cls", "runs", "s0", "s1", "seeds", codes).mapInArrow(emit, "key long, cls long, size int, s0 long, s1 long")


def _possible(t_size: Column, e_size: Column, apart: Column, bits: int, similarity: float) -> Column:
    """Sizes and the number of different sketch bits allow the similarity, within five deviations.

    Bins differ as often as the sets do, give or take what a sample of the smaller
    set's size varies; of the differing ones half have another bit.
    """
    p, small = (1 - similarity) / 2, F.least(t_size, e_size)
    spread = F.sqrt(bits * p * (1 - p) + (bits / 2) ** 2 * similarity * (1 - similarity) / small)
    return (small >= similarity * F.greatest(t_size, e_size)) & (apart <= bits * p + 5 * spread)


def _apart(*pairs: tuple[Column, Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, [F.bit_count(x.bitwiseXOR(y)) for x, y in pairs])


def _heavy(classes: DataFrame, known) -> DataFrame:
    """(key, at, ae): tiles of each side for the keys that a sample shows to be large on both or either."""
    sides = [_postings(classes, codes, known, sample=True).select("key", F.lit(n).alias("t")) for codes, n in (("train_codes", 1), ("eval_codes", 0))]
    counts = sides[0].unionAll(sides[1]).groupBy("key").agg(F.sum("t").alias("nt"), F.sum(1 - F.col("t")).alias("ne"))
    tiles = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) * (SAMPLE / TILE)).cast("int"))
    return cut(counts.where(F.greatest("nt", "ne") >= HEAVY).select("key", tiles("nt").alias("at"), tiles("ne").alias("ae")))


def candidate_pairs(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct (t, e) class pairs that share a fingerprint under a shared code and may be similar."""
    keys = classes.agg(F.sum(F.size("seeds").cast("long") * F.size("eval_codes"))).first()[0] or 0
    known = classes.sparkSession.sparkContext.broadcast(KeyFilter.of(_postings(classes, "eval_codes").select("key"), keys))
    heavy = _heavy(classes, known)

    def side(name: str, codes: str) -> DataFrame:
        """Postings of one side; those of a heavy key have their own tile and meet all tiles of the other side."""
        own, other = ("at", "ae") if name == "t" else ("ae", "at")
        rows = _postings(classes, codes, known).join(heavy, "key", "left")
        own_tile = F.when(F.col(own).isNull(), 0).otherwise(F.pmod(F.xxhash64("cls"), F.col(own)).cast("int"))
        every = F.explode(F.when(F.col(other).isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(other) - 1)))
        rows = rows.withColumn("own", own_tile).withColumn("other", every)
        i, j = ("own", "other") if name == "t" else ("other", "own")
        return rows.select("key", F.col(i).alias("i"), F.col(j).alias("j"), *[F.col(c).alias(f"{name}_{c}") for c in ("cls", "size", "s0", "s1")])

    apart = _apart((F.col("t_s0"), F.col("e_s0")), (F.col("t_s1"), F.col("e_s1")))
    met = side("t", "train_codes").join(side("e", "eval_codes"), ["key", "i", "j"]).where(_possible(F.col("t_size"), F.col("e_size"), apart, 128, similarity))
    return met.select(F.col("t_cls").alias("t"), F.col("e_cls").alias("e")).where("t <> e").distinct()


def shared(s: np.ndarray, t: np.ndarray) -> float:
    """Common share of two distinct, sorted run sets."""
    small, large = (s, t) if len(s) <= len(t) else (t, s)
    if not len(small):
        return 0.0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return both / (len(s) + len(t) - both)


def aligned(a: str, b: str) -> tuple[float, int]:
    """(similarity of the run sets, characters of ``a`` and ``b`` matched along the best collinear chain)."""
    s, t = distinct_sorted(run_hashes(a, K)), distinct_sorted(run_hashes(b, K))
    return shared(s, t), matched_chars(a, b, min(window_of(len(s)), window_of(len(t))))


def matched_chars(a: str, b: str, window: int = WINDOW) -> int:
    """Characters matched along the best collinear chain of common winnowed runs, each extended to both sides."""
    if a == b:
        return len(a)
    p, q = run_hashes(a, SEED), run_hashes(b, SEED)
    at = {}
    for i in winnowed(q, window).tolist():
        at.setdefault(int(q[i]), []).append(i)
    seeds = [(i, j) for i in winnowed(p, window).tolist() for j in at.get(int(p[i]), ())]
    # Longest chain increasing in both texts, by patience sorting on (i up, j down).
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(seeds)
    order = sorted(range(len(seeds)), key=lambda k: (seeds[k][0], -seeds[k][1]))
    for k in order:
        pos = bisect.bisect_left(tails, seeds[k][1])
        back[k] = ends[pos - 1] if pos else -1
        if pos == len(tails):
            tails.append(seeds[k][1])
            ends.append(k)
        else:
            tails[pos], ends[pos] = seeds[k][1], k
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(seeds[k])
        k = back[k]
    matched, ai, bi = 0, 0, 0
    for i, j in reversed(chain):  # extend each seed to both sides, never over what is matched already
        if i < ai or j < bi:
            continue
        while i > ai and j > bi and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        m, n = i, j
        while m < len(a) and n < len(b) and a[m] == b[n]:
            m, n = m + 1, n + 1
        matched += m - i
        ai, bi = m, n
    return matched


_LINKS = "t long, e long, similarity double, t_coverage double, e_coverage double"


def _check(similarity: float):
    def run(batches):
        known: dict[bytes, tuple[str, np.ndarray]] = {}  # a text of a large group comes often

        def plain_of(text: str, content: bytes) -> tuple[str, np.ndarray] | None:
            """Bare form and runs; None if another text stands under the representative's id."""
            if content not in known:
                plain = bare(text)
                if xxhash.xxh3_128_digest(plain) != content:
                    return None
                if len(known) >= CACHED:
                    known.clear()
                known[content] = plain, distinct_sorted(run_hashes(plain, K))
            return known[content]

        for batch in batches:
            t, e, x, y, tc, ec = (batch.column(i).to_pylist() for i in range(6))
            kept = []
            for i in range(len(t)):
                one, two = plain_of(x[i], tc[i]), plain_of(y[i], ec[i])
                if one is None or two is None:
                    continue
                (a, s), (b, u) = one, two
                share = shared(s, u)
                if share >= similarity:
                    matched = matched_chars(a, b, min(window_of(len(s), similarity), window_of(len(u), similarity)))
                    kept.append((t[i], e[i], share, matched / len(a), matched / len(b)))
            cols = list(zip(*kept)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, [pa.int64()] * 2 + [pa.float64()] * 3)], names=[f.split()[0] for f in _LINKS.split(", ")])

    return run


def _maybe(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose id may be among the wanted ones; a bit filter leaves most others out, so that their texts aren't shuffled."""
    wanted = wanted.select(F.xxhash64("id"))
    known = rows.sparkSession.sparkContext.broadcast(KeyFilter.of(wanted, wanted.count()))

    @F.pandas_udf("boolean")
    def held(key: pd.Series) -> pd.Series:
        return pd.Series(known.value.holds(key.to_numpy().view(np.uint64)))

    return rows.where(held(F.xxhash64("id")))


def overlaps(records: DataFrame, *, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, links): records with their class and side, and linked (train class, eval class) pairs.

    A class standing on both sides is linked with itself at similarity 1.
    """
    base = records.select(
        F.col("id").cast("string").alias("id"),
        (F.col("split") == "train").alias("train"),
        F.coalesce(F.array_distinct(F.expr("filter(tables, x -> x is not null)")), F.array().cast("array<string>")).alias("codes"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64("text").alias("exact"),
        F.col("text").alias("text"),
    ).where("text is not null and id is not null and (split in ('train', 'dev', 'eval'))")
    found = cut(base.mapInArrow(_contents, _LIGHT))
    coded = found.select("content", "train", F.explode("codes").alias("code")).distinct()
    codes = coded.groupBy("content").agg(
        F.collect_list(F.when(F.col("train"), F.xxhash64("code"))).alias("train_codes"), F.collect_list(F.when(~F.col("train"), F.xxhash64("code"))).alias("eval_codes")
    )
    reps = found.groupBy("content").agg(F.min(F.struct("id", "exact")).alias("first")).join(codes, "content").select("first.*", "content", "train_codes", "eval_codes")
    # Texts go to their class before they become features, as these are twice the size.
    drawn = base.select("id", "exact", "text").join(reps, ["id", "exact"]).dropDuplicates(["id", "exact", "content"])
    featured = drawn.select("id", "content", "train_codes", "eval_codes", "text").mapInArrow(_features(similarity), _FEATURES)
    classes = cut(featured.withColumn("cls", F.monotonically_increasing_id()))
    members = found.join(classes.select("content", "cls"), "content").drop("content", "exact").distinct()

    pairs = candidate_pairs(classes, similarity)

    def side(name: str, *columns: str) -> DataFrame:
        return classes.select(F.col("cls").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    apart = _apart(*[(F.col("t_parity")[w], F.col("e_parity")[w]) for w in range(_WORDS)])
    most = (1 - similarity) / (1 + similarity) * (F.col("t_runs") + F.col("e_runs"))
    near = pairs.join(side("t", "runs", "parity"), "t").join(side("e", "runs", "parity"), "e").where(apart <= most + 1e-9).select("t", "e")
    near = cut(near.join(side("t", "id", "content"), "t").join(side("e", "id", "content"), "e"))
    # The texts that are compared, fetched once.
    wanted = near.select(F.explode(F.array("t_id", "e_id")).alias("id")).distinct()
    text = cut(_maybe(base.select("id", "text"), wanted).join(wanted, "id", "left_semi").distinct())
    one = near.join(text.select(F.col("id").alias("t_id"), F.col("text").alias("x")), "t_id")
    two = one.join(text.select(F.col("id").alias("e_id"), F.col("text").alias("y")), "e_id")
    across = two.select("t", "e", "x", "y", "t_content", "e_content").mapInArrow(_check(similarity), _LINKS)
    within = classes.where(F.arrays_overlap("train_codes", "eval_codes")).select(
        F.col("cls").alias("t"), F.col("cls").alias("e"), F.lit(1.0).alias("similarity"), F.lit(1.0).alias("t_coverage"), F.lit(1.0).alias("e_coverage")
    )
    return members, across.unionAll(within)


def record_pairs(members: DataFrame, links: DataFrame, copies: int = COPIES) -> DataFrame:
    """Pairs (train id, eval id) that share a code, with similarity and coverage.

    A class with more than ``copies`` records on a side is drawn by its smallest
    id per code on that side; each of its other records is paired, for every class
    that its own is linked to, with that class's smallest ids per code.  Every
    record and every link stays in the result.
    """
    links = cut(links)
    linked = links.select(F.explode(F.array("t", "e")).alias("cls")).distinct()
    members = cut(members.join(linked, "cls", "left_semi"))
    per_code = members.select("cls", "id", "train", F.explode("codes").alias("code"))
    least = per_code.groupBy("cls", "train", "code").agg(F.min("id").alias("id")).select("cls", "train", "id").distinct().withColumn("least", F.lit(True))
    sizes = members.groupBy("cls", "train").agg(F.count("*").alias("n"))
    known = cut(members.join(sizes, ["cls", "train"]).join(least, ["cls", "train", "id"], "left").withColumn("drawn", (F.col("n") <= copies) | F.coalesce("least", F.lit(False))))
    t = known.where("train").select(F.col("cls").alias("t"), F.col("id").alias("t_id"), F.col("codes").alias("t_codes"), F.col("source").alias("t_source"), F.col("drawn").alias("t_drawn"), F.coalesce("least", F.lit(False)).alias("t_least"))
    e = known.where("not train").select(F.col("cls").alias("e"), F.col("id").alias("e_id"), F.col("codes").alias("e_codes"), F.col("source").alias("e_source"), F.col("drawn").alias("e_drawn"), F.coalesce("least", F.lit(False)).alias("e_least"))

    def meet(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        return links.join(left, "t").join(right, "e").where(F.arrays_overlap("t_codes", "e_codes"))

    drawn = meet(links, t.where("t_drawn"), e.where("e_drawn"))
    star = meet(links, t.where("t_least"), e.where("not e_drawn")).unionAll(meet(links, t.where("not t_drawn"), e.where("e_least")))
    return drawn.unionAll(star).select("t_id", "e_id", "t_source", "e_source", "similarity", "t_coverage", "e_coverage").dropDuplicates(["t_id", "e_id"])


def p3_found(spark, sf_dir) -> DataFrame:
    pairs = record_pairs(*overlaps(table(spark, sf_dir, "records")))
    return pairs.select(F.least("t_id", "e_id").alias("id_a"), F.greatest("t_id", "e_id").alias("id_b"))


def pair_counts(members: DataFrame, links: DataFrame, splits: DataFrame) -> DataFrame:
    """Per split and source of the evaluation record: all pairs that share a code, their records on each side, mean coverage.

    Counted without listing the pairs: records of one class, codes and source are
    one group with a size, and groups meet where their classes are linked.  An id
    that stands in several rows (other texts, codes or splits) is a group of its
    own, so that it counts once.  splits: (id, split) of the evaluation records.
    """
    codes = F.array_sort("codes").alias("codes")
    rows = members.where("train").select("cls", "id", codes, F.lit(None).cast("string").alias("split"), F.lit(None).cast("string").alias("source"), F.lit(True).alias("train"))
    rows = cut(rows.unionAll(members.where("not train").join(splits, "id").select("cls", "id", codes, "split", "source", F.lit(False).alias("train"))).distinct())
    again = rows.groupBy("train", "id").agg(F.count("*").alias("_n")).where("_n > 1").select("train", "id", F.col("id").alias("own"))
    groups = rows.join(again, ["train", "id"], "left").groupBy("train", "cls", "codes", "split", "source", "own").agg(F.count("*").alias("n"))
    number = F.when(F.col("own").isNull(), F.to_json(F.struct("cls", "codes", "split", "source"))).otherwise(F.concat(F.lit("="), "own"))
    groups = cut(groups.withColumn("g", number))
    t = groups.where("train").select(F.col("cls").alias("t"), F.col("codes").alias("t_codes"), F.col("g").alias("t_g"), F.col("n").alias("t_n"))
    e = groups.where("not train").select(F.col("cls").alias("e"), F.col("codes").alias("e_codes"), F.col("g").alias("e_g"), F.col("n").alias("e_n"), "split", "source")
    met = links.join(t, "t").join(e, "e").where(F.arrays_overlap("t_codes", "e_codes"))
    by = ["split", "source"]
    met = cut(met.groupBy(*by, "t_g", "e_g", "t_n", "e_n").agg(F.max("e_coverage").alias("c")))
    pairs = met.groupBy(*by).agg(F.sum(F.col("t_n") * F.col("e_n")).alias("pairs"), F.sum(F.col("c") * F.col("t_n") * F.col("e_n")).alias("c"))
    for side, name in (("e", "eval_records"), ("t", "train_records")):
        each = met.select(*by, f"{side}_g", f"{side}_n").distinct().groupBy(*by).agg(F.sum(f"{side}_n").alias(name))
        each = each.select(F.col("split").alias("_x"), F.col("source").alias("_y"), name)
        pairs = pairs.join(each, F.col("split").eqNullSafe(F.col("_x")) & F.col("source").eqNullSafe(F.col("_y"))).drop("_x", "_y")
    return pairs.select(*by, "pairs", "eval_records", "train_records", F.round(F.col("c") / F.col("pairs"), 4).alias("mean_coverage"))


def p3_report(spark, sf_dir) -> DataFrame:
    """Overlaps per split and source of the evaluation record: pairs, records, coverage."""
    records = table(spark, sf_dir, "records")
    members, links = overlaps(records)
    splits = records.where("split in ('dev', 'eval')").select(F.col("id").cast("string").alias("id"), "split").distinct()
    return pair_counts(members, cut(links), splits)
