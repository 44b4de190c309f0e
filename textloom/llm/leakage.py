"""Problem 1: held-out passages inside training text.

The test items are put in their bare form and into a generalised suffix
automaton.  Training text streams through it while the length of the longest
suffix known to the automaton is tracked; wherever that length reaches
``min_run`` the items holding that run are reported.  Positions that cannot
belong to such a run are stepped over: a run of ``min_run`` characters covers a
whole ``ANCHOR``-character piece starting at a multiple of ``min_run - ANCHOR + 1``,
so only neighbourhoods of pieces known to the items are streamed.  No run is lost
by that.

Up to ``block_chars`` characters of items make one automaton, which is broadcast.
More items are cut into blocks of that size, and the training text is still read
once: a bit filter of bounded size picks the neighbourhoods, a join on the exact
pieces tells each one's blocks, and the automaton of a block is built where its
neighbourhoods are streamed, in groups of about ``PIECES`` of them.

Null texts and null or short items have no runs.  Equal items under two ids
both count.  Extra columns of either table are ignored; the tables' own columns
never clash as only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from textloom.functions.forms import bare, bare_with_offsets, run_hashes, runs_by_text
from textloom.operators.keyfilter import KeyFilter
from textloom.session import cut, table

ANCHOR = 8
MIN_RUN = 20
BLOCK_CHARS = 300_000
PIECES = 20_000


def around(anchors: list[int], min_run: int, n: int) -> list[tuple[int, int]]:
    """Stretches of a text of ``n`` characters that hold all runs with a piece at one of the positions."""
    stride = min_run - ANCHOR + 1
    found: list[list[int]] = []
    for p in anchors:
        if found and p - stride < found[-1][1]:
            found[-1][1] = p + min_run + 1
        else:
            found.append([max(0, p - stride + 1), p + min_run + 1])
    return [(a, min(b, n)) for a, b in found]


class SuffixAutomaton:
    """Generalised suffix automaton of many strings, as flat arrays once frozen."""

    def __init__(self, items: list[str], min_run: int) -> None:
        nexts: list[dict[str, int]] = [{}]
        link, length = [-1], [0]

        def split(p: int, c: str, q: int) -> int:
            """State of exactly length[p] + 1 characters, taken out of q."""
            twin = len(nexts)
            nexts.append(dict(nexts[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = twin
            while p >= 0 and nexts[p].get(c) == q:
                nexts[p][c] = twin
                p = link[p]
            return twin

        for item in items:
            last = 0
            for c in item:
                q = nexts[last].get(c)
                if q is not None:
                    last = q if length[q] == length[last] + 1 else split(last, c, q)
                    continue
                new = len(nexts)
                nexts.append({})
                link.append(0)
                length.append(length[last] + 1)
                p = last
                while p >= 0 and c not in nexts[p]:
                    nexts[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nexts[p][c]
                    link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
                last = new

        # Items by state: only for the shortest states that hold a run of min_run.
        held: dict[int, list[int]] = {}
        for number, item in enumerate(items):
            state = 0
            for c in item:
                state = nexts[state][c]
                up = state
                while length[link[up]] >= min_run if up else False:
                    up = link[up]
                if length[up] >= min_run and (not held.get(up) or held[up][-1] != number):
                    held.setdefault(up, []).append(number)
        self.keys = np.fromiter(((s << 21) | ord(c) for s, d in enumerate(nexts) for c in d), np.int64)
        self.targets = np.fromiter((t for d in nexts for t in d.values()), np.int32)
        self.link = np.array(link, np.int32)
        self.length = np.array(length, np.int32)
        self.held = held
        self.anchors = {i[j : j + ANCHOR] for i in items if len(i) >= min_run for j in range(len(i) - ANCHOR + 1)}
        self.min_run = min_run

    def ready(self) -> "SuffixAutomaton":
        """Build the look-up tables that are not shipped; once per worker."""
        if not hasattr(self, "step"):
            self.step = dict(zip(self.keys.tolist(), self.targets.tolist()))
            self.up, self.size = self.link.tolist(), self.length.tolist()
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("step", "up", "size")}

    def neighbourhoods(self, text: str) -> list[tuple[int, int]]:
        """Stretches of the text that may hold a run of min_run known characters."""
        known, stride = self.anchors, self.min_run - ANCHOR + 1
        return around([p for p in range(0, len(text) - ANCHOR + 1, stride) if text[p : p + ANCHOR] in known], self.min_run, len(text))

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, item) of each maximal stretch of the text in which each position ends a run shared with the item."""
        self.ready()
        step, up, size, least, held = self.step, self.up, self.size, self.min_run, self.held
        for first, last in self.neighbourhoods(text):
            state = have = 0
            open_: dict[int, list[int]] = {}
            for i in range(first, last):
                code = ord(text[i])
                to = step.get((state << 21) | code)
                while to is None and state:
                    state = up[state]
                    have = size[state]
                    to = step.get((state << 21) | code)
                if to is None:
                    continue
                state = to
                have += 1
                if have >= least:
                    top = state
                    while size[up[top]] >= least:
                        top = up[top]
                    for item in held[top]:
                        span = open_.get(item)
                        if span and span[1] == i:
                            span[1] = i + 1
                        else:
                            if span:
                                yield span[0], span[1], item
                            open_[item] = [i - least + 1, i + 1]
            for item, span in open_.items():
                yield span[0], span[1], item


_SPANS = "key long, source string, item_id string, bare_start int, bare_end int, bare_chars int"
_FOUND = "key long, source string, content binary, bare_start int, bare_end int, bare_chars int"
_PIECE = "key long, source string, first int, piece string, anchors array<long>, bare_chars int"


def _record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[n for n, _ in fields])


def _bare_items(items: DataFrame, id_col: str, text_col: str, min_run: int) -> tuple[DataFrame, DataFrame]:
    """(ids, texts): the id and content hash of each item, and each distinct bare form once."""

    def plain(batches):
        for batch in batches:
            rows = [(i, bare(t)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield _record_batch([(i, xxhash.xxh3_128_digest(t), t) for i, t in rows if len(t) >= min_run], "id string, content binary, item string")

    named = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("item")).where("item is not null and id is not null")
    known = cut(named.mapInArrow(plain, "id string, content binary, item string"))
    return known.select("id", "content").distinct(), known.groupBy("content").agg(F.first("item").alias("item"))


def _streamed(rows: DataFrame, texts: list[tuple[bytes, str]], min_run: int) -> DataFrame:
    """Stretches found by one broadcast automaton of all items."""
    texts = sorted(texts, key=lambda x: x[1])
    shipped = rows.sparkSession.sparkContext.broadcast((SuffixAutomaton([t for _, t in texts], min_run), [bytes(c) for c, _ in texts]))

    def scan(batches):
        known, contents = shipped.value
        for batch in batches:
            out: list[tuple] = []
            for k, s, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                plain = bare(t)
                out.extend((k, s, contents[item], a, b, len(plain)) for a, b, item in known.matches(plain))
            if out:
                yield _record_batch(out, _FOUND)

    return rows.mapInArrow(scan, _FOUND)


def _partitioned(rows: DataFrame, texts: DataFrame, blocks: int, chars: int, min_run: int) -> DataFrame:
    """Stretches found by the automata of blocks of items, each where its neighbourhoods are; one pass over ``rows``."""
    texts = cut(texts.withColumn("block", F.pmod(F.xxhash64("content"), F.lit(blocks)).cast("int")))

    def pieces_of(batches):
        for batch in batches:
            for block, h in zip(batch.column(1).to_pylist(), runs_by_text(batch.column(0).to_pylist(), ANCHOR)):
                h = np.unique(h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), block, np.int32))], names=["anchor", "block"])

    anchors = cut(texts.select("item", "block").mapInArrow(pieces_of, "anchor long, block int").distinct())
    shipped = rows.sparkSession.sparkContext.broadcast(KeyFilter.of(anchors.select("anchor"), chars))
    stride = min_run - ANCHOR + 1

    def scan(batches):
        known = shipped.value
        for batch in batches:
            out: list[tuple] = []
            for k, s, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                plain = bare(t)
                h = run_hashes(plain, ANCHOR)[::stride]
                held = np.flatnonzero(known.holds(h))
                if not len(held):
                    continue
                at, anchor = held * stride, h.view(np.int64)
                for a, b in around(at.tolist(), min_run, len(plain)):
                    inside = held[(at >= a) & (at < b)]
                    out.append((k, s, a, plain[a:b], np.unique(anchor[inside]).tolist(), len(plain)))
            if out:
                yield _record_batch(out, _PIECE)

    pieces = cut(rows.mapInArrow(scan, _PIECE))
    near = pieces.select("key", "first", F.explode("anchors").alias("anchor")).join(anchors, "anchor").select("key", "first", "block").distinct()
    met = cut(pieces.drop("anchors").join(near, ["key", "first"]))
    shares = cut(met.groupBy("block").agg(F.ceil(F.count("*") / PIECES).cast("int").alias("shares")))
    met = met.join(shares, "block").withColumn("share", F.pmod(F.xxhash64("key", "first"), F.col("shares")).cast("int")).drop("shares")
    spread = texts.join(shares, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

    def stream(items: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(items) and len(found):
            contents = list(items["content"])
            known = SuffixAutomaton(list(items["item"]), min_run)
            for k, s, first, piece, n in found[["key", "source", "first", "piece", "bare_chars"]].itertuples(index=False):
                out.extend((k, s, contents[item], first + a, first + b, n) for a, b, item in known.matches(piece))
        return pd.DataFrame(out, columns=[f.split()[0] for f in _FOUND.split(", ")])

    return spread.groupBy("block", "share").cogroup(met.groupBy("block", "share")).applyInPandas(stream, _FOUND)


def leaked_spans(
    docs: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    item_id: str = "nikl_id",
    item_text: str = "src",
    min_run: int = MIN_RUN,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document, item and stretch they share; offsets count in the document's bare form.

    The documents are read once, however many items there are; what is broadcast
    and what a task holds is bounded by ``block_chars``.
    """
    if min_run < ANCHOR:
        raise ValueError(f"min_run must be at least {ANCHOR}")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")).where("text is not null")
    ids, texts = _bare_items(items, item_id, item_text, min_run)
    chars = int(texts.agg(F.sum(F.length("item"))).first()[0] or 0)
    if not chars:
        return docs.sparkSession.createDataFrame([], _SPANS)
    if chars <= block_chars:
        found = _streamed(rows, [(r["content"], r["item"]) for r in texts.toLocalIterator()], min_run)
    else:
        found = _partitioned(rows, texts, -(-chars // block_chars), chars, min_run)
    return found.join(ids.withColumnRenamed("id", "item_id"), "content").select("key", "source", "item_id", "bare_start", "bare_end", "bare_chars")


def leaked_items(spans: DataFrame) -> DataFrame:
    """Distinct documents and items, with the longest shared run and the covered characters."""
    return spans.groupBy("key", "item_id").agg(
        F.first("source").alias("source"),
        F.max(F.col("bare_end") - F.col("bare_start")).alias("longest_run"),
        F.sum(F.col("bare_end") - F.col("bare_start")).alias("shared_chars"),
    )


def without_leaks(
    docs: DataFrame,
    spans: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    max_run: int = MIN_RUN,
    max_coverage: float = 0.5,
) -> DataFrame:
    """Every document with its leaked stretches of at least ``max_run`` characters cut out.

    A document of whose bare characters more than ``max_coverage`` leaked is
    dropped as a whole: its ``clean_text`` is null and ``verdict`` is ``drop``.
    Other verdicts are ``cut`` and ``keep``.  Null texts are kept as they are.
    Overlapping stretches are merged before they are counted or cut.
    """
    stretch = F.struct(F.col("bare_start").alias("a"), F.col("bare_end").alias("b"))
    each = spans.where(F.col("bare_end") - F.col("bare_start") >= max_run).groupBy("key").agg(F.array_sort(F.collect_set(stretch)).alias("spans"))
    joined = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).join(each, F.col("_key") == F.col("key"), "left").select("_key", "_text", "spans")

    def clean(batches):
        for batch in batches:
            out: list[tuple] = []
            for k, t, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if t is None or not found:
                    out.append((k, "keep", 0, 0.0, t))
                    continue
                flat: list[list[int]] = []
                for s in found:  # sorted: overlapping stretches become one
                    if flat and s["a"] <= flat[-1][1]:
                        flat[-1][1] = max(flat[-1][1], s["b"])
                    else:
                        flat.append([s["a"], s["b"]])
                leaked, plain = sum(b - a for a, b in flat), bare(t)
                coverage = round(leaked / len(plain), 6)
                if coverage > max_coverage:
                    out.append((k, "drop", leaked, coverage, None))
                    continue
                again, starts, ends = bare_with_offsets(t)
                cuts = [(starts[a], ends[b - 1]) for a, b in flat] if again == plain else [(0, len(t))]
                kept, at = [], 0
                for a, b in cuts:
                    kept.append(t[at : max(at, a)])
                    at = max(at, b)
                out.append((k, "cut", leaked, coverage, "".join([*kept, t[at:]])))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, ty) for c, ty in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.string()))],
                names=["_key", "verdict", "leaked_chars", "coverage", "clean_text"],
            )

    done = joined.mapInArrow(clean, "_key long, verdict string, leaked_chars int, coverage double, clean_text string")
    return done.withColumnRenamed("_key", key)


def p1_found(spark, sf_dir) -> DataFrame:
    docs, items = _tables(spark, sf_dir)
    return leaked_spans(docs, items).select(F.col("key").alias("doc_id"), F.col("item_id").alias("nikl_id")).distinct()


def p1_clean(spark, sf_dir) -> DataFrame:
    docs, items = _tables(spark, sf_dir)
    return without_leaks(docs, leaked_spans(docs, items))


def p1_report(spark, sf_dir) -> DataFrame:
    """Leaked documents and items of each source."""
    docs, items = _tables(spark, sf_dir)
    pairs = leaked_items(leaked_spans(docs, items))
    return pairs.groupBy("source").agg(
        F.countDistinct("key").alias("documents"), F.countDistinct("item_id").alias("items"), F.max("longest_run").alias("longest_run")
    )


def _tables(spark, sf_dir):
    items = table(spark, sf_dir, "nikl_pairs").where("split = 'test'").select(F.col("id").alias("nikl_id"), "src")
    return table(spark, sf_dir, "documents"), items
