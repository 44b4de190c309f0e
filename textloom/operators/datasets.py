"""Building data sets: strata with quotas, whole-document samples, formula rows, evaluation sets, top-ups.

Random choices are hashes of a seed and the row's key; quotas are ranks by that
hash, so no set is filled row by row and every shortfall can be counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators import lines as L, noise as N
from textloom.operators.ranking import ordered_rank
from textloom.operators.sampling import hash_rank, largest_remainder
from textloom.session import cut

# Snippet buckets, shares overdrawn, noise levels.
SNIPPET_BUCKETS = ["snippet_1_4", "snippet_5_10", "snippet_11_20", "snippet_21_40", "sentence"]
MARGIN, SPARE = 0.15, 8
NOISE_LEVELS = (0.005, 0.01, 0.02)


def taken(rows: DataFrame, cell: list[str], quota: DataFrame, seed: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, report): in each cell the first ``quota`` rows by hash; the report has quota, got and short of every cell."""
    ranked = hash_rank(rows, cell, seed, key, "_nth").join(quota, cell)
    kept = ranked.where(F.col("_nth") <= F.col("quota")).drop("_nth", "quota")
    got = kept.groupBy(*cell).agg(F.count("*").alias("got"))
    report = quota.join(got, cell, "left").withColumn("got", F.coalesce("got", F.lit(0))).withColumn("short", F.col("quota") - F.col("got"))
    return kept, report


def equal_quotas(cells: DataFrame, total: int, key: str) -> DataFrame:
    """(key, quota): a total spread evenly over the cells, what remains over the first of them."""
    n, at = F.count("*").over(Window.partitionBy()), F.row_number().over(Window.partitionBy().orderBy(key))
    return cells.select(key, (F.floor(F.lit(total) / n) + (at <= F.lit(total) % n).cast("int")).cast("bigint").alias("quota"))


def ranked_quotas(tables: DataFrame, key: str, weight: str, head: int, head_quota: int, tail_quota: int) -> DataFrame:
    """(key, quota): the ``head`` heaviest tables have one quota, the others another."""
    at = F.row_number().over(Window.partitionBy().orderBy(F.desc(weight), key))
    return tables.select(key, F.when(at <= head, head_quota).otherwise(tail_quota).cast("bigint").alias("quota"))


def with_density(texts: DataFrame, span: str, seed: str, key: str = "id", text: str = "text") -> DataFrame:
    """Texts with foreign spans: (switch_density, natural, text).

    A text with Latin runs of its own stays as it is: up to two are light, more
    heavy.  Another gets one span (light) or three (heavy), by hash, each before a
    word of its own; a text of one word stays.
    """
    runs = T.latin_runs(text)
    density = F.when(F.col("_runs") > 2, "heavy").when(F.col("_runs") > 0, "light").when(T.uniform(seed, key) < 0.5, "heavy").otherwise("light")
    out = texts.withColumn("_runs", runs).withColumn("switch_density", density).withColumn("natural", F.col("_runs") > 0).drop("_runs")
    for n in range(3):  # a column each, so that no expression is worked out again and again
        more = ~F.col("natural") & (F.lit(n == 0) | (F.col("switch_density") == "heavy"))
        out = out.withColumn(text, F.when(more, N.spliced(text, F.lit(span), T.uniform(f"{seed}:{n}", key))).otherwise(F.col(text)))
    return out


_HOSTS = ["docs.example.org", "code.example.com", "papers.example.net", "data.example.edu", "wiki.example.io"]
_USERS = ["info", "j.doe", "lab-admin", "m_garcia", "support"]
_CARRIERS = ["See {} for the data.", "The code is at {}.", "Contact: {}", "Retrieved from {}.", "{}"]


def _pick(choices: list[str], u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in choices]), F.floor(u * len(choices)).cast("int") + 1)


def _digits(u: Column, low: int, high: int, width: int = 0) -> Column:
    number = (F.lit(low) + F.floor(u * (high - low + 1))).cast("bigint").cast("string")
    return F.lpad(number, width, "0") if width else number


def identifiers(spark, n: int, seed: str) -> DataFrame:
    """(id, kind, identifier, text): made-up page addresses, preprint numbers, document identifiers, mail addresses and book numbers in a carrier sentence."""
    rows = spark.range(n)
    u = lambda what: T.uniform(f"{seed}:{what}", "id")
    kind = F.when(u("kind") < 0.45, "url").when(u("kind") < 0.6, "arxiv").when(u("kind") < 0.75, "doi").when(u("kind") < 0.92, "email").otherwise("isbn")
    made = (
        F.when(kind == "url", F.concat(_pick(["https://", "http://", ""], u("a")), _pick(_HOSTS, u("b")), F.lit("/"), _digits(u("c"), 1, 9999)))
        .when(kind == "arxiv", F.concat(F.lit("arXiv:"), _digits(u("a"), 1501, 2512), F.lit("."), _digits(u("b"), 1, 29999, 5)))
        .when(kind == "doi", F.concat(F.lit("doi:10."), _digits(u("a"), 1000, 99999), F.lit("/"), _digits(u("b"), 100000, 9999999)))
        .when(kind == "email", F.concat(_pick(_USERS, u("a")), F.lit("@"), _pick(_HOSTS, u("b"))))
        .otherwise(F.concat(F.lit("ISBN 978-"), _digits(u("a"), 0, 9), F.lit("-"), _digits(u("b"), 100, 999), F.lit("-"), _digits(u("c"), 10000, 99999), F.lit("-"), _digits(u("d"), 0, 9)))
    )
    out = rows.select("id", kind.alias("kind"), made.alias("identifier"), _pick(_CARRIERS, u("carrier")).alias("_c"))
    return out.select("id", "kind", "identifier", F.replace("_c", F.lit("{}"), F.col("identifier")).alias("text"))


def whole_documents(rows: DataFrame, total: int, stratum: list[str], doc: str, key: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``quota`` and ``whole``, quotas): for each stratum documents in hash order until its quota and a margin are full.

    Quotas are in proportion to the rows.  Documents are taken whole; of the one
    that would overfill, a contiguous run in the order of ``key`` from a seeded place.
    """
    named = rows.withColumn("_s", F.concat_ws("", *stratum))
    sizes = cut(named.groupBy("_s", doc).agg(F.count("*").alias("size")))
    quotas = largest_remainder(sizes.groupBy("_s").agg(F.sum("size").alias("_w")), total, "_w", "_s").select("_s", F.col("seats").alias("quota"))
    want = F.col("quota") + F.floor(F.col("quota") * MARGIN).cast("bigint") + SPARE
    ordered = sizes.withColumn("_u", T.uniform(seed, doc))
    # The documents of a stratum are few against its rows; their running sizes go by ranges all the same.
    before = ordered_rank(ordered, ["_s"], ["_u", doc], out="before", value="size")
    chosen = before.join(quotas.where("quota > 0"), "_s").withColumn("room", want - F.col("before")).where("room > 0")
    chosen = cut(chosen.select("_s", doc, "quota", (F.col("size") <= F.col("room")).alias("whole"), "size", "room", (F.floor(T.uniform(seed + ":run", doc) * (F.col("size") - F.col("room") + 1))).alias("start")))
    every = named.join(chosen.where("whole").select("_s", doc, "quota", "whole"), ["_s", doc])
    part = named.join(chosen.where("not whole"), ["_s", doc])
    run = ordered_rank(part, ["_s", doc], [key], out="_n").where((F.col("_n") > F.col("start")) & (F.col("_n") <= F.col("start") + F.col("room")))
    return every.unionByName(run.select(*every.columns)), quotas


def side_of(canon: str | Column) -> Column:
    """eval for a fifth of the formulas by hash of their canonical form, train for the others."""
    return F.when(F.pmod(F.conv(F.substring(F.sha1(T.c(canon)), 1, 8), 16, 10).cast("bigint"), F.lit(5)) == 0, "eval").otherwise("train")


def formula_rows(rows: DataFrame, canon: str, text: str, embedded: int, standalone: int, seed: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, report): each canonical formula once (its smallest key), on the side its hash says, with exact quotas of formulas in a carrier and alone."""
    first = rows.where(F.col(canon).isNotNull()).groupBy(canon).agg(F.min_by(F.struct(key, text), F.col(key)).alias("_r")).select(canon, "_r.*")
    kind = F.when(F.col(text) == F.col(canon), "standalone").otherwise("embedded")
    sided = first.withColumn("side", side_of(canon)).withColumn("kind", kind)
    quota = sided.select("side", "kind").distinct().withColumn("quota", F.when(F.col("kind") == "embedded", embedded).otherwise(standalone).cast("bigint"))
    return taken(sided, ["side", "kind"], quota, seed, key)


def mixed_grid(segments: DataFrame, sizes: list[int], seed: str, key: str, within: str | None = None) -> DataFrame:
    """(k, doc, segments): documents of k segments of different tables for each k; with ``within`` all of one of its groups (confusable tables)."""
    group = [within] if within else []
    ranked = hash_rank(segments, ["table_id", *group], seed, key, "_r")
    slot = F.row_number().over(Window.partitionBy("_r", *group).orderBy(T.uniform(seed, "table_id"), "table_id")) - 1
    placed = ranked.withColumn("_slot", slot).withColumn("k", F.explode(F.array(*[F.lit(k) for k in sizes]))).withColumn("_g", F.floor(F.col("_slot") / F.col("k")))
    docs = placed.groupBy("k", *group, "_r", "_g").agg(F.array_sort(F.collect_list(F.struct("table_id", key))).alias("segments")).where(F.size("segments") == F.col("k"))
    return docs.select("k", *group, F.concat_ws("-", F.lit("m"), "k", *group, "_r", "_g").alias("doc"), "segments")


def noise_variants(base: DataFrame, seed: str, levels: tuple[float, ...] = NOISE_LEVELS) -> DataFrame:
    """(id, noise_base_id, noise_p, noise_n_dots, noise_n_flips, text, braille): each base row with flipped dots at each level.

    Tables with cells of eight dots flip eight, others six.  Where no dot would
    flip, one chosen by hash does, so each variant differs from its base.
    """
    eight = base.select(F.get("tables", F.lit(0)).alias("t"), F.col("braille").rlike("[\\x{2840}-\\x{28FF}]").alias("e")).groupBy("t").agg(F.max("e").alias("eight"))
    rows = base.select("id", F.get("tables", F.lit(0)).alias("t"), "text", "braille").join(eight, "t").withColumn("noise_p", F.explode(F.array(*[F.lit(p) for p in levels])))
    rows = rows.withColumn("noise_n_dots", F.when(F.col("eight"), 8).otherwise(6)).withColumn("_k", F.concat_ws(":", "id", F.col("noise_p").cast("string")))
    rows = rows.withColumn("_cells", F.regexp_count("braille", F.lit("[\\x{2800}-\\x{28FF}]"))).where("_cells > 0")
    cells = rows.select("_k", "id", "text", "noise_p", "noise_n_dots", "_cells", F.posexplode(F.filter(F.split("braille", ""), lambda ch: ch != "")).alias("pos", "ch"))
    is_cell = F.ascii("ch").between(0x2800, 0x28FF)
    mask = F.lit(0)
    for dot in range(8):
        mask = mask + F.when((F.col("noise_n_dots") > dot) & (T.uniform(seed, "_k", "pos", F.lit(dot)) < F.col("noise_p")), F.lit(1 << dot)).otherwise(0)
    # The forced flip: one cell by the least hash, one of its dots.
    drawn = cells.withColumn("mask", F.when(is_cell, mask).otherwise(0)).withColumn("h", F.when(is_cell, F.xxhash64(F.lit(seed), "_k", "pos")))
    forced = F.element_at(F.array(*[F.lit(1 << n) for n in range(8)]), F.floor(T.uniform(seed + ":dot", "_k") * F.col("noise_n_dots")).cast("int") + 1)
    part = drawn.groupBy("_k", "id", "text", "noise_p", "noise_n_dots").agg(
        F.array_sort(F.collect_list(F.struct("pos", "ch", "mask"))).alias("c"), F.sum(F.bit_count("mask")).alias("n"), F.min_by("pos", "h").alias("at"), F.first(forced).alias("one")
    )
    flip = lambda s: F.when((F.col("n") == 0) & (s["pos"] == F.col("at")), F.col("one")).otherwise(s["mask"])
    cells_out = F.array_join(F.transform("c", lambda s: F.when(flip(s) == 0, s["ch"]).otherwise(_cell(F.ascii(s["ch"]).bitwiseXOR(flip(s))))), "")
    return part.select(F.concat(F.lit("noise:"), "_k").alias("id"), F.col("id").alias("noise_base_id"), "noise_p", "noise_n_dots", F.greatest("n", F.lit(1)).cast("int").alias("noise_n_flips"), "text", cells_out.alias("braille"))


def _cell(code: Column) -> Column:
    """The braille cell of a code point between 0x2800 and 0x28FF, by its three bytes."""
    dots = code - 0x2800
    return F.decode(F.unhex(F.concat(F.lit("E2"), F.hex(F.shiftright(dots, 6) + 0xA0), F.hex(dots.bitwiseAND(63) + 0x80))), "UTF-8")


def pointers(pairs: DataFrame) -> DataFrame:
    """Sealed rows by their ids alone: no text, no cells."""
    return pairs.where("split = 'test'").select(F.col("id").alias("nikl_id"), "doc", "ed", "genre", "split")


def topped_up(lines: DataFrame, held_out: DataFrame, n: int, seed: str, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """(span, text): runs of n consecutive lines that share no unit with the held-out lines, nor with each other.

    A unit belongs to the span that comes first by hash; a span stays if all of
    its units are its own.  A set-based stand-in for taking spans one by one: some
    that would have fitted after another one's refusal are left out.
    """
    spans = L.consecutive(lines, n, key, order).select(F.concat_ws(":", F.col(key).cast("string"), F.col(order).cast("string")).alias("span"), F.col("run").alias("line"))
    units = cut(L.text_units(spans, "span"))
    bad = units.join(L.text_units(held_out, "doc_id").select("h").distinct(), "h", "left_semi").select("span").distinct()
    free = units.join(bad, "span", "left_anti").withColumn("_u", T.uniform(seed, "span"))
    owner = free.groupBy("h").agg(F.min_by("span", F.struct("_u", "span")).alias("owner"))
    lost = free.join(owner, "h").where("owner <> span").select("span").distinct()
    return spans.join(bad, "span", "left_anti").join(lost, "span", "left_anti").select("span", F.col("line").alias("text"))


def slices(rows: DataFrame, order: list[str], parts: int) -> DataFrame:
    """The rows with ``slice``: part k of m holds the places from floor(k n / m) on, in the given order."""
    numbered = ordered_rank(rows.withColumn("_all", F.lit(0)), ["_all"], order, out="_n").drop("_all")
    size = rows.agg(F.count("*").alias("_m"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.floor(k * F.col("_m") / parts))
    placed = numbered.join(size).withColumn("slice", (F.size(F.filter(starts, lambda s: s < F.col("_n"))) - 1).cast("bigint"))
    return placed.drop("_n", "_m")


def probed(rows: DataFrame, group: str, order: str, agrees: Column, first: int, share: float) -> DataFrame:
    """(group, probed, agreeing, kept): groups kept if enough of their first rows agree."""
    part = Window.partitionBy(group, F.pmod(F.xxhash64(order), F.lit(16))).orderBy(order)
    few = rows.select(group, order, agrees.alias("_ok")).withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= first)
    probe = few.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= first)
    out = probe.groupBy(group).agg(F.count("*").alias("probed"), F.sum(F.col("_ok").cast("bigint")).alias("agreeing"))
    return out.withColumn("kept", F.col("agreeing") >= F.ceil(F.col("probed") * share - 1e-9))
