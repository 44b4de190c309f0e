"""Operators on small fixtures with nulls, ties, repeats, empty tables and extra columns."""

import random

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import joins as J, noise as N, records as R, sampling as S, scoring as C
from textloom.operators.components import connected_components
from textloom.operators.ranking import seeded_hash, spread_rank, spread_running_sum
from textloom.sources import readers
from textloom.session import cut


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    want = {x: min(g) for g in groups.values() for x in g}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spread_rank_is_row_number(spark):
    rows = spark.range(500).withColumn("g", F.col("id") % 3).withColumn("h", seeded_hash(1, "id")).withColumn("v", F.col("id") % 7)
    ranked = spread_rank(rows, ["g"], "h", "id", bits=4)
    summed = spread_running_sum(rows, ["g"], "h", "id", "v", bits=4)
    by = {}
    for r in sorted(rows.collect(), key=lambda r: (r["g"], r["h"], r["id"])):
        by.setdefault(r["g"], []).append(r)
    want_rank = {r["id"]: i + 1 for g in by.values() for i, r in enumerate(g)}
    want_sum = {r["id"]: sum(x["v"] for x in g[:i]) for g in by.values() for i, r in enumerate(g)}
    assert {r["id"]: r["rank"] for r in ranked.collect()} == want_rank
    assert {r["id"]: r["running"] for r in summed.collect()} == want_sum


def test_largest_remainder_adds_up(spark):
    g = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, w double")
    assert {r["k"]: r["seats"] for r in S.largest_remainder(g, 10, "w", "k").collect()} == {"a": 4, "b": 3, "c": 3}


def test_latest_takes_the_last_delivery(spark):
    rows = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("y", 1, None), ("y", 1, None)], "id string, at int, v string")
    assert {r["id"]: r["v"] for r in R.latest(rows, ["id"], "at").collect()} == {"x": "new", "y": None}
    assert R.latest(rows.limit(0), ["id"], "at").count() == 0


def test_segments_roundtrip(spark):
    df = spark.sql("""SELECT * FROM VALUES ('a', array('t1','t2'), 'x\\ny', null, array(named_struct('table_id','t1','lang','e','text','x','braille','b','confusable_set',array('q')), named_struct('table_id','t2','lang','f','text','y','braille',null,'confusable_set',null))),
        ('b', array('t1'), 'z', 'c', null) AS v(id, tables, text, braille, segments)""")
    back = {r["id"]: (r["text"], r["k"]) for r in R.assembled(R.segments_long(df)).collect()}
    assert back == {"a": ("x\ny", 2), "b": ("z", 1)}


def test_policies(spark):
    rows = [("p", 0, "A", -1.0, 3, 0.5), ("p", 1, "B", -9.0, 1, 0.1), ("q", 0, "A", -1.0, 3, 0.5), ("q", 1, "F", -5.0, 0, 0.0), ("r", 0, "N", None, None, 1.0), ("r", 1, "N", None, None, 1.0)]
    c = spark.createDataFrame(rows, "id string, idx int, text string, lp double, d int, cer double")
    pick = lambda p: {r["id"]: r["idx"] for r in C.choose(c, p).collect()}
    assert pick("greedy") == {"p": 0, "q": 0, "r": 0}
    assert pick("verified") == {"p": 0, "q": 1, "r": 0}
    assert pick("closest") == {"p": 1, "q": 1, "r": 0}
    assert pick("oracle") == {"p": 1, "q": 1, "r": 0}


def test_bootstrap_interval_holds_the_point(spark):
    rows = spark.range(400).select((F.col("id") % 2).cast("string").alias("g"), F.col("id").alias("u"), (F.col("id") % 5).alias("x"), F.lit(4).alias("n"))
    for r in C.bootstrap(rows, ["g"], "x", "n", "u", resamples=100).collect():
        assert r["low"] < r["point"] < r["high"] and r["high"] - r["low"] < 0.2


def test_bleu_of_equal_texts(spark):
    rows = spark.createDataFrame([("a b c d e", "a b c d e"), ("f g h i", "f g h i")], "r string, h string")
    assert C.bleu(rows, "r", "h").first()["bleu"] == 100.0


def test_near_duplicate_reasons(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here"
    train = spark.createDataFrame([("e", base.upper() + "!"), ("c", base[:50]), ("s", "zz " * 200 + base), ("n", "something else entirely, not at all the same text"), ("0", ""), ("x", None)], "id string, t string")
    test = spark.createDataFrame([("1", base)], "id string, t string")
    got = {r["key"]: r["reason"] for r in J.near_duplicate_reasons(train, test, "id", "t").collect()}
    assert got == {"e": "loose_exact", "c": "covered", "s": "contains"}


def test_ranges_and_nearest(spark):
    p = spark.createDataFrame([("g", i) for i in range(200)], "g string, at int")
    r = spark.createDataFrame([("g", 10, 130), ("g", 60, 61), ("h", 0, 9)], "g string, low int, high int")
    assert J.within_ranges(p, r, "g", "at", "low", "high").count() == 121
    v = spark.createDataFrame([(50, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None)], "id long, v array<double>")
    assert [(x["item"], x["rank"]) for x in J.nearest(v, "id", "v").orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_noise_flips_only_dots(spark):
    rows = spark.createDataFrame([("a", "⠁⠃⠉⠀\n⠿⠿⠿⠿")], "id string, b string")
    none = N.flips_audit(N.flipped(rows, "id", "b", 0.0, "s"), "id").first()
    all_ = N.flips_audit(N.flipped(rows, "id", "b", 1.0, "s"), "id").first()
    assert (none["cells"], none["flips"]) == (8, 0) and (all_["cells"], all_["changed"], all_["flips"]) == (8, 8, 48)


def test_parsers(spark):
    rows = spark.createDataFrame([("⟨a⟩x\n⟨b⟩y",), ("⟨a⟩x\nplain",), ("bad",)], "c string")
    got = rows.select(F.size(N.parse_strict("c")).alias("s"), F.size(N.parse_loose("c")).alias("l")).collect()
    assert [(r["s"], r["l"]) for r in got] == [(2, 2), (0, 1), (0, None)] or [(r["s"], r["l"]) for r in got] == [(2, 2), (0, 1), (0, -1)]


def test_native_text_functions(spark):
    r = spark.createDataFrame([(" a  b ", "A1⠁", 7, 1)], "x string, y string, n int, s int")
    o = r.select(
        T.squeezed_blanks("x").alias("a"), T.ascii_cells(F.lit("abc")).alias("b"), T.cells_ascii(F.lit("⠁⠃⠉")).alias("c"), T.cell_count("y").alias("d"), T.len_bucket("n", "s").alias("e"), T.half_even_scaled("n", 0.5).alias("f"),
        T.sub_sentences(F.lit("This is sentence one. Short. 日本語の文章です。")).alias("g"),
    ).first()
    assert (o["a"], o["b"], o["c"], o["d"], o["e"], o["f"]) == ("a b", "⠁⠃⠉", "ABC", 1, "snippet_5_10", 4)
    assert o["g"] == ["This is sentence one.", "日本語の文章です。"]


def test_readers_and_writers(spark, tmp_path):
    base = f"file://{tmp_path}"
    rows = spark.createDataFrame([("a", None, "train"), ("b", "x", "eval")], "id string, text string, split string")
    readers.write_records(rows, f"{base}/j", gzip=True)
    back = readers.read_records(spark, f"{base}/j").select("id", "text", "split")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    readers.write_table(rows, f"{base}/c")
    assert readers.read_table(spark, f"{base}/c", "id string, text string, split string").count() == 2
    (tmp_path / "l.txt").write_text("short\n" + "x" * 30 + "  \n" + "y" * 700)
    assert [r["line"] for r in readers.read_lines(spark, f"{base}/l.txt").collect()] == ["x" * 30]
    (tmp_path / "p.brf").write_text("ABC\nD\fE")
    assert [(r["page"], r["cells"]) for r in readers.read_brf(spark, f"{base}/p.brf").orderBy("page", "line_no").collect()] == [(0, "⠁⠃⠉"), (0, "⠙"), (1, "⠑")]
    assert readers.file_digests(spark, f"{base}/p.brf").first()["bytes"] == 7
    assert [r["id"] for r in readers.resume(rows, rows.where("id = 'a'"), "id").collect()] == ["b"]


def test_cut_keeps_rows(spark):
    assert cut(spark.range(10).where("id > 3")).count() == 6
