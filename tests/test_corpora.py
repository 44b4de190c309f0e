"""External readers and dataset checks on small files."""

import json

from pyspark.sql import functions as F

from textloom.operators import audit as A, builder as B
from textloom.sources import corpora as C


def test_pairs_and_verses(spark, tmp_path):
    d = tmp_path / "2024"
    d.mkdir()
    (d / "MGdoc1.json").write_text(json.dumps({"document": {"id": "MGdoc1"}, "parallel": [{"id": "a", "src": "가", "tgt": "⠫"}, {"id": "b", "src": "나", "tgt": None}]}))
    rows = {r["id"]: r for r in C.read_pairs(spark, f"file://{d}").collect()}
    assert rows["a"]["ed"] == "2024" and rows["a"]["genre"] == "MG" and rows["a"]["split"] in ("dev", "test") and rows["b"]["tgt"] is None
    (tmp_path / "v.json").write_text(json.dumps({"chapters": [{"chapter": 1, "verses": [{"verse": 1, "text": "x"}, {"verse": 2, "text": "y"}]}]}))
    assert [(r[0], r[1], r[2]) for r in C.read_verses(spark, f"file://{tmp_path}/v.json").orderBy("verse").collect()] == [(1, 1, "x"), (1, 2, "y")]


def test_verse_stream(spark):
    df = spark.createDataFrame([("k", "head #acav one #acbv two #acbv again #acav back"), ("e", "none"), ("n", None)], "k string, t string")
    got = [(r["chapter"], r["verse"], r["body"], r["note"]) for r in C.parse_verse_stream(df, "k", "t").collect()]
    assert got == [(1, 1, "one", None), (1, 2, "two", None), (1, 2, "again", "repeated"), (1, 1, "back", "not_ascending")]


def test_shards_caps_and_forms(spark):
    art = spark.createDataFrame([(i, "en", ["s"] * 4) for i in range(10)], "i int, lang string, s array<string>")
    assert [r["shard"] for r in C.article_shards(art, "i", "s", "lang", 8, 12).orderBy("i").collect()] == ["B", "B", "A", "A", "A", None, None, None, None, None]
    assert C.capped(spark.createDataFrame([("g", str(i % 6)) for i in range(30)], "g string, k string"), "g", "k", 4).count() == 4
    df = spark.createDataFrame([("th", "ก​ข"), ("bn-x", "ড়"), ("en", "a​b")], "l string, t string")
    assert [r[0] for r in df.select(C.normalised_for("l", "t")).collect()] == ["ก ข", "ড়", "a​b"]
    codes = spark.createDataFrame([("zho_Hant",), ("zho_Hans",), ("eng_Latn",)], "code string")
    langs = spark.createDataFrame([("zh", "zho"), ("en", "eng")], "lang string, lang3 string")
    assert {r["lang"]: r["code"] for r in C.best_code(langs, codes, ["Hans", "Latn"]).collect()} == {"zh": "zho_Hans", "en": "eng_Latn"}


def test_logs_sidecars_examples(spark, tmp_path):
    (tmp_path / "a.log").write_text("t=1.5 x\nnothing\nt=2 t=3\n")
    assert [r["value"] for r in C.read_log(spark, f"file://{tmp_path}/a.log", "t=([0-9.]+)").orderBy("line_no", "value").collect()] == [1.5, 2.0, 3.0]
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = spark.createDataFrame([("a", "x", "dev"), ("b", "y", "test"), ("c", "z", "dev")], "id string, text string, split string")
    side = spark.createDataFrame([("a", sha("x"), "{1}", "rule"), ("b", sha("y"), "{2}", "dev_annotation"), ("q", "0", "{}", "rule"), ("c", "bad", "{}", "rule")], "id string, source_sha256 string, options string, provenance string")
    assert {r["id"]: r["problem"] for r in C.attach(rows, side, "id", "text").collect()} == {"a": None, "b": "leaked", "c": "stale", "q": "unknown"}
    (tmp_path / "e.jsonl").write_text('{"print": "ab", "text": "c"}\nbroken\n{"text": "de"}\n')
    assert sorted(r["text"] for r in C.tolerant_examples(spark, f"file://{tmp_path}/e.jsonl", ["print", "text"]).collect()) == ["ab", "de"]


def test_audit(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "file string, sha256 string")
    then = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3")], "file string, sha256 string")
    assert {r["file"]: r["state"] for r in A.changed_files(now, then).collect()} == {"b": "changed", "c": "missing", "d": "unknown"}
    noisy = spark.createDataFrame([("n1", "b1", "t", "⠁⠃", 1), ("n2", "b1", "t", "⠁⠁", 1), ("n3", "gone", "t", "⠁", 1), ("n4", "b1", "x", "⠁⠁", 1), ("n5", "b1", "t", "⠁⠇", 5)], "id string, noise_base_id string, text string, braille string, noise_n_flips int")
    base = spark.createDataFrame([("b1", "t", "⠁⠁")], "id string, text string, braille string")
    assert {r["id"]: r["why"] for r in A.bad_noise(noisy, base).collect()} == {"n2": "unchanged", "n3": "no_base", "n4": "text", "n5": "flips"}
    t = spark.createDataFrame([("x", "中文 句子是一个很长的行呢"), ("y", "中文 别的")], "id string, text string")
    lines = spark.createDataFrame([("句子是一个很长的行",)], "line string")
    assert [(r["id"], r["i"]) for r in A.wrong_joiners(t, lines).collect()] == [("x", 3)]
    assert {r["k"]: (r["target"], r["got"]) for r in A.missed_targets(spark.createDataFrame([("a",), ("a",), ("z",)], "k string"), spark.createDataFrame([("a", 2), ("b", 1)], "k string, target int"), "k").collect()} == {"b": (1, 0), "z": (0, 1)}
    rep = A.report({"none": now.limit(0), "some": now}, {"none"}, examples=2)
    rows = {r["check_name"]: r for r in rep.collect()}
    assert rows["none"]["passed"] and rows["some"]["violations"] == 3 and len(rows["some"]["examples"]) == 2
    v = A.verdict(rep).first()
    assert v["freezable"] and not v["clean"]
    pairs = spark.createDataFrame([("p", "t", "a"), ("p", "t", "b"), ("q", "t", "a")], "pair string, text string, code string")
    assert [r["pair"] for r in A.incomplete_pairs(pairs, "pair", "text", "code", ["a", "b"]).collect()] == ["q"]


def test_builder(spark):
    rows = spark.createDataFrame([("t", "ab c", "old"), ("t", "é", None), ("t", None, None), ("t", "ab c", "x")], "tab string, text string, braille string")
    got = B.transcribe(rows, "tab", "text").collect()
    assert [r["braille"] for r in got if r["text"] == "ab c"] == ["⠁⠃⠀⠉"] * 2 and {r["reason"] for r in got} == {None, "undefined", "missing"}
    lines = spark.createDataFrame([(str(i),) for i in range(100)], "line string")
    accepts = lines.crossJoin(spark.createDataFrame([("a",), ("b",)], "table string"))
    out = B.spread_lines(lines, spark.createDataFrame([("a", 10), ("b", 30)], "table string, need int"), accepts, "s").groupBy("table").count().collect()
    assert {r["table"]: r["count"] for r in out}["a"] == 10 and sum(r["count"] for r in out) <= 40
    s = spark.createDataFrame([("zh", ["你好", "世界"]), ("en", ["a", "b"]), ("ko", ["가", "나"])], "l string, p array<string>")
    assert [r[0] for r in s.select(B.joined_sentences(F.col("l"), F.col("p"))).collect()] == ["你好世界", "a b", "가 나"]
