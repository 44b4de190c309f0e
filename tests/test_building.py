"""Providers, prose, inventories and data-set builders; nulls, empty tables and clashing columns included."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import prose as P
from textloom.operators import audit as A, datasets as D, providers as V, records as R
from textloom.sources import inventory as I, sinks as K

GOLDEN = [
    ("ab cd", (), "⠏⠀⠋"), ("ab cd", [(0, 2)], "⠁⠃⠀⠋"), ("ab cd", [(3, 5)], "⠏⠀⠉⠙"), ("ab cd", [(0, 2), (3, 5)], "⠁⠃⠀⠉⠙"),
    ("ab-cd", [(0, 2)], "⠁⠃⠤⠋"), ("abcd", [(0, 2)], "⠁⠃⠋"), ("ab cd ab", [(0, 2), (6, 8)], "⠁⠃⠀⠋⠀⠁⠃"), ("ab cd ab", [(3, 5)], "⠏⠀⠉⠙⠀⠏"),
]
SMALL = "punctuation - 36\nletter a 1\nletter b 12\nletter c 14\nletter d 145\nspace \\s 0\nalways ab 1234\nalways cd 124".splitlines()


@pytest.mark.parametrize("text, spans, cells", GOLDEN)
def test_groups_and_spans_without_them(text, spans, cells):
    got, places = V.Rules.read(SMALL).translate(text, spans)
    assert got == cells and len(places) == len(cells) and places == sorted(places)


def test_rule_tables():
    tables = {"top": ["include base", "letter x 1346 # comment"], "base": ["include top", "letter y 13456", ""]}
    rules = V.Rules.read(tables["top"], lambda n: tables[n])
    assert rules.translate("xy") == ("⠭⠽", [0, 1]) and rules.translate("z") == (None, [])
    with pytest.raises(ValueError):
        V.Rules.read(["hyphen a 1"])
    basic = V.engine("basic", "1")
    with pytest.raises(RuntimeError):
        V.engine("basic", "2")
    for text in ("the 3a of 12, and 7k.", "", "a-b 10-12", "forms with 5 b", "1a1b1z"):
        cells, _ = basic.forward("t", text)
        assert basic.backward("t", cells) == text
    assert basic.backward("t", "⣿") is None and basic.forward("t", "é")[0] is None


def test_isolation():
    slow = V.Isolated(lambda s: time.sleep(s) or s, 0.5)
    assert slow(0) == ("ok", 0) and slow(3)[0] == "timeout" and slow(0) == ("ok", 0)
    slow.close()
    bad = V.Isolated(lambda x: os._exit(1) if x else 1 / 0)
    assert bad(0) == ("exception", "ZeroDivisionError") and bad(1)[0] == "crashed" and bad(0)[0] == "exception"
    bad.close()


def test_routes(spark):
    rows = spark.createDataFrame([(1, "en-g1", "the cat"), (2, "zz", "x"), (3, "en-g1", None), (4, "en-g1", "é"), (5, None, "x"), (6, "ext", "x")], "id int, table_id string, text string").withColumn("places", F.lit(0))
    routes = spark.createDataFrame([("en-g1", "basic"), ("en-g1", "basic"), ("ext", "elsewhere")], "table_id string, engine string")
    for seconds in (None, 10.0):
        got = {r["id"]: r for r in V.transcribe_routed(rows, routes, seconds=seconds).collect()}
        assert got[1]["braille"] == "⠮⠀⠉⠁⠞" and got[1]["places"] == [0, 3, 4, 5, 6] and got[1]["reason"] is None
        assert [got[i]["reason"] for i in (2, 3, 4, 5, 6)] == ["pending", "missing", "undefined", "missing", "pending"]
    assert V.transcribe_routed(rows.limit(0), routes).count() == 0
    back = V.back_translated(spark.createDataFrame([("t", "⠮⠀⠉⠁⠞"), ("t", "⣿"), ("t", None)], "table_id string, braille string"), "basic").collect()
    assert [r["back"] for r in back] == ["the cat", None, None]
    pairs = spark.createDataFrame([("t", "A", "a"), ("t", "a", "b"), ("t", "é", "è"), ("t", None, "a")], "table_id string, a string, b string")
    assert sorted((r["a"] or "", r["homophone"]) for r in V.homophones(pairs, "basic").collect()) == [("", False), ("A", True), ("a", False), ("é", False)]


def test_bisection():
    def batch(items):  # gives one line too few whenever a bad item is in
        return [x.upper() for x in items if x != "bad"]

    items = [f"i{n}" for n in range(20)]
    items[7] = items[13] = "bad"
    assert V.bisected(batch, items) == [None if x == "bad" else x.upper() for x in items] and V.bisected(batch, []) == []


def test_prose():
    s = P.strip_latex(r"\section{A} We see \cite[p.~2]{x} that $n$ is \emph{big}, $a+b$ in Fig.~\ref{f} \begin{table*}z\end{table*}, ok--so % c")
    assert s == "We see that n is big, ⟦math⟧ in Fig. ⟦xref⟧, ok–so"
    assert P.guarded_sentences('See Fig. 3. Then cf. A here. "B" ends! (d)') == ["See Fig. 3.", "Then cf. A here.", '"B" ends!', "(d)"]
    assert P.packed("aaa bbb " + "c" * 30 + " ddd 123 456", 10, 3) == (["aaa bbb", "ddd 123"], 0, 1, 1)
    text = "A first sentence of some length stands here. Ok. " + "A clause of the long one, " * 12 + "end."
    spans = P.cut_units(text, 100)
    assert len(spans) > 2 and text[spans[0][0] : spans[0][1]].endswith("Ok.") and "".join(text[a:b] for a, b in spans).replace(" ", "") == text.replace(" ", "")
    assert P.cut_units("", 50) == [] and P.cut_units(" \n ", 50) == []
    assert P.bad_places("a—b", "a-b") == [] and 1 in P.bad_places("abc", "axc")
    assert P.word_diffs("a b c d", "a x c d") == [("b", "x")] and P.word_diffs("a", "a") == []
    assert P.span_errors("ABC 한글", [[1, 3]]) == "part_of_run" and P.span_errors("ABC 한글", [[0, 3]]) is None and P.span_errors("ABC", [[0, 3], [0, 3]]) == "order"
    assert P.span_errors("ABC", [[False, 3]]) == "not_integers" and P.span_errors("ABC 한글", [[0, 9]]) == "order" and P.span_errors("한글", [[0, 1]]) == "not_letters"


def test_mathml():
    frac = "<math><mfrac><mi>x</mi><msup><mi>y</mi><mn>2</mn></msup></mfrac></math>"
    assert P.linear_mathml(frac) == "frac{x}{y^{2}}" and P.linear_mathml("<m") is None and P.linear_mathml(None) is None
    assert P.linear_mathml("<math><mi>ℝ</mi><mo>&nope;</mo><mroot><mi>a</mi><mn>3</mn></mroot><msqrt><mi>𝑏</mi></msqrt></math>") == "bb:R&nope;root{a}{3}sqrt{b}"
    assert P.linear_mathml('<math><semantics><mover><mi>x</mi><mo>^</mo></mover><annotation>zz</annotation></semantics></math>') == "x^{^}"


def test_native_columns(spark):
    df = spark.createDataFrame([("⠁⠸⠩⠃⠸⠱⠉⠸⠩⠙", "a $$x+$y$$ b", "l1\n\n l2 \n", "en_US"), (None, None, None, None), ("", "no", "", "zh-Hant")], "c string, x string, l string, g string")
    got = df.select(P.math_spans("c").alias("m"), P.formula_of("x").alias("f"), P.last_line("l").alias("l"), P.base_language("g").alias("g")).collect()
    assert [tuple(s) for s in got[0]["m"]] == [("prose", "⠁"), ("math", "⠃"), ("prose", "⠉"), ("math", "⠙")]
    assert got[0]["f"] == "x+$y" and got[0]["l"] == "l2" and [r["g"] for r in got] == ["en", None, "cmn"] and got[2]["f"] is None and got[2]["m"] == []


def test_strict_rules(spark):
    base = dict(id="u1-S1-0000001", doc_type="single", k=1, regime="single", switch_density="none", len_bucket="snippet_1_4", cells=2, text="ab", braille="⠁⠃", tables=["t"], langs=["en"], confusable_set=[], segments=None,
                fiber_ambiguous=False, source="s", n_sentences=1, tag="x", table_status=["current"], form="S1", split="train", engine="e", seg_join=None)
    two = dict(base, id="u1-S1-0000002", k=2, tables=["t", "u"], langs=["en", "de"], table_status=["a", "b"], text="a\nb", braille="⠁\n⠃", doc_type="inter", regime="anchor",
               segments=[("t", "en", "a", "⠁", ["v"]), ("u", "de", "b", "⠃", [])], confusable_set=["v"])
    changes = {"": {}, "id_form": {"form": "S2"}, "id_pattern": {"id": "x"}, "k": {"k": None}, "cells_stale": {"cells": 3}, "confusable_self": {"confusable_set": ["t"]}, "confusable_order": {"confusable_set": ["z", "a"]},
               "break_single": {"text": "a\nb"}, "tag_empty": {"tag": None}, "sentences": {"n_sentences": 0}, "items_null": {"langs": [None]}, "split": {"split": None}}
    changed = {"": {}, "segments_text": {"text": "a\nc"}, "segments_tables": {"tables": ["u", "t"]}, "confusable_union": {"confusable_set": []}, "break_inline": {"seg_join": " "}, "segments_cells": {"braille": "⠁\n⠉"}}
    from textloom.sources.readers import RECORD

    rows = [{**base, **c} for c in changes.values()] + [{**two, **c} for c in changed.values()]
    df = spark.createDataFrame([tuple(r[f.name] for f in RECORD.fields) for r in rows], RECORD)
    got = [set(r["errors"]) for r in R.strict_errors(df.coalesce(1)).collect()]
    for want, errors in zip([*changes, *changed], got):
        assert (want in errors) if want else not errors, (want, errors)
    assert R.strict_errors(df.limit(0)).count() == 0


def test_inventory_files(spark, tmp_path):
    a, b = tmp_path / "own", tmp_path / "system"
    a.mkdir(), b.mkdir()
    (a / "en-g1.ctb").write_text("#+language: en\n#+type: literary\n#+type: computer\n#+grade: 1\ninclude base.cti\nundefined 26\n")
    (b / "en-g1.ctb").write_text("#+language: xx\n#+type: literary\n")
    (b / "ko-x.ctb").write_text("#+language: KO-Kore\n#+type: literary\n#+direction: backward\n")
    (b / "zz-old.ctb").write_text("\n" * 70 + "#+language: zz\n#+type: literary\n")
    (b / "de-no-g0.utb").write_text("#+language: no\n#+type: literary\n")
    lines = I.file_lines(spark, f"{tmp_path}/*/*tb")
    heads = {r["table_id"]: r for r in I.table_headers(lines, {"/own/": -1}).collect()}
    assert heads["en-g1.ctb"]["language"] == "en" and heads["en-g1.ctb"]["type"] == "literary" and "zz-old.ctb" not in heads
    more = spark.createDataFrame([("ko-2024.ctb", "ko", "literary")], "table_id string, language string, type string")
    kept = {r["table_id"]: r["base_lang"] for r in I.usable_headers(I.table_headers(lines, {"/own/": -1}), ["zz*"], more).collect()}
    assert kept == {"en-g1.ctb": "en", "de-no-g0.utb": "nb", "ko-2024.ctb": None}
    shadow = lines.where("path like '%/own/%'")
    assert [tuple(r) for r in I.shadow_errors(shadow, shadow).collect()] == [("en-g1.ctb", "active_rule")]
    assert {r["file"] for r in I.listing(spark, f"{b}").collect()} == {"en-g1.ctb", "ko-x.ctb", "zz-old.ctb", "de-no-g0.utb"} and I.sides(spark, {"train": str(a), "eval": str(b)}).count() == 5
    (tmp_path / "c.yaml").write_text("a: {x: no, y: 3}\n")
    config = I.load_config(str(tmp_path / "c.yaml"))
    assert [tuple(r) for r in I.override_rows(spark, config["a"]).orderBy("ord").collect()] == [("x", "no", 0), ("y", "3", 1)]
    block = I.lineage(str(a), ["en-g1.ctb"])
    assert len(block["files"]["en-g1.ctb"]) == 64 and set(block) == {"head", "dirty", "files", "sha256"}
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert I.content_id(df) == I.content_id(df.orderBy(F.desc("x"))) != I.content_id(df.limit(1))
    then = spark.createDataFrame([("a", "1"), ("b", "2")], "label string, sha256 string")
    now = spark.createDataFrame([("a", "9"), ("c", "3")], "label string, sha256 string")
    assert {tuple(r) for r in I.changed_entries(now, then).collect()} == {("a", "changed"), ("b", "missing"), ("c", "new")}
    bodies = spark.createDataFrame([(json.dumps({"choices": [{"message": {"content": "hi"}}]}),), (json.dumps({"content": [{"type": "text", "text": "a"}, {"type": "x"}, {"type": "text", "text": "b"}]}),), ("broken",), (None,)], "body string")
    assert [r[0] for r in bodies.select(I.reply_text("body")).collect()] == ["hi", "ab", None, None]
    picked = I.rows_at(spark.range(50).withColumn("v", -F.col("id")), ["id"], spark.createDataFrame([(0,), (7,), (7,), (99,)], "at int"))
    assert sorted(r["id"] for r in picked.collect()) == [0, 7]


def test_document_sample(spark):
    rows = [(f"{d}-{i:04}", "e", "g" if d % 2 else "h", f"d{d}", 0) for d in range(12) for i in range(1 + 40 * (d == 3) + d)]
    df = spark.createDataFrame(rows, "id string, ed string, genre string, doc string, quota int").drop("quota")
    got, quotas = D.whole_documents(df, 60, ["ed", "genre"], "doc", "id", "s")
    want = {r["_s"]: r["quota"] for r in quotas.collect()}
    assert sum(want.values()) == 60
    kept = got.toPandas()
    for s, q in want.items():
        mine = kept[kept["_s"] == s]
        assert len(mine) == min(q + int(q * D.MARGIN) + D.SPARE, sum(r[1] + r[2] == s for r in rows)) and mine["id"].is_unique
        for doc, part in mine.groupby("doc"):
            ids = sorted(r[0] for r in rows if r[3] == doc)
            at = sorted(ids.index(i) for i in part["id"])
            assert at == list(range(at[0], at[0] + len(at))) and (len(at) == len(ids) or not part["whole"].any())
    empty, none = D.whole_documents(df.limit(0), 60, ["ed", "genre"], "doc", "id", "s")
    assert empty.count() == 0 and none.count() == 0


def test_quotas_and_grids(spark):
    rows = spark.range(100).select(F.concat(F.lit("r"), "id").alias("id"), F.when(F.col("id") < 90, "a").otherwise("b").alias("cell"))
    kept, report = D.taken(rows, ["cell"], spark.createDataFrame([("a", 5), ("b", 20), ("c", 2)], "cell string, quota long"), "s", "id")
    assert {tuple(r) for r in report.select("cell", "got", "short").collect()} == {("a", 5, 0), ("b", 10, 10), ("c", 0, 2)} and kept.count() == 15
    assert {r["quota"] for r in D.equal_quotas(report.select("cell"), 8, "cell").collect()} == {3, 2}
    segs = spark.createDataFrame([(f"t{i % 5}", f"k{i}", "g1" if i % 5 < 3 else "g2") for i in range(50)], "table_id string, key string, grp string")
    for within in (None, "grp"):
        docs = D.mixed_grid(segs, [2, 3], "s", "key", within).collect()
        assert docs and all(len(r["segments"]) == r["k"] == len({x["table_id"] for x in r["segments"]}) for r in docs)
        for k in (2, 3):
            used = [x["key"] for r in docs if r["k"] == k for x in r["segments"]]
            assert len(used) == len(set(used))


def test_noise_always_changes_something(spark):
    base = spark.createDataFrame([(f"b{i}", ["t"], f"text{i}", "⠁⠃\n⠉⠙" * (1 + i % 4), "z") for i in range(40)] + [("e", ["u"], "x", "⡀⠁", "z"), ("n", ["t"], "x", "\n", "z")], "id string, tables array<string>, text string, braille string, pos string")
    noisy = D.noise_variants(base, "s", (0.001, 0.3))
    rows = noisy.collect()
    assert len(rows) == 41 * 2 and all(r["noise_n_flips"] >= 1 for r in rows) and {r["noise_n_dots"] for r in rows if r["noise_base_id"] == "e"} == {8}
    assert A.bad_noise(noisy.where("noise_n_dots = 6"), base).count() == 0 and D.noise_variants(base.limit(0), "s").count() == 0


def test_top_up(spark):
    lines = spark.createDataFrame([(1, p, t) for p, t in enumerate(["first line of the text here", "second line of the text here", "third line of the text here"])] + [(2, 0, "first line of the text here"), (2, 1, "something else altogether now")], "doc_id long, pos int, line string")
    held = spark.createDataFrame([(9, "something else altogether now")], "doc_id long, line string")
    got = [r["span"] for r in D.topped_up(lines, held, 1, "s").collect()]
    assert "2:1" not in got and sum(s in got for s in ("1:0", "2:0")) == 1 and {"1:1", "1:2"} <= set(got)


def test_gates(spark):
    report = spark.createDataFrame([("rows", 10.0), ("rate", 0.98), ("gone", None)], "name string, value double")
    got = {r["name"]: r["passed"] for r in A.gates_met(report, {"rows": ("=", 10), "rate": (">=", 0.99), "gone": ("=", 0), "absent": ("<", 1)}).collect()}
    assert got == {"rows": True, "rate": False, "gone": False, "absent": False}


def test_reports(spark, tmp_path):
    inv = spark.createDataFrame([("a.ctb", "/data/t/a.ctb", 0.5), ("b.ctb", "/data/t/b.ctb", None)], "table_id string, file_path string, weight double")
    K.write_inventory(inv, f"{tmp_path}/inv", "/data/")
    back = sorted(json.loads(r["value"])["file_path"] for r in spark.read.text(f"{tmp_path}/inv").collect())
    assert back == ["t/a.ctb", "t/b.ctb"]
    summary = K.write_with_summary(inv, f"{tmp_path}/rows")
    assert summary["rows"] == 2 and summary["files"] and all(len(f["sha256"]) == 64 for f in summary["files"])
    page = K.cells_with_places("⠁⠃⠀⠉⠙⠑", 3)
    assert page == {"lines": ["⠁⠃", "⠉⠙⠑"], "places": [[0, 1], [3, 4, 5]], "pages": 1}


def test_temporary_tables_go(spark):
    from textloom import session as S

    kept = S.cut(spark.range(3))
    before = len(S._written)
    with S.temporary():
        inner = S.cut(spark.range(5))
        path = S._written[-1][1].removeprefix("file://")
        assert inner.count() == 5 and os.path.isdir(path)
    assert len(S._written) == before and not os.path.isdir(path) and kept.count() == 3


def test_codes_of_languages(spark):
    from textloom.sources import corpora as C

    langs = spark.createDataFrame([("zh", "zho"), ("sr", "srp"), ("en", "eng"), ("no", "nob"), ("xx", "xxx"), ("ks", "kas")], "lang string, lang3 string")
    codes = spark.createDataFrame([("zho_Hant",), ("zho_Hans",), ("srp_Cyrl",), ("srp_Latn",), ("eng_Latn",), ("nno_Latn",), ("kas_Deva",), ("kas_Arab",)], "code string")
    got = {r["lang"]: r["code"] for r in C.best_code(langs, codes, ["Latn"], {"zh": "Hant"}, {"no": "nno_Latn", "en": "eng_Brai"}).collect()}
    assert got == {"zh": "zho_Hant", "sr": "srp_Latn", "no": "nno_Latn", "ks": "kas_Arab"}
