"""Scoring, normal forms and screens against brute force."""

import random
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textloom.functions import edits as E, forms, text as T
from textloom.operators import joins as J, lines as L, scoring as S

RNG = random.Random(4)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


@given(st.text(alphabet="abcé", max_size=14), st.text(alphabet="abcé", max_size=14), st.sampled_from([4_000_000, 5]))
@settings(max_examples=200, deadline=None)
def test_edit_scripts_are_shortest_and_turn_one_into_the_other(a, b, whole):
    kept, E.WHOLE = E.WHOLE, whole
    try:
        script = E.edit_script(a, b)
    finally:
        E.WHOLE = kept
    assert len(script) == distance(a, b)
    out, at = [], 0
    for op, i, j in script:
        out += a[at:i]
        at = i + (op != "insert")
        out += b[j] if op != "delete" else ""
    assert "".join(out) + a[at:] == b
    assert E.word_distance(" ".join(a), " ".join(b)) == distance(a, b)


@pytest.mark.parametrize("text", ["Ｗｉｄｅ　１２３！", "été ÉTÉ", "Straße ﬁne №5", "ｶﾞ ガ", "Σίσυφος", "a​b­c", "½ ① ㎞", "", "…—“”"])
def test_loose_is_its_definition(text):
    want = "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if unicodedata.category(c)[0] not in "PSZ" and unicodedata.category(c) not in ("Cc", "Cf"))
    assert forms.loose(text) == want


def test_width_and_form_variants_share_units(spark):
    lines = spark.createDataFrame([(1, "Ｔｈｅ ｑｕｉｃｋ ｂｒｏｗｎ ｆｏｘ"), (2, unicodedata.normalize("NFD", "Été à la plage, déjà vu")), (3, "nothing of that")], "doc_id long, line string")
    held = spark.createDataFrame([(0, "the quick, brown fox!"), (0, "été à la plage, déjà vu")], "doc_id long, line string")
    lines = lines.withColumn("line", T.nfc("line"))
    hits = {r["doc_id"]: r["hits"] for r in L.units_in(L.text_units(lines, distinct=False), L.text_units(held)).collect()}
    assert set(hits) == {1, 2}


def test_policies_against_brute_force(spark):
    pools = {f"p{i}": [(k, RNG.choice(["", "ab", "abc", "가나다"]), RNG.choice([None, -1.0, -2.0, -0.5]), RNG.randint(0, 3)) for k in range(RNG.randint(1, 6))] for i in range(60)}
    rows = [(p, k, t, lp, d, d / 4) for p, cands in pools.items() for k, t, lp, d in cands]
    df = spark.createDataFrame(rows, "id string, idx int, text string, lp double, d int, cer double")
    got = {(r["id"], r["policy"]): r["idx"] for r in S.choose(df, *S.POLICIES).collect()}
    low = lambda x: -1e9 if x is None else x
    for p, cands in pools.items():
        want = {
            "greedy": min(c[0] for c in cands),
            "oracle": min(cands, key=lambda c: (c[3], c[0]))[0],
            "likely": min(cands, key=lambda c: (-low(c[2]), c[0]))[0],
            "verified": min(cands, key=lambda c: (c[3] != 0, -low(c[2]) if c[3] == 0 else -(low(c[2]) - 2 * c[3]), c[0]))[0],
            "closest": min(cands, key=lambda c: (c[3] != 0, c[3], -low(c[2]), c[0]))[0],
        }
        assert {k: got[p, k] for k in S.POLICIES} == want
    assert S.choose(df.limit(0), "greedy").count() == 0


LATEX = [
    (r"{a \over {b \over c}}", r"\frac{a}{\frac{b}{c}}"), (r"a_\alpha", r"a_{\alpha}"), (r"\sum x", r"\sum x"), (r"x \le y", r"x\leq y"), (r"x \leq y", r"x\leq y"),
    (r"\sqrt 2", r"\sqrt{2}"), (r"a \to b", r"a\rightarrow b"), (r"a \over b", r"a\over b"), (r"{a \over b", r"{a\over b"), (r"\overline{x}", r"\overline{x}"), ("", ""), (r"50\% x", r"50\%x"),
    (r"\sum_{i=1}^n {a_i \over 2}", r"\sum_{i=1}^{n}\frac{a_{i}}{2}"), (r"x^2_3", r"x^{2}_{3}"), ("}{", "}{"),
]


@pytest.mark.parametrize("raw, canonical", LATEX)
def test_latex_forms(raw, canonical):
    assert E.canonical_latex(raw) == canonical and E.canonical_latex(canonical) == canonical


def test_cells_of_edits():
    seg = [("en", "Hello world", "⠠⠓⠑⠇⠇⠕⠀⠸⠺")]
    one = lambda hyp: E.segment_cell_errors(seg, [("en", hyp)])
    assert one("Hello world") == [(0, 9)]
    assert 0 < one("Hallo world")[0][0] <= one("Hallo warld")[0][0] and one("zzz")[0][0] <= 9
    assert E.segment_cell_errors([*seg, ("fr", "bonjour", "⠃⠛")], [("en", "Hello world"), ("fr", "bonjour")]) == [(0, 9), (0, 2)]
    assert E.cell_errors("abc", "⠁⠃⠉", "abxd") == (1, 3)  # an insertion touches its own place
    assert E.cell_errors("a b", "⠁ ⠃", "a b") == (0, 3) and E.cell_errors("", "", "x") == (0, 0) and E.cell_errors("a", "⠁", "") == (1, 1)
    fold = {ord("學"): "学"}
    ref = [("zh_CHN.tbl", "學校", "⠁⠃"), ("km-g1.utb", "ក​ខ", "⠉⠙⠑")]
    assert E.segment_cell_errors(ref, [("zh_CHN.tbl", "学校"), ("km-g1.utb", "កខ")], fold) == [(0, 2), (0, 3)]
    assert E.segment_cell_errors(ref, [("zh_CHN.tbl", "学校"), ("km-g1.utb", "កខ")]) == [(1, 2), (0, 3)]
    assert E.segment_cell_errors(ref, [("zh_CHN.tbl", "学x"), ("km-g1.utb", "កខ")], fold) == [(1, 2), (0, 3)]


def test_scoring_form_and_its_map():
    pre, dec = "য়", "য়"
    assert E.scoring_form(f"a{pre}​b") == f"a{dec}b" and E.composed_with_map(f"a{pre}​b") == (f"a{dec}b", [0, 1, 1, 3])
    assert E.scoring_form("國", "zh-tw.ctb", {ord("國"): "国"}) == "国" and E.scoring_form("國", "ja.utb", {ord("國"): "国"}) == "國"
    text = "가éﬁ" + unicodedata.normalize("NFD", "각é")
    plain, where = E.composed_with_map(text)
    assert plain == unicodedata.normalize("NFC", text) and len(where) == len(plain) and where == sorted(where)


def test_tokenizers():
    assert E.tokens_13a('Hello, "world"! 3.5 a-b 10-12.') == ["Hello", ",", '"', "world", '"', "!", "3.5", "a-b", "10", "-", "12", "."]
    assert E.tokens("我有3.5个apples", "zh") == ["我", "有", "3.5", "个", "apples"]


def test_bleu_and_chrf(spark):
    pairs = spark.createDataFrame([("the cat sat on the mat", "the cat sat on a mat"), ("a b c d e", "a b c d e"), (None, "x"), ("x", None)], "ref string, hyp string")
    import math

    counts = [sum(c) for c in zip(*[E.pair_bleu_counts(r, h) for r, h in [("the cat sat on the mat", "the cat sat on a mat"), ("a b c d e", "a b c d e")]])]
    want = 100 * math.exp(sum(math.log(a / b) for a, b in zip(counts[:4], counts[4:8])) / 4)
    got = S.bleu(pairs, "ref", "hyp").first()
    assert abs(got["bleu"] - want) < 1e-3 and got["hyp_words"] == got["ref_words"] == 11
    same = spark.createDataFrame([("a bc def", "a bc def")], "ref string, hyp string")
    assert abs(S.chrf(same, "ref", "hyp").first()["chrf"] - 100) < 1e-9 and S.chrf(pairs, "ref", "hyp", 0).first()["chrf"] < 100
    assert S.bleu(pairs.limit(0), "ref", "hyp").first()["bleu"] in (None, 0.0)


def test_paired_bootstrap(spark):
    rows = [(f"u{i}", "m" if i % 2 else None, i % 7, 20, max(0, i % 7 - 1), 20) for i in range(2000)]
    df = spark.createDataFrame(rows, "unit string, model string, ea int, na int, eb int, nb int")
    got = {r["model"]: r for r in S.paired_bootstrap(df, ["model"], ("ea", "na"), ("eb", "nb"), "unit", resamples=200).where("model is not null").collect()}
    r = got["m"]
    assert r["units"] == 1000 and r["low"] < r["difference"] < r["high"] < 0 and r["not_below"] == 0
    wide = S.bootstrap(df.where("model is not null"), ["model"], "ea", "na", "unit", resamples=200).first()
    assert r["high"] - r["low"] < wide["high"] - wide["low"]  # what both share cancels out


def test_near_duplicate_reasons_against_brute_force(spark):
    words = [w * 2 for w in "al bo cy de ek fu go ha il jo ku la".split()]
    text = lambda n: " ".join(RNG.choice(words) for _ in range(n))
    test = [(f"t{i}", text(RNG.randint(1, 20))) for i in range(30)] + [("same", "only once here and now"), ("null", None), ("empty", "")]
    train = [(f"r{i}", text(5) + " " + RNG.choice(test[:30])[1] + " " + text(RNG.randint(0, 8))) for i in range(60)]
    train += [(f"h{i}", RNG.choice(test[:30])[1][:80]) for i in range(30)]
    train += [(f"c{i}", RNG.choice(test[:30])[1].upper()) for i in range(30)] + [(f"x{i}", text(15)) for i in range(30)] + [("n", None), ("e", " ")]
    runs = lambda t: {t[i : i + 20] for i in range(max(1, len(t) - 19))}
    held = {k: forms.loose(t) for k, t in test if t and forms.loose(t)}
    everything = set().union(*map(runs, held.values()))
    want = {}
    for k, t in train:
        x = forms.loose(t) if t else ""
        if not x:
            continue
        mine = runs(x)
        if x in held.values():
            want[k] = "loose_exact"
        elif len(mine & everything) >= 0.8 * len(mine):
            want[k] = "covered"
        elif any(len(mine & runs(y)) >= 0.8 * len(runs(y)) for y in held.values()):
            want[k] = "contains"
    a, b = (spark.createDataFrame(rows, "id string, text string") for rows in (train, test))
    got = {r["key"]: r["reason"] for r in J.near_duplicate_reasons(a, b, "id", "text").collect()}
    assert got == want and set(want.values()) == {"loose_exact", "covered", "contains"}


def test_retrieval_and_nearest_in_blocks(spark):
    rows = [(f"i{i:03}", "".join(RNG.choice("abcd") for _ in range(RNG.randint(0, 40)))) for i in range(120)] + [("n", None)]
    df = spark.createDataFrame(rows, "id string, t string")
    grams = {k: {t[i : i + 4] for i in range(len(t) - 3)} for k, t in rows if t is not None}
    want = set()
    for q in grams:
        best = sorted(((-len(grams[q] & grams[i]), i) for i in grams if i != q and grams[q] & grams[i]))[:3]
        want |= {(q, i, -n, r) for r, (n, i) in enumerate(best, 1)}
    for block in (1000, 17):
        assert {tuple(r) for r in J.gram_retrieval(df, df, "id", "t", block=block).collect()} == want
    vectors = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(300)] + [(900, None)], "id long, v array<double>")
    one, many = ({(r["query"], r["item"], r["rank"]) for r in J.nearest(vectors, "id", "v", block=b).collect()} for b in (1000, 2))
    assert one == many and len(one) == 6 * 5


def test_clock_of_one_group(spark):
    rows = [(None if i < 40 else "g", i, float(v)) for i, v in enumerate([1, 2, 3, 1, 2, 0, 5, 4] * 20)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = sorted((r["i"], r["clock"]) for r in S.running_clock(df, "g", ["i"], "v").collect())
    want, lost, last = [], {}, {}
    for g, i, v in rows:
        if g in last and v < last[g]:
            lost[g] = lost.get(g, 0) + last[g]
        last[g] = v
        want.append((i, v + lost.get(g, 0)))
    assert got == want


def test_windows_of_clean_rows(spark):
    flags = [(d, p, RNG.random() < 0.7) for d in range(6) for p in range(25)]
    df = spark.createDataFrame(flags, "d int, p int, ok boolean")
    got = {(r["d"], r["k"]): r["runs"] for r in L.clean_runs(df, "d", "p", "ok", 5).collect()}
    for d in range(6):
        seq = [f for x, _, f in flags if x == d]
        assert {k: got[d, k] for k in range(1, 6)} == {k: sum(all(seq[i : i + k]) for i in range(len(seq) - k + 1)) for k in range(1, 6)}


def test_references(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    one = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, ref string")
    two = spark.createDataFrame([("b", "z")], "id string, ref string")
    assert {tuple(r) for r in S.with_references(rows, one, two).collect()} == {("a", 1, "x"), ("b", 2, "z")}
    with pytest.raises(ValueError):
        S.with_references(rows, two)


def test_report(spark):
    from tests.conftest import SF
    from textloom.plans.report import SECTIONS, score_report

    page = score_report(spark, SF)
    assert page.count("## ") == len(SECTIONS) and "| model |" in page
