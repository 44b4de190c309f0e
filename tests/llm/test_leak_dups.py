"""Problems 1 to 3 against brute force, with hot groups, nulls and clashing columns."""

import random

import numpy as np
from pyspark.sql import functions as F

from textloom.functions.forms import bare, squeezed
from textloom.llm import crosssplit as X, leakage as L, neardup as D
from textloom.operators.keyfilter import LEAST_BITS, KeyFilter

RNG = random.Random(11)
WORDS = [w * 2 for w in "al bo cy de ek fu go ha il jo ku la mi ne op 가나 다라 마바 사아".split()]


def sentence(n):
    return " ".join(RNG.choice(WORDS) + RNG.choice("aeiou") for _ in range(n))


def edited(t, share):
    words = t.split(" ")
    for _ in range(max(1, int(len(words) * share))):
        i = RNG.randrange(len(words))
        kind = RNG.random()
        words[i : i + (kind < 0.7)] = [sentence(1)] if kind < 0.8 else []
    return " ".join(words)


def test_automaton_against_brute_force():
    items = sorted({"".join(RNG.choice("abc") for _ in range(RNG.randint(3, 40))) for _ in range(60)})
    for least in (8, 12):
        known = L.SuffixAutomaton(items, least)
        for _ in range(200):
            t = "".join(RNG.choice("abc") for _ in range(RNG.randint(0, 80)))
            s = RNG.choice(items)
            t = t[:20] + s[RNG.randrange(len(s)) :] + t[20:]
            want = {n for n, i in enumerate(items) if any(i[j : j + least] in t for j in range(len(i) - least + 1))}
            spans = list(known.matches(t))
            assert {x[2] for x in spans} == want
            for a, b, n in spans:
                assert all(t[k : k + least] in items[n] for k in range(a, b - least + 1))


def test_leaks(spark):
    items = [(f"i{n}", sentence(8)) for n in range(12)] + [("twin", None), ("short", "abc")]
    items.append(("again", items[0][1]))
    docs = [(n, sentence(30), "s") for n in range(40)]
    for n in range(0, 40, 2):
        docs[n] = (n, docs[n][1] + ". " + items[n % 12][1].upper().replace(" ", "  ") + "! tail", "s")
    docs += [(100, None, "s"), (101, "", None), (102, items[3][1], "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("bare_chars", F.lit(1)).withColumn("key", F.lit("x"))
    it = spark.createDataFrame(items, "nikl_id string, src string").withColumn("text", F.lit("y"))
    want = set()
    for d, t, _ in docs:
        for i, s in items:
            if t and s and any(bare(s)[j : j + 20] in bare(t) for j in range(len(bare(s)) - 19)):
                want.add((d, i))
    for block in (300_000, 120, 40):  # one automaton, and many
        spans = L.leaked_spans(df, it, block_chars=block)
        assert {(r["key"], r["item_id"]) for r in spans.select("key", "item_id").distinct().collect()} == want
    clean = {r["doc_id"]: r for r in L.without_leaks(df, L.leaked_spans(df, it)).collect()}
    assert len(clean) == len(docs) and clean[102]["verdict"] == "drop" and clean[100]["verdict"] == "keep" and clean[100]["clean_text"] is None
    assert clean[0]["verdict"] == "cut" and clean[0]["clean_text"].endswith("! tail") and items[0][1].upper().split()[3] not in clean[0]["clean_text"].split(". ")[1]
    assert L.leaked_spans(df, it.limit(0)).count() == 0 and L.leaked_spans(df.limit(0), it).count() == 0


def test_leaks_of_many_items(spark, monkeypatch):
    """Grown items and hot passages: blocks of items on the executors give what one automaton gives, in one pass."""
    rng = random.Random(14)
    items = [(f"i{n:04}", random_text(rng, rng.randint(15, 60))) for n in range(1500)]
    hot = items[7][1] + random_text(rng, 40)
    items += [(f"h{n:03}", hot) for n in range(200)] + [(f"g{n:03}", random_text(rng, 5) + hot + random_text(rng, 3)) for n in range(50)]
    docs = [(n, random_text(rng, 80) + (hot if n % 3 == 0 else items[n][1]) + random_text(rng, 80), "s") for n in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    it = spark.createDataFrame(items, "nikl_id string, src string")
    want = {(d, i) for d, t, _ in docs for i, s in items if any(s[j : j + 20] in t for j in range(len(s) - 19))}
    columns = ["key", "item_id", "bare_start", "bare_end", "bare_chars"]
    one = sorted(map(tuple, L.leaked_spans(df, it, block_chars=10**7).select(*columns).collect()))
    monkeypatch.setattr(L, "PIECES", 50)
    many = sorted(map(tuple, L.leaked_spans(df, it, block_chars=3000).select(*columns).collect()))
    assert one == many and {(r[0], r[1]) for r in one} == want
    kept = L.without_leaks(df, L.leaked_spans(df, it, block_chars=3000)).collect()
    assert len(kept) == 300 and all(hot[:20] not in (r["clean_text"] or "") for r in kept)


def pairs_by_force(texts, similarity):
    runs = {k: {squeezed(t)[i : i + 8] for i in range(len(squeezed(t)) - 7)} for k, t in texts if t}
    return {(a, b) for a in runs for b in runs if a < b and runs[a] and runs[b] and len(runs[a] & runs[b]) >= similarity * len(runs[a] | runs[b])}


def corpus():
    base = [sentence(RNG.choice((4, 12, 40, 150))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(90):
        rows.append((1000 + i, edited(RNG.choice(base), RNG.choice((0.01, 0.03, 0.1, 0.3)))))
    hot = sentence(60)
    rows += [(2000 + i, edited(hot, 0.02)) for i in range(60)]  # a third of all rows, alike
    rows += [(3000 + i, base[5].replace(" ", "  ").upper()) for i in range(8)]  # copies
    rows += [(4000, None), (4001, ""), (4002, "short"), (4003, "short"), (4004, sentence(4000))]
    return rows


def test_near_duplicates(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0)).withColumn("class", F.lit("q"))
    want = pairs_by_force(rows, 0.7)
    for tile in (1024, 5):
        members, links = D.near_duplicates(docs, tile=tile)
        got = {(r["a"], r["b"]) for r in D.all_pairs(members, links).collect()}
        assert got <= want and len(want - got) <= 0.01 * len(want)
    every = {(r["a"], r["b"]) for tile in (1024, 5) for r in D.all_pairs(*D.near_duplicates(docs, tile=tile, exact=True)).collect()}
    assert every == want
    few = {(r["a"], r["b"]) for r in D.all_pairs(members, links, copies=2).collect()}
    assert few < got and {x for p in few for x in p} == {x for p in got for x in p}  # representatives stand for copies, nobody is lost
    assert D.near_duplicates(docs.limit(0))[1].count() == 0


def test_tile_filter_loses_no_true_pair():
    base = squeezed(sentence(300))
    texts = [base] + [squeezed(edited(base, s)) for s in (0.01, 0.02, 0.05, 0.08)] + [squeezed(sentence(300)), squeezed(sentence(290))]
    runs = D.distinct_runs(texts)
    level, maps = D.bitmaps(runs)
    sizes = np.array([len(r) for r in runs])
    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(runs[i], runs[j]))
            near = both / (sizes[i] + sizes[j] - both) >= 0.7
            ok = D.within_radius(level.astype(int), sizes, maps, np.array([i]), np.array([j]), 0.7)[0]
            assert ok or not near
    assert not D.within_radius(level.astype(int), sizes, maps, np.array([0]), np.array([5]), 0.7)[0]


def test_exact_way_at_the_threshold(spark):
    """Pairs right at the similarity, of short and long texts: the exact way has all of them."""
    rng, rows = random.Random(13), []
    for b in range(250):
        base = random_text(rng, rng.choice((20, 40, 90, 300, 900)))
        rows += [(2 * b, base), (2 * b + 1, substituted(rng, base, max(1, round(len(base) * 0.022))))]
    want = pairs_by_force(rows, 0.7)
    members, links = D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), exact=True)
    assert len(want) > 60 and {(r["a"], r["b"]) for r in D.all_pairs(members, links).collect()} == want


def test_groups(spark, tmp_path):
    rows = corpus()
    folder = f"{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in D.p2_groups(spark, folder).collect()}
    assert len(got) == len(rows) and got[4000]["group_id"] == 4000 and got[4000]["links"] == 0
    for a, b in pairs_by_force(rows, 0.75):
        assert got[a]["group_id"] == got[b]["group_id"]


def test_bands_are_never_broadcast(spark):
    """Their size is underestimated by the length of the array, so the driver would have to hold all of them."""
    rng = random.Random(15)
    texts = [random_text(rng, 60) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [t + "x" for t in texts])], "doc_id long, text string")
    _, links = D.near_duplicates(docs)
    assert {(r["a"], r["b"]) for r in links.collect()} == {(i, 200 + i) for i in range(200)}
    lines = links._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    depths = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            below = next((j for j in range(i + 1, len(lines)) if depths[j] <= depths[i]), len(lines))
            assert not any("explode(bands" in y for y in lines[i:below])


def records():
    codes = ["c1", "c2", "c3", "c4"]
    base = [sentence(RNG.choice((5, 12, 30))) for _ in range(25)]
    rows = []
    for i in range(200):
        t = RNG.choice(base) if RNG.random() < 0.3 else sentence(15)
        rows.append((f"r{i:03}", RNG.choice(("train", "train", "train", "dev", "eval")), RNG.sample(codes, RNG.choice((1, 1, 2))), "s", edited(t, RNG.choice((0.0, 0.05, 0.1, 0.3)))))
    hot = sentence(20)
    rows += [(f"h{i:03}", "train" if i % 2 else "eval", ["c1"], None, hot) for i in range(60)]
    rows += [("n1", "train", None, None, hot), ("n2", "eval", ["c1", None], None, None), ("n3", "eval", ["c1"], None, "tiny"), ("n4", None, ["c1"], None, hot)]
    return rows + rows[:5]


def test_cross_split(spark):
    rows = records()
    df = spark.createDataFrame(rows, "id string, split string, tables array<string>, source string, text string").withColumn("cls", F.lit(1)).withColumn("codes", F.lit("x"))
    known = {(i, s, frozenset(c for c in t or [] if c), bare(x)) for i, s, t, _, x in rows if x and s in ("train", "dev", "eval") and len(bare(x)) >= 20}
    runs = {x: {x[i : i + 5] for i in range(len(x) - 4)} for *_, x in known}
    want = set()
    for a in known:
        for b in known:
            if a[1] == "train" and b[1] != "train" and a[2] & b[2] and len(runs[a[3]] & runs[b[3]]) >= 0.6 * len(runs[a[3]] | runs[b[3]]):
                want.add((a[0], b[0]))
    got = {(r["t_id"], r["e_id"]) for r in X.record_pairs(*X.overlaps(df)).collect()}
    assert got == want, (len(got), len(want))
    few = {(r["t_id"], r["e_id"]) for r in X.record_pairs(*X.overlaps(df), copies=3).collect()}
    assert few < want and {x for p in few for x in p} == {x for p in got for x in p}
    assert X.record_pairs(*X.overlaps(df.limit(0))).count() == 0


def links_by_force(rows):
    """(train id, eval id) pairs of rows (id, split, code, text)."""
    runs = {i: {bare(x)[k : k + 5] for k in range(len(bare(x)) - 4)} for i, _, _, x in rows}
    sides = [[r for r in rows if (r[1] == "train") is train] for train in (True, False)]
    return {(a[0], b[0]) for a in sides[0] for b in sides[1] if a[2] == b[2] and len(runs[a[0]] & runs[b[0]]) >= 0.6 * len(runs[a[0]] | runs[b[0]])}


def random_text(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def substituted(rng, t, times):
    for _ in range(times):
        i = rng.randrange(len(t))
        t = t[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz") + t[i + 1 :]
    return t


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, s, [c], "s", x) for i, s, c, x in rows], "id string, split string, tables array<string>, source string, text string")
    return {(r["t_id"], r["e_id"]) for r in X.record_pairs(*X.overlaps(df), **options).collect()}


def test_cross_split_hot_texts(spark):
    rng, rows = random.Random(5), []
    for b in range(12):  # every fingerprint that an evaluation text shares is hot
        base = random_text(rng, (36, 60, 120, 80)[b % 4])
        rows += [(f"t{b}-{i}", "train", "c", substituted(rng, base, len(base) // 22)) for i in range(30)]
        rows += [(f"e{b}-{i}", "eval", "c", substituted(rng, base, len(base) // 30)) for i in range(6)]
    want = links_by_force(rows)
    got = found(spark, rows)
    assert len(want) > 300 and got == want, (len(got), len(want))


def test_cross_split_tiles(spark, monkeypatch):
    monkeypatch.setattr(X, "TILE", 20)  # and a key is heavy from its first sampled posting on
    monkeypatch.setattr(X, "SAMPLE", 2)
    monkeypatch.setattr(X, "HEAVY", 1)
    test_cross_split_hot_texts(spark)


def test_cross_split_short_texts(spark):
    rng, rows = random.Random(6), []
    for b in range(400):
        base = random_text(rng, rng.randint(20, 40))
        rows += [(f"t{b}", "train", "c", base), (f"e{b}", "dev", "c", substituted(rng, base, rng.choice((1, 1, 2))))]
    want = links_by_force(rows)
    assert len(want) > 100 and found(spark, rows) == want


def test_cross_split_template_texts(spark):
    """Texts of shared passages, each followed by letters of its own: only hot fingerprints, continued differently."""
    rng = random.Random(9)
    shared = [random_text(rng, 24) for _ in range(6)]
    rows = [(f"{s[0]}{i}", s, "c", "".join(p + random_text(rng, 2) for p in shared)) for s in ("train", "eval") for i in range(12)]
    want = links_by_force(rows)
    assert len(want) == 144 and found(spark, rows) == want


def test_cross_split_many_copies_near_another_text(spark):
    rng = random.Random(10)
    base = random_text(rng, 100)
    rows = [(f"t{i:03}", "train", "c", base) for i in range(100)] + [(f"e{i}", "eval", "c", base[:50] + "xx" + base[51:]) for i in range(2)]
    got = found(spark, rows)
    assert {x for p in got for x in p} == {r[0] for r in rows} and got <= links_by_force(rows)


def test_cross_split_sizes_against_brute_force(spark):
    """Random substitutions, insertions and moves at every size; no pair of the similarity is lost."""
    rng, rows = random.Random(12), []
    for b in range(500):
        base = random_text(rng, rng.choice((20, 24, 28, 33, 40, 52, 70, 90, 130, 200, 300)))
        other = substituted(rng, base, rng.randint(0, max(1, len(base) // 22)))
        for _ in range(rng.randint(0, len(base) // 40)):
            i = rng.randrange(len(other))
            other = other[:i] + random_text(rng, rng.randint(1, 4)) + other[i:]
        if rng.random() < 0.3:
            i = rng.randrange(len(other))
            other = other[i:] + other[:i]
        rows += [(f"t{b}", "train", "c", base), (f"e{b}", "dev", "c", other)]
    want = links_by_force(rows)
    assert len(want) > 200 and found(spark, rows) == want


def test_window_serves_every_pair_of_sizes():
    for n in range(1, 700):
        assert 1 <= X.window_of(n) <= X.WINDOW


def test_parities_never_overstate_a_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        common, a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (80, rng.integers(0, 60), rng.integers(0, 60)))
        one, two = X.parities([np.union1d(common, a), np.union1d(common, b)])
        assert np.bitwise_count(one ^ two).sum() <= len(a) + len(b)


def test_key_filter_misses_nothing():
    keys = np.random.default_rng(4).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(3)
    known = KeyFilter(np.zeros(LEAST_BITS // 8, np.uint8))
    known.add(keys[:2000])
    known.add(keys[2000:4000])
    assert known.holds(keys[:4000]).all() and known.holds(keys[4000:]).mean() < 0.02


def test_cross_split_shuffles_few_texts_and_no_features(spark):
    """Texts that no pair needs stay where they are; classes meet their codes before features are made."""
    rng = random.Random(14)
    rows = [(f"r{i:04}", "eval" if i % 4 == 0 else "train", "c", random_text(rng, 600)) for i in range(1600)]
    rows += [("t", "train", "c", rows[0][3][:300] + "xx" + rows[0][3][300:]), rows[1], ("r0001", "train", "c", rows[4][3])]
    stages = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        none = spark._jvm.java.util.ArrayList()
        known = stages.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return sum(known.apply(i).shuffleWriteBytes() for i in range(known.size()))

    before = written()
    assert found(spark, rows) == {("t", "r0000"), ("r0001", "r0004")}
    assert written() - before < 1.9 * sum(len(r[3]) for r in rows)


def test_copies_of_linked_texts_stay(spark):
    rng = random.Random(7)
    base = random_text(rng, 100)
    near = base[:50] + "#x" + base[51:]
    rows = [("t", "train", "c", base)] + [(f"e{i:02}", "eval", "c", near) for i in range(9)]
    rows += [("u", "eval", "d", base)] + [(f"v{i:02}", "train", "d", near) for i in range(9)]
    want = links_by_force(rows)
    assert len(want) == 18 and found(spark, rows, copies=3) == want


def test_report_counts_all_pairs(spark, tmp_path):
    rng = random.Random(8)
    base = random_text(rng, 100)
    near = base[:50] + "x" + base[51:]
    rows = [(f"t{i:03}", "train", ["c"], "s", base) for i in range(70)] + [(f"n{i}", "train", ["c", "d"], "s", near) for i in range(3)]
    rows += [(f"e{i:03}", "eval", ["c"], "a" if i < 60 else "b", base) for i in range(80)] + [("d1", "dev", ["d", "c"], None, near), ("d1", "dev", ["d", "c"], None, base)]
    folder = f"{tmp_path}/sf"
    spark.createDataFrame(rows, "id string, split string, tables array<string>, source string, text string").write.parquet(f"{folder}/records.parquet")
    got = {(r["split"], r["source"]): (r["pairs"], r["eval_records"], r["train_records"]) for r in X.p3_report(spark, folder).collect()}
    assert got == {("eval", "a"): (60 * 73, 60, 73), ("eval", "b"): (20 * 73, 20, 73), ("dev", None): (73, 1, 73)}


def test_alignment():
    a, b = bare(sentence(30)), bare(sentence(10))
    assert X.aligned(a, a) == (1.0, len(a))
    share, matched = X.aligned(a, a[:60] + "zzz" + a[60:])
    assert share > 0.8 and matched == len(a)
    assert X.aligned(a, b)[1] <= len(b)
