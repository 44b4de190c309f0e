"""Queries see whole texts, not their beginnings or projections."""

import hashlib
from datetime import datetime

from textloom.plans import q_build, q_joins, q_scores

AT = datetime(2030, 1, 1)


def folder(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_candidates_are_scored_on_whole_texts(spark, tmp_path):
    refs = {"r1": "가나다 12", "r2": "мир и 7", "r3": "abc"}
    cands = {"r1": ["라마바 12", "가나라 12"], "r2": ["дом и 7", "мир и 7"], "r3": ["abd", "abc"]}
    folder(spark, tmp_path, "records", [(i, t, AT) for i, t in refs.items()], "id string, text string, loaded_at timestamp")
    pools = [(i, [(c, -1.0 - k, "stop", k == 0) for k, c in enumerate(cs)]) for i, cs in cands.items()]
    d = folder(spark, tmp_path, "cand_pools", pools, "id string, cands array<struct<text:string,lp:double,finish:string,greedy:boolean>>")
    cer = {i: [distance(refs[i], c) / len(refs[i]) for c in cs] for i, cs in cands.items()}
    least = {i: min((round(x, 9), k) for k, x in enumerate(cs))[1] for i, cs in cer.items()}
    picked = {(r["id"], r["policy"]): r["idx"] for r in q_scores.policy_select(spark, d).collect()}
    assert all(picked[i, p] == least[i] for i in refs for p in ("oracle", "closest"))
    rates = {r["policy"]: r for r in q_scores.policy_rates(spark, d).collect()}
    assert rates["greedy"]["exact"] == 0 and rates["oracle"]["exact"] == 2
    assert rates["greedy"]["cer"] == round(sum(x[0] for x in cer.values()) / 3, 6)
    assert {r["id"]: r["reward"] for r in q_scores.reward_rule(spark, d).collect()} == {i: round(1 - x[0], 6) for i, x in cer.items()}
    assert q_scores.best_alpha(spark, d).collect()[0]["cer"] == rates["greedy"]["cer"]


def test_retrieval_sees_the_whole_sentence(spark, tmp_path):
    rows = [("q", "test", "a" * 60 + "bcdefgh"), ("x", "dev", "z" * 70 + "bcdefgh"), ("y", "dev", "aaaa")]
    d = folder(spark, tmp_path, "nikl_pairs", rows, "id string, split string, src string")
    assert [(r["item"], r["shared"]) for r in q_joins.retrieval_top3(spark, d).orderBy("rank").collect()] == [("x", 4), ("y", 1)]


def test_braille_is_compared_and_flipped_whole(spark, tmp_path):
    cells = "⠁" * 200
    rows = [(f"r{k}", "eval", [c], "t", b, AT, None) for k, (c, b) in enumerate([("a", cells + "⠃"), ("a", cells + "⠉"), ("b", cells + "⠃")])]
    schema = "id string, split string, tables array<string>, text string, braille string, loaded_at timestamp, segments array<struct<table_id:string,text:string,braille:string>>"
    d = folder(spark, tmp_path, "records", rows, schema)
    got = {r["table_id"]: (r["pairs"], r["identical"]) for r in q_joins.shared_texts(spark, d).collect()}
    assert got == {"a": (2, 1), "b": (2, 1)}
    assert q_joins.dot_flip_audit(spark, d).collect()[0]["cells"] == 603


def test_all_lines_are_joined(spark, tmp_path):
    lines = [f"line number {k} of this document" for k in range(5)]
    d = folder(spark, tmp_path, "documents", [(1, "s", "en", "\n".join(lines))], "doc_id long, source string, lang string, text string")
    assert q_build.joined_lines(spark, d).collect()[0]["joined"] == hashlib.sha1(" ".join(lines).encode()).hexdigest()
