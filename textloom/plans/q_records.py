"""Queries over the records and the table inventory."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators import records as R, sampling as S
from textloom.plans.q_lines import _KEY, _LOOSE, _U
from textloom.session import table


def _records(spark, d):
    return R.latest(table(spark, d, "records"), ["id"], "loaded_at")


_LATEST = "SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1"
_CELLS = r"[^\x{2800}-\x{28FF}]"


def latest_records(spark, d):
    r = _records(spark, d)
    return r.groupBy("split", "form").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars"))


def record_segments_long(spark, d):
    s = R.segments_long(_records(spark, d))
    return s.groupBy("table_id").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"), F.max("pos").cast("bigint").alias("last_pos"))


def record_roundtrip(spark, d):
    """Records whose segments, taken apart and joined again, give the text back."""
    r = _records(spark, d)
    back = R.assembled(R.segments_long(r)).select("id", F.col("text").alias("again"), F.col("k").alias("parts"))
    return r.join(back, "id").groupBy("form").agg(F.count("*").alias("records"), F.sum((F.col("text") == F.col("again")).cast("bigint")).alias("same"), F.sum("parts").alias("parts"))


def record_schema_errors(spark, d):
    return R.schema_errors(_records(spark, d)).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("records"))


def record_dedup_keys(spark, d):
    """First record of each joint key, by id."""
    keyed = _records(spark, d).select(R.joint_key(F.col("tables"), F.col("text")).alias("key"), "id")
    return keyed.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies")).where("copies > 1")


def cells_by_code(spark, d):
    r = _records(spark, d).where("braille is not null")
    return r.groupBy(F.get("tables", F.lit(0)).alias("table_id")).agg(F.sum(T.cell_count("braille")).alias("cells"), F.sum("cells").alias("stated"), F.max(T.cell_count("braille")).alias("most"))


def braille_only(spark, d):
    p = table(spark, d, "nikl_pairs")
    return p.groupBy("split").agg(
        F.count("*").alias("pairs"),
        F.sum(F.coalesce(T.is_cells("tgt").cast("bigint"), F.lit(0))).alias("pure"),
        F.count(T.with_blank_cells("tgt")).alias("with_blanks"),
        F.sum(T.cell_count("tgt")).alias("cells"),
    )


def six_dot_codes(spark, d):
    """Codes of segments that use any eight-dot cell, and how many don't."""
    s = R.segments_long(_records(spark, d)).where("braille is not null")
    return s.groupBy("table_id").agg(F.max(F.col("braille").rlike("[\\x{2840}-\\x{28FF}]").cast("int")).cast("boolean").alias("eight_dot"), F.count("*").alias("segments"))


def len_buckets(spark, d):
    r = _records(spark, d)
    return r.groupBy(T.len_bucket("cells", "n_sentences").alias("bucket"), "len_bucket").agg(F.count("*").alias("records"))


def form_quota(spark, d):
    """Up to 20 train records of each form, in hash order."""
    r = _records(spark, d).where("split = 'train'")
    return S.hash_rank(r, ["form"], "quota", "id").where("rank <= 20").select("form", "id")


def stratified_split(spark, d):
    r = _records(spark, d).where("split = 'train'").select("id", "form", "doc_type")
    return S.stratified(r, ["form", "doc_type"], 200, "dev", "id").select("form", "doc_type", "id")


def round_robin_strata(spark, d):
    r = _records(spark, d).where("split = 'eval'").select("id", "form")
    return S.round_robin(r, "form", 60, "rr", "id").select("form", "id")


def nested_kshot(spark, d):
    r = _records(spark, d).where("split = 'train'").select("id", F.get("tables", F.lit(0)).alias("code"))
    return S.nested_shots(r, "code", [4, 16, 64], "shots", "id").groupBy("code", F.col("shots").cast("bigint").alias("shots")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def shard_mod(spark, d):
    n = _records(spark, d).withColumn("ord", F.row_number().over(Window.partitionBy("split").orderBy("id")) - 1)
    return n.groupBy("split", (F.col("ord") % 4).cast("bigint").alias("shard")).agg(F.count("*").alias("records"), F.min("id").alias("first_id"))


def systematic_sample(spark, d):
    p = table(spark, d, "nikl_pairs")
    pick = (F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") % 50 == 0) | F.col("src").rlike("[0-9]+년")
    return p.where(pick).select("id", "genre")


def hash_sides(spark, d):
    p = table(spark, d, "nikl_pairs")
    side = F.when(F.conv(F.substring(F.sha1("src"), 1, 8), 16, 10).cast("bigint") % 5 == 0, "eval").otherwise("train")
    return p.groupBy(side.alias("side"), T.hex_sum_mod5("doc").cast("bigint").alias("doc_mod5")).agg(F.count("*").alias("pairs"))


def largest_remainder_quota(spark, d):
    sizes = table(spark, d, "nikl_pairs").groupBy("doc").agg(F.count("*").alias("n"))
    return S.largest_remainder(sizes, 500, "n", "doc").select("doc", "n", "seats")


def table_weights(spark, d):
    w = S.table_weights(table(spark, d, "inventory"), {"en": 3.0, "ko": 2.0, "zh": 1.0}, 0.6)
    return w.select("table_id", F.round("table_weight", 9).alias("table_weight"))


def weighted_choice(spark, d):
    draws = _records(spark, d).select("id", T.uniform("choice", "id").alias("u"))
    inv = table(spark, d, "inventory").where("not holdout").select("table_id", "weight")
    return S.weighted_choice(draws, inv, "weight", "table_id", "u").groupBy("table_id").agg(F.count("*").alias("draws"))


def draw_languages(spark, d):
    inv = table(spark, d, "inventory").where("not holdout").groupBy("base_lang").agg(F.round(F.sum("weight"), 6).alias("w"))
    return S.without_replacement(inv, 5, "w", "langs", "base_lang").select("base_lang", "draw")


def sequence_ids(spark, d):
    return R.numbered(_records(spark, d).select("id", "form"), "form", ["id"], "n-").select("id", "seq_id")


def record_anti_join(spark, d):
    """Train records by the first reason to leave them out: duplicate, shared with eval, shared with dev."""
    r = _records(spark, d).select("id", "split", F.sha1(T.loose("text")).alias("k"))
    ev, dv = (r.where(F.col("split") == s).select("k").distinct().withColumn(s, F.lit(True)) for s in ("eval", "dev"))
    first = r.where("split = 'train'").groupBy("k").agg(F.min("id").alias("first_id"))
    t = r.where("split = 'train'").join(first, "k").join(ev, "k", "left").join(dv, "k", "left")
    reason = F.when(F.col("id") != F.col("first_id"), "duplicate").when(F.col("eval"), "eval_overlap").when(F.col("dev"), "dev_overlap").otherwise("kept")
    return t.groupBy(reason.alias("reason")).agg(F.count("*").alias("records"))


def twin_texts(spark, d):
    """Texts under exactly two codes: do their cells agree?"""
    s = R.segments_long(_records(spark, d)).where("braille is not null").groupBy("text", "table_id").agg(F.min("braille").alias("braille"))
    pairs = s.groupBy("text").agg(F.count("*").alias("codes"), F.count_distinct("braille").alias("forms"), F.min("table_id").alias("a"), F.max("table_id").alias("b")).where("codes = 2")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("twins"), F.sum((F.col("forms") == 1).cast("bigint")).alias("same_cells"))


def confusable_siblings(spark, d):
    """Other tables that share a group with each table."""
    g = table(spark, d, "inventory").select("table_id", F.explode("group_ids").alias("g"))
    pairs = g.join(g.select(F.col("table_id").alias("sibling"), "g"), "g").where("table_id <> sibling").select("table_id", "sibling").distinct()
    return pairs.groupBy("table_id").agg(F.count("*").alias("siblings"), F.array_join(F.array_sort(F.collect_list("sibling")), " ").alias("names"))


def status_rules(spark, d):
    """First matching name pattern decides the status; else the table keeps its own."""
    rules = spark.createDataFrame([(1, "^ko-20(06|11)", "superseded"), (2, "[.]utb$", "legacy"), (3, "-g3[.]ctb$", "special"), (4, "^ko-", "current")], "ord int, pattern string, new_status string")
    inv = table(spark, d, "inventory")
    hit = inv.join(F.broadcast(rules), F.expr("table_id rlike pattern")).groupBy("table_id").agg(F.min_by("new_status", "ord").alias("new_status"))
    return inv.join(hit, "table_id", "left").select("table_id", F.coalesce("new_status", "status").alias("status"))


def doc_category(spark, d):
    """Language of each record's first non-Latin code, falling back on the code's prefix."""
    inv = table(spark, d, "inventory").select("table_id", "base_lang")
    s = R.segments_long(_records(spark, d)).join(F.broadcast(inv), "table_id", "left").withColumn("lang", F.coalesce("base_lang", F.split_part("table_id", F.lit("-"), F.lit(1))))
    latin = F.col("lang").isin("en", "de", "fr", "es")
    each = s.groupBy("id").agg(F.min_by(F.when(~latin, F.col("lang")), F.struct(latin.cast("int"), "pos")).alias("lang"))
    return each.groupBy(F.coalesce("lang", F.lit("latin")).alias("category")).agg(F.count("*").alias("records"))


def best_current_table(spark, d):
    """Per language the table of highest grade among the current ones, else among all."""
    inv = table(spark, d, "inventory").select("base_lang", "table_id", (F.col("status") == "current").cast("int").alias("cur"), F.coalesce(F.try_to_number("grade", F.lit("9")).cast("int"), F.lit(-1)).alias("g"))
    return inv.groupBy("base_lang").agg(F.max_by("table_id", F.struct("cur", "g", "table_id")).alias("table_id"))


def table_closure(spark, d):
    """Tables reachable by stepping to the next lower grade of the same family."""
    inv = table(spark, d, "inventory").where("grade rlike '^[0-9]$'").select("table_id", F.regexp_replace("table_id", "-g[0-9][.][a-z]+$", "").alias("fam"), F.col("grade").cast("int").alias("g"))
    inv.createOrReplaceTempView("_closure_tables")
    return spark.sql(
        """WITH RECURSIVE steps AS (SELECT table_id AS top, table_id, fam, g, 0 AS depth FROM _closure_tables
           UNION ALL SELECT s.top, t.table_id, t.fam, t.g, s.depth + 1 FROM steps s JOIN _closure_tables t ON t.fam = s.fam AND t.g = s.g - 1 WHERE s.depth < 9)
           SELECT top, count(DISTINCT table_id) AS reached, cast(max(depth) AS bigint) AS depth FROM steps GROUP BY top"""
    )


def prefix_join(spark, d):
    """Codes of records met with inventory entries by family prefix."""
    codes = _records(spark, d).select(F.explode("tables").alias("code")).groupBy("code").agg(F.count("*").alias("uses"))
    fam = table(spark, d, "inventory").select(F.concat_ws("-", F.split_part("table_id", F.lit("-"), F.lit(1)), F.split_part("table_id", F.lit("-"), F.lit(2))).alias("fam")).distinct()
    return codes.withColumn("fam", F.concat_ws("-", F.split_part("code", F.lit("-"), F.lit(1)), F.split_part("code", F.lit("-"), F.lit(2)))).join(fam, "fam").groupBy("fam").agg(F.sum("uses").alias("uses"), F.count("*").alias("codes"))


def manifest_counts(spark, d):
    r = _records(spark, d)
    sets = r.groupingSets([[F.col("split")], [F.col("split"), F.col("form")], [F.col("split"), F.col("k")], []], "split", "form", "k")
    return sets.agg(F.count("*").alias("records"), F.sum("cells").alias("cells"), F.sum(F.size("tables")).alias("codes"))


def floor_report(spark, d):
    """Codes with fewer than 30 train records: how many are short."""
    n = _records(spark, d).where("split = 'train'").select(F.explode("tables").alias("table_id")).groupBy("table_id").agg(F.count("*").alias("n"))
    inv = table(spark, d, "inventory").select("table_id", "status")
    return inv.join(n, "table_id", "left").select("table_id", "status", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.lit(0), 30 - F.coalesce("n", F.lit(0))).alias("short")).where("short > 0")


QUERIES = {
    f.__name__: f
    for f in (
        latest_records, record_segments_long, record_roundtrip, record_schema_errors, record_dedup_keys, cells_by_code, braille_only, six_dot_codes, len_buckets, form_quota,
        stratified_split, round_robin_strata, nested_kshot, shard_mod, systematic_sample, hash_sides, largest_remainder_quota, table_weights, weighted_choice, draw_languages,
        sequence_ids, record_anti_join, twin_texts, confusable_siblings, status_rules, doc_category, best_current_table, table_closure, prefix_join, manifest_counts, floor_report,
    )
}

_SEGS = f"""
    SELECT id, unnest(CASE WHEN segments IS NULL THEN [{{'table_id': tables[1], 'text': text, 'braille': braille}}]
        ELSE list_transform(segments, lambda s: {{'table_id': s.table_id, 'text': s.text, 'braille': s.braille}}) END, recursive := true),
        generate_subscripts(CASE WHEN segments IS NULL THEN [1] ELSE list_transform(segments, lambda s: 1) END, 1) - 1 AS pos FROM ({_LATEST})"""
_CC = f"length(regexp_replace(braille, '{_CELLS}', '', 'g'))"


def _ranked(sql: str, part: str, seed: str, key: str = "id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {_U.format(x=chr(39) + seed + ':' + chr(39) + ' || ' + key)}, {key}) AS rank FROM ({sql})"


ORACLES = {
    "latest_records": f"SELECT split, form, count(*) AS records, sum(length(text))::BIGINT AS chars FROM ({_LATEST}) GROUP BY 1, 2",
    "record_segments_long": f"SELECT table_id, count(*) AS segments, sum(length(text))::BIGINT AS chars, max(pos)::BIGINT AS last_pos FROM ({_SEGS}) GROUP BY 1",
    "record_roundtrip": f"""
        WITH b AS (SELECT id, string_agg(text, chr(10) ORDER BY pos) AS again, count(*) AS parts FROM ({_SEGS}) GROUP BY id)
        SELECT form, count(*) AS records, sum((text = again)::INT)::BIGINT AS same, sum(parts)::BIGINT AS parts FROM ({_LATEST}) JOIN b USING (id) GROUP BY form""",
    "record_schema_errors": f"""
        SELECT error, count(*) AS records FROM (SELECT unnest(list_filter([
            CASE WHEN NOT coalesce(regexp_matches(id, '{R.FORMS_ID}'), false) THEN 'id' END, CASE WHEN NOT coalesce(split IN ('train', 'dev', 'eval'), false) THEN 'split' END,
            CASE WHEN coalesce(length(text), 0) = 0 THEN 'text' END, CASE WHEN braille IS NULL THEN 'braille' END,
            CASE WHEN braille IS NOT NULL AND NOT regexp_matches(braille, '^[\\x{{2800}}-\\x{{28FF}}\\n]*$') THEN 'braille_cells' END,
            CASE WHEN braille IS NOT NULL AND {_CC} <> cells THEN 'cells' END, CASE WHEN segments IS NOT NULL AND len(segments) <> k THEN 'k' END,
            CASE WHEN coalesce(len(tables), 0) = 0 THEN 'tables' END, CASE WHEN segments IS NOT NULL AND len(segments) <> len(tables) THEN 'tables_segments' END,
            CASE WHEN len(langs) <> len(tables) THEN 'langs' END, CASE WHEN len_bucket IS NULL THEN 'len_bucket' END, CASE WHEN source IS NULL THEN 'source' END,
            CASE WHEN n_sentences <= 0 THEN 'sentences' END, CASE WHEN confusable_set IS NOT NULL AND list_sort(confusable_set) <> confusable_set THEN 'confusable_sorted' END,
            CASE WHEN list_has_any(confusable_set, tables) THEN 'confusable_self' END], lambda x: x IS NOT NULL)) AS error FROM ({_LATEST})) GROUP BY error""",
    "record_dedup_keys": f"""
        SELECT sha1(array_to_string(tables, chr(31)) || chr(30) || text) AS key, min(id) AS id, count(*) AS copies FROM ({_LATEST}) GROUP BY 1 HAVING count(*) > 1""",
    "cells_by_code": f"SELECT tables[1] AS table_id, sum({_CC})::BIGINT AS cells, sum(cells)::BIGINT AS stated, max({_CC}) AS most FROM ({_LATEST}) WHERE braille IS NOT NULL GROUP BY 1",
    "braille_only": rf"""
        SELECT split, count(*) AS pairs, sum(coalesce(regexp_matches(tgt, '^[\x{{2800}}-\x{{28FF}}\n]*$')::INT, 0))::BIGINT AS pure,
            count(CASE WHEN regexp_matches(replace(tgt, ' ', '⠀'), '^[\x{{2800}}-\x{{28FF}}]*$') THEN 1 END) AS with_blanks, sum(length(regexp_replace(tgt, '{_CELLS}', '', 'g')))::BIGINT AS cells
        FROM nikl_pairs GROUP BY split""",
    "six_dot_codes": rf"SELECT table_id, max(regexp_matches(braille, '[\x{{2840}}-\x{{28FF}}]')::INT)::BOOLEAN AS eight_dot, count(*) AS segments FROM ({_SEGS}) WHERE braille IS NOT NULL GROUP BY 1",
    "len_buckets": f"""
        SELECT CASE WHEN cells <= 4 THEN 'snippet_1_4' WHEN cells <= 10 THEN 'snippet_5_10' WHEN cells <= 20 THEN 'snippet_11_20' WHEN cells <= 40 THEN 'snippet_21_40'
            WHEN cells <= 80 THEN 'snippet_41_80' WHEN n_sentences >= 4 THEN 'paragraph' ELSE 'sentence' END AS bucket, len_bucket, count(*) AS records FROM ({_LATEST}) GROUP BY 1, 2""",
    "form_quota": f"SELECT form, id FROM ({_ranked(f'SELECT * FROM ({_LATEST}) WHERE split = {chr(39)}train{chr(39)}', 'form', 'quota')}) WHERE rank <= 20",
    "stratified_split": f"""
        WITH r AS (SELECT id, form, doc_type FROM ({_LATEST}) WHERE split = 'train'),
        q AS (SELECT form, doc_type, greatest(1, round_even(200 * count(*) / (SELECT count(*) FROM r), 0)) AS quota FROM r GROUP BY 1, 2),
        k AS ({_ranked('SELECT * FROM r', 'form, doc_type', 'dev')})
        SELECT k.form, k.doc_type, id FROM k JOIN q ON k.form IS NOT DISTINCT FROM q.form AND k.doc_type IS NOT DISTINCT FROM q.doc_type WHERE rank <= quota""",
    "round_robin_strata": f"SELECT form, id FROM ({_ranked(f'SELECT * FROM ({_LATEST}) WHERE split = {chr(39)}eval{chr(39)}', 'form', 'rr')}) ORDER BY rank, form LIMIT 60",
    "nested_kshot": f"""
        WITH k AS ({_ranked(f'SELECT id, tables[1] AS code FROM ({_LATEST}) WHERE split = {chr(39)}train{chr(39)}', 'code', 'shots')})
        SELECT code, shots::BIGINT AS shots, count(*) AS n, min(id) AS first_id FROM k, (VALUES (4), (16), (64)) v(shots) WHERE rank <= shots GROUP BY 1, 2""",
    "shard_mod": f"SELECT split, ((row_number() OVER (PARTITION BY split ORDER BY id) - 1) % 4)::BIGINT AS shard, id FROM ({_LATEST})",
    "systematic_sample": "SELECT id, genre FROM nikl_pairs WHERE ('0x' || substr(md5(id), 1, 8))::BIGINT % 50 = 0 OR regexp_matches(src, '[0-9]+년')",
    "hash_sides": """
        SELECT CASE WHEN ('0x' || substr(sha1(src), 1, 8))::BIGINT % 5 = 0 THEN 'eval' ELSE 'train' END AS side,
            (list_sum(list_transform(string_split(sha256(doc), ''), lambda c: ('0x' || c)::INT)) % 5)::BIGINT AS doc_mod5, count(*) AS pairs FROM nikl_pairs GROUP BY 1, 2""",
    "largest_remainder_quota": """
        WITH n AS (SELECT doc, count(*) AS n FROM nikl_pairs GROUP BY doc), e AS (SELECT *, 500 * n / sum(n) OVER () AS x FROM n),
        f AS (SELECT *, floor(x) AS lo, round(x - floor(x), 9) AS rest FROM e)
        SELECT doc, n, (lo + (row_number() OVER (ORDER BY rest DESC, doc) <= 500 - sum(lo) OVER ())::INT)::BIGINT AS seats FROM f""",
    "table_weights": """
        WITH l AS (SELECT base_lang, count(*) AS n FROM inventory WHERE NOT coalesce(holdout, false) GROUP BY 1), t AS (SELECT count(*) AS tail FROM l WHERE base_lang NOT IN ('en', 'ko', 'zh'))
        SELECT table_id, round(CASE WHEN coalesce(holdout, false) THEN 0.0 WHEN base_lang = 'en' THEN 0.6 * 3.0 / 6.0 / n WHEN base_lang = 'ko' THEN 0.6 * 2.0 / 6.0 / n WHEN base_lang = 'zh' THEN 0.6 * 1.0 / 6.0 / n
            ELSE (1 - 0.6::DOUBLE) / tail / n END, 9)::DOUBLE AS table_weight FROM inventory LEFT JOIN l USING (base_lang), t""",
    "weighted_choice": f"""
        WITH c AS (SELECT table_id, round(sum(weight) OVER (ORDER BY table_id) / sum(weight) OVER (), 9) AS high FROM inventory WHERE NOT holdout),
        r AS (SELECT *, coalesce(lag(high) OVER (ORDER BY table_id), 0) AS low FROM c), u AS (SELECT {_U.format(x="'choice:' || id")} AS u FROM ({_LATEST}))
        SELECT table_id, count(*) AS draws FROM u JOIN r ON u >= low AND u < high GROUP BY 1""",
    "draw_languages": f"""
        WITH w AS (SELECT base_lang, round(sum(weight), 6) AS w FROM inventory WHERE NOT holdout GROUP BY 1)
        SELECT base_lang, round(-ln({_U.format(x="'langs:' || base_lang")}) / w, 6) AS draw FROM w WHERE w > 0 ORDER BY draw, base_lang LIMIT 5""",
    "sequence_ids": f"SELECT id, 'n-' || form || '-' || lpad(row_number() OVER (PARTITION BY form ORDER BY id)::VARCHAR, 7, '0') AS seq_id FROM ({_LATEST})",
    "record_anti_join": f"""
        WITH r AS (SELECT id, split, sha1({_LOOSE.format(x='text')}) AS k FROM ({_LATEST}))
        SELECT CASE WHEN id <> min(id) OVER (PARTITION BY k) THEN 'duplicate' WHEN k IN (SELECT k FROM r WHERE split = 'eval') THEN 'eval_overlap'
            WHEN k IN (SELECT k FROM r WHERE split = 'dev') THEN 'dev_overlap' ELSE 'kept' END AS reason, id FROM r WHERE split = 'train'""",
    "twin_texts": f"""
        WITH s AS (SELECT text, table_id, min(braille) AS braille FROM ({_SEGS}) WHERE braille IS NOT NULL GROUP BY 1, 2),
        p AS (SELECT text, count(*) AS codes, count(DISTINCT braille) AS forms, min(table_id) AS a, max(table_id) AS b FROM s GROUP BY text HAVING count(*) = 2)
        SELECT a, b, count(*) AS twins, sum((forms = 1)::INT)::BIGINT AS same_cells FROM p GROUP BY a, b""",
    "confusable_siblings": """
        WITH g AS (SELECT table_id, unnest(group_ids) AS g FROM inventory), p AS (SELECT DISTINCT a.table_id, b.table_id AS sibling FROM g a JOIN g b USING (g) WHERE a.table_id <> b.table_id)
        SELECT table_id, count(*) AS siblings, string_agg(sibling, ' ' ORDER BY sibling) AS names FROM p GROUP BY 1""",
    "status_rules": """
        SELECT table_id, CASE WHEN regexp_matches(table_id, '^ko-20(06|11)') THEN 'superseded' WHEN regexp_matches(table_id, '[.]utb$') THEN 'legacy'
            WHEN regexp_matches(table_id, '-g3[.]ctb$') THEN 'special' WHEN regexp_matches(table_id, '^ko-') THEN 'current' ELSE status END AS status FROM inventory""",
    "doc_category": f"""
        WITH s AS (SELECT id, pos, coalesce(base_lang, split_part(table_id, '-', 1)) AS lang FROM ({_SEGS}) LEFT JOIN inventory USING (table_id)),
        e AS (SELECT id, arg_min(lang, pos) FILTER (lang NOT IN ('en', 'de', 'fr', 'es')) AS lang FROM s GROUP BY id)
        SELECT coalesce(lang, 'latin') AS category, count(*) AS records FROM e GROUP BY 1""",
    "best_current_table": """
        SELECT base_lang, table_id FROM inventory QUALIFY row_number() OVER (PARTITION BY base_lang ORDER BY (status = 'current')::INT DESC, coalesce(try_cast(grade AS INT), -1) DESC, table_id DESC) = 1""",
    "table_closure": r"""
        WITH RECURSIVE t AS (SELECT table_id, regexp_replace(table_id, '-g[0-9][.][a-z]+$', '') AS fam, grade::INT AS g FROM inventory WHERE regexp_matches(grade, '^[0-9]$')),
        steps AS (SELECT table_id AS top, table_id, fam, g, 0 AS depth FROM t UNION ALL SELECT s.top, t.table_id, t.fam, t.g, s.depth + 1 FROM steps s JOIN t ON t.fam = s.fam AND t.g = s.g - 1 WHERE s.depth < 9)
        SELECT top, count(DISTINCT table_id) AS reached, max(depth)::BIGINT AS depth FROM steps GROUP BY top""",
    "prefix_join": f"""
        WITH c AS (SELECT code, count(*) AS uses FROM (SELECT unnest(tables) AS code FROM ({_LATEST})) GROUP BY 1), f AS (SELECT DISTINCT split_part(table_id, '-', 1) || '-' || split_part(table_id, '-', 2) AS fam FROM inventory)
        SELECT fam, sum(uses)::BIGINT AS uses, count(*) AS codes FROM c JOIN f ON fam = split_part(code, '-', 1) || '-' || split_part(code, '-', 2) GROUP BY 1""",
    "manifest_counts": f"""
        SELECT split, form, k, count(*) AS records, sum(cells)::BIGINT AS cells, sum(len(tables))::BIGINT AS codes FROM ({_LATEST}) GROUP BY GROUPING SETS ((split), (split, form), (split, k), ())""",
    "floor_report": f"""
        WITH n AS (SELECT table_id, count(*) AS n FROM (SELECT unnest(tables) AS table_id FROM ({_LATEST}) WHERE split = 'train') GROUP BY 1)
        SELECT table_id, status, coalesce(n, 0) AS n, greatest(0, 30 - coalesce(n, 0)) AS short FROM inventory LEFT JOIN n USING (table_id) WHERE greatest(0, 30 - coalesce(n, 0)) > 0""",
}
ORACLES["shard_mod"] = f"SELECT split, shard, count(*) AS records, min(id) AS first_id FROM ({ORACLES['shard_mod']}) GROUP BY 1, 2"
ORACLES["record_anti_join"] = f"SELECT reason, count(*) AS records FROM ({ORACLES['record_anti_join']}) GROUP BY 1"
