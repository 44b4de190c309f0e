"""Queries that build data sets: strata, samples, evaluation sets, top-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import prose as P, text as T
from textloom.operators import audit as A, builder as B, datasets as D, joins as J, lines as L, records as R
from textloom.plans.q_lines import _CLEAN, _LINES, _TEST_LINES, _U, _doc_lines, _test_lines, _units
from textloom.plans.q_records import _LATEST, _SEGS, _records
from textloom.session import table


def made_numerals(spark, d):
    """Made-up numerals of seven kinds for every record."""
    r = _records(spark, d).select("id")
    n = r.withColumn("kind", F.floor(T.uniform("numeral", "id") * 7).cast("int")).withColumn("numeral", P.numerals(F.col("kind"), T.uniform("numeral:u", "id"), T.uniform("numeral:v", "id")))
    return n.select("id", F.col("kind").cast("bigint").alias("kind"), "numeral")


def made_identifiers(spark, d):
    """A thousand made-up identifiers in carrier sentences."""
    return D.identifiers(spark, 1000, "ident").select("id", "kind", "text")


def spliced_texts(spark, d):
    """Train texts with spans of another script: by density, and whether the spans were there already."""
    r = _records(spark, d).where("split = 'train'").select("id", "text")
    s = D.with_density(r, "⟪x⟫", "dense")
    return s.groupBy("switch_density", "natural").agg(F.count("*").alias("texts"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("⟪x⟫"), F.lit("")))).alias("span_chars"))


def snippet_quota(spark, d):
    """Snippets of one to forty characters in equal quotas of the five buckets, with what each bucket lacks."""
    s = R.segments_long(_records(spark, d)).where("text is not null").withColumn("key", F.concat_ws(":", "id", "pos"))
    n = F.floor(T.uniform("cut", "key") * 60).cast("int") + 1
    snip = s.select("key", F.substring("text", F.lit(1), n).alias("t")).where("length(t) > 0")
    size = F.length("t")
    bucket = F.when(size <= 4, "snippet_1_4").when(size <= 10, "snippet_5_10").when(size <= 20, "snippet_11_20").when(size <= 40, "snippet_21_40").otherwise("sentence")
    rows = snip.withColumn("bucket", bucket)
    cells = spark.createDataFrame([(b,) for b in D.SNIPPET_BUCKETS], "bucket string")
    kept, report = D.taken(rows, ["bucket"], D.equal_quotas(cells, 502, "bucket"), "snips", "key")
    return report.join(kept.groupBy("bucket").agg(F.min("key").alias("first")), "bucket", "left").select("bucket", "quota", "got", "short", "first")


def document_sample(spark, d):
    """Dev sentences by edition and genre: whole documents, then one run of a last one, with a margin over the quota."""
    p = table(spark, d, "nikl_pairs").where("split = 'dev'").select("id", "ed", "genre", "doc")
    rows, quotas = D.whole_documents(p, 400, ["ed", "genre"], "doc", "id", "sample")
    got = rows.groupBy("_s").agg(F.count("*").alias("rows"), F.count_distinct("doc").alias("docs"), F.count_distinct(F.when(~F.col("whole"), F.col("doc"))).alias("cut"), F.min("id").alias("first"))
    return quotas.join(got, "_s", "left").select(F.col("_s").alias("stratum"), "quota", "rows", "docs", "cut", "first")


def sample_drops(spark, d):
    """The same rows by why they'd be dropped: in the test set, near it, or without pure cells."""
    pairs = table(spark, d, "nikl_pairs")
    p = pairs.where("split = 'dev' and src is not null").select("id", "ed", "genre", "doc", "src", "tgt")
    rows, _ = D.whole_documents(p, 400, ["ed", "genre"], "doc", "id", "sample")
    test = pairs.where("split = 'test' and src is not null").select("id", "src")
    near = J.near_duplicate_reasons(rows.select("id", "src"), test, "id", "src").select(F.col("key").alias("id"), F.col("reason").alias("near"))
    same = test.select("src").distinct().withColumn("same", F.lit(True))
    joined = rows.join(same, "src", "left").join(near, "id", "left")
    why = F.when(F.col("same"), "in_test").when(F.col("near").isNotNull(), F.col("near")).when(T.with_blank_cells("tgt").isNull(), "cells").otherwise("kept")
    return joined.groupBy(why.alias("why")).agg(F.count("*").alias("rows"))


def formula_rows(spark, d):
    """Formulas once each, by side and by whether they stand alone, up to ten of each kind."""
    r = _records(spark, d).select("id", "text", "latex_canonical")
    kept, report = D.formula_rows(r, "latex_canonical", "text", 10, 10, "formulas", "id")
    return report.join(kept.groupBy("side", "kind").agg(F.min("id").alias("first")), ["side", "kind"], "left").select("side", "kind", "quota", "got", "short", "first")


def core_per_code(spark, d):
    """Evaluation core: the 45 heaviest codes with up to six records each, others up to three, with what each lacks."""
    inv = table(spark, d, "inventory").where("not holdout and weight > 0").groupBy("table_id").agg(F.max("weight").alias("weight"))
    quota = D.ranked_quotas(inv, "table_id", "weight", 45, 6, 3)
    r = _records(spark, d).where("k = 1").select("id", F.get("tables", F.lit(0)).alias("table_id"))
    _, report = D.taken(r, ["table_id"], quota, "core", "id")
    return report.select("table_id", "quota", "got", "short")


def zero_shot(spark, d):
    """Records of the codes that training doesn't see, up to five of each."""
    quota = table(spark, d, "inventory").where("holdout").select("table_id", F.lit(5).cast("bigint").alias("quota")).distinct()
    r = _records(spark, d).where("k = 1").select("id", F.get("tables", F.lit(0)).alias("table_id"))
    kept, report = D.taken(r, ["table_id"], quota, "zero", "id")
    return report.join(kept.groupBy("table_id").agg(F.max("id").alias("last")), "table_id", "left").select("table_id", "quota", "got", "last")


def mixed_grid(spark, d):
    """Documents of two, three and four segments of different codes, and of codes of one group that are easily taken for each other."""
    s = R.segments_long(_records(spark, d)).select(F.concat_ws(":", "id", "pos").alias("key"), "table_id")
    groups = table(spark, d, "inventory").select("table_id", F.get("group_ids", F.lit(0)).alias("grp")).where("grp is not null").distinct()
    free = D.mixed_grid(s, [2, 3, 4], "grid", "key").select(F.lit("uniform").alias("regime"), "k", "segments")
    near = D.mixed_grid(s.join(groups, "table_id"), [2, 3, 4], "grid", "key", "grp").select(F.lit("confusable").alias("regime"), "k", "segments")
    both = free.unionAll(near)
    return both.groupBy("regime", F.col("k").cast("bigint").alias("k")).agg(F.count("*").alias("documents"), F.min(F.array_join(F.transform("segments", lambda x: x["key"]), " ")).alias("least"))


def noise_variants(spark, d):
    """Evaluation cells with flipped dots at three levels, and what the audit of such rows has against them."""
    base = _records(spark, d).where("split = 'eval' and braille is not null")
    noisy = D.noise_variants(base, "dots")
    bad = A.bad_noise(noisy.where("noise_n_dots = 6"), base).agg(F.count("*").alias("violations"))
    return noisy.groupBy("noise_p").agg(F.count("*").alias("variants"), F.sum((F.col("noise_n_flips") < 1).cast("bigint")).alias("unchanged")).crossJoin(bad)


def pointer_rows(spark, d):
    """The sealed test sentences by id alone."""
    return D.pointers(table(spark, d, "nikl_pairs"))


def topped_up(spark, d):
    """Runs of two lines without a unit of the held-out sentences or of one another."""
    lines = L.clean_lines(_doc_lines(spark, d)).where("lang is not null")
    out = D.topped_up(lines.select("doc_id", "pos", "line"), _test_lines(spark, d), 2, "top")
    return out.agg(F.count("*").alias("spans"), F.min("span").alias("least"), F.sum(F.length("text")).alias("chars"))


def pointer_pairs(spark, d):
    """Records that point to a pair, met with it: which are there, which have no cells, which point to nothing."""
    p = table(spark, d, "nikl_pairs").select(F.col("id").alias("nikl_id"), "src", "tgt")
    r = _records(spark, d).where("nikl_id is not null").select("id", "nikl_id", "text").join(p, "nikl_id", "left")
    why = F.when(F.col("src").isNull(), "missing").when(F.col("tgt").isNull(), "no_cells").when(F.col("src") != F.col("text"), "other_text").otherwise("same")
    return r.groupBy(why.alias("why")).agg(F.count("*").alias("records"))


def pair_drops(spark, d):
    """Why pairs are no rows of an evaluation set, by genre; the first reason counts."""
    p = table(spark, d, "nikl_pairs")
    cells = F.translate("tgt", " ", "⠀")
    why = (
        F.when(F.coalesce(F.trim("src"), F.lit("")) == "", "empty").when(F.col("src").contains("\n"), "line_break").when(F.col("tgt").isNull(), "no_cells")
        .when(~T.is_cells(cells, False), "not_cells").when(F.length("tgt") > 4 * F.length("src"), "long_cells").otherwise("kept")
    )
    return p.groupBy("genre", why.alias("why")).agg(F.count("*").alias("pairs"))


def contiguous_slices(spark, d):
    """Dev sentences in order, cut into seven slices of nearly equal size."""
    p = table(spark, d, "nikl_pairs").where("split = 'dev'").select("id")
    return D.slices(p, ["id"], 7).groupBy("slice").agg(F.count("*").alias("rows"), F.min("id").alias("first"), F.max("id").alias("last"))


def probed_documents(spark, d):
    """Documents of pairs kept if four fifths of their first ten pairs have pure cells."""
    p = table(spark, d, "nikl_pairs")
    return D.probed(p, "doc", "id", F.coalesce(T.with_blank_cells("tgt").isNotNull(), F.lit(False)), 10, 0.8)


def snippet_groups(spark, d):
    """The eight groups of codes to take snippets from: all of scripts, then the largest others."""
    g = table(spark, d, "inventory").select("table_id", F.explode("group_ids").alias("grp")).groupBy("grp").agg(F.count_distinct("table_id").alias("tables"))
    return g.orderBy(F.desc(F.startswith("grp", F.lit("script:"))), F.desc("tables"), "grp").limit(8)


QUERIES = {
    f.__name__: f
    for f in (
        made_numerals, made_identifiers, spliced_texts, snippet_quota, document_sample, sample_drops, formula_rows, core_per_code, zero_shot, mixed_grid, noise_variants, pointer_rows, pointer_pairs, pair_drops, contiguous_slices, topped_up,
        probed_documents, snippet_groups,
    )
}

_u = lambda seed, key="id": _U.format(x=f"'{seed}:' || {key}")
_HEX = "('0x' || substr(sha1({x}), 1, 13))::BIGINT"


def _pick(choices: list[str], u: str) -> str:
    return "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in choices) + f"][floor({u} * {len(choices)})::INT + 1]"


def _int(u: str, low: int, high: int) -> str:
    return f"({low} + floor({u} * {high - low + 1}))::BIGINT"


def _word(seed: str, x: str) -> str:
    """A span put before a later word of x, as its uniform number says."""
    w = f"string_split({x}, ' ')"
    at = f"least(floor({_u(seed)} * (len({w}) - 1))::INT + 1, len({w}) - 1)"
    return f"CASE WHEN len({w}) < 2 THEN {x} ELSE array_to_string(list_concat(list_concat(({w})[1:{at}], ['⟪x⟫']), ({w})[{at} + 1:len({w})]), ' ') END"


_KIND = f"floor({_u('numeral')} * 7)::INT"
_A, _B = _u("numeral:u"), _u("numeral:v")
_DAY = f"(DATE '1950-01-01' + {_int(_A, 0, 29_000)}::INT)"
_DOCS = f"""
    sizes AS (SELECT ed || genre AS s, doc, count(*) AS size FROM dev GROUP BY 1, 2), totals AS (SELECT s, sum(size) AS w FROM sizes GROUP BY 1),
    e AS (SELECT s, 400 * w / sum(w) OVER () AS x FROM totals), f AS (SELECT *, floor(x) AS lo, round(x - floor(x), 9) AS rest FROM e),
    quotas AS (SELECT s, (lo + (row_number() OVER (ORDER BY rest DESC, s) <= 400 - sum(lo) OVER ())::INT)::BIGINT AS quota FROM f),
    o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY s ORDER BY {_u('sample', 'doc')}, doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes),
    c AS (SELECT s, doc, quota, size, quota + floor(quota * 0.15::DOUBLE)::BIGINT + 8 - before AS room FROM o JOIN quotas USING (s) WHERE quota > 0),
    r AS (SELECT *, size <= room AS whole, floor({_u('sample:run', 'doc')} * (size - room + 1)) AS start FROM c WHERE room > 0),
    n AS (SELECT *, ed || genre AS s, row_number() OVER (PARTITION BY ed || genre, doc ORDER BY id) AS n FROM dev),
    taken AS (SELECT n.*, quota, whole FROM n JOIN r USING (s, doc) WHERE whole OR (n > start AND n <= start + room))"""


def _grid(rows: str, regime: str, group: str) -> str:
    part = f", {group}" if group else ""
    return f"""
        SELECT '{regime}' AS regime, k, doc, string_agg(key, ' ' ORDER BY table_id, key) AS least FROM (
            SELECT *, concat_ws('-', r{part}, slot // k) AS doc, count(*) OVER (PARTITION BY k, r{part}, slot // k) AS held FROM (
                SELECT *, row_number() OVER (PARTITION BY r{part} ORDER BY {_u('grid', 'table_id')}, table_id) - 1 AS slot FROM (
                    SELECT *, row_number() OVER (PARTITION BY table_id{part} ORDER BY {_HEX.format(x="'grid:' || key")}, key) AS r FROM ({rows}))), (VALUES (2), (3), (4)) v(k)) WHERE held = k GROUP BY k, doc"""


_KEYED = f"SELECT id || ':' || pos AS key, table_id FROM ({_SEGS})"
ORACLES = {
    "made_numerals": f"""
        SELECT id, ({_KIND})::BIGINT AS kind, CASE {_KIND} WHEN 0 THEN {_int(_A, 1900, 2030)}::VARCHAR WHEN 1 THEN format('{{:,}}', {_int(_A, 1_000, 9_999_999)})
            WHEN 2 THEN {_int(_A, 0, 999)} || '.' || lpad(({_int(_B, 0, 99)})::VARCHAR, 2, '0') WHEN 3 THEN strftime({_DAY}, '%Y-%m-%d') WHEN 4 THEN strftime({_DAY}, '%-d %B %Y')
            WHEN 5 THEN {_int(_A, 0, 100)} || '%' ELSE {_int(_A, 0, 23)} || ':' || lpad(({_int(_B, 0, 59)})::VARCHAR, 2, '0') END AS numeral FROM ({_LATEST})""",
    "made_identifiers": f"""
        WITH i AS (SELECT range AS id, {_u('ident:kind', 'range')} AS k, {_u('ident:a', 'range')} AS a, {_u('ident:b', 'range')} AS b, {_u('ident:c', 'range')} AS c, {_u('ident:d', 'range')} AS d, {_u('ident:carrier', 'range')} AS u FROM range(1000)),
        m AS (SELECT id, u, CASE WHEN k < 0.45::DOUBLE THEN 'url' WHEN k < 0.6::DOUBLE THEN 'arxiv' WHEN k < 0.75::DOUBLE THEN 'doi' WHEN k < 0.92::DOUBLE THEN 'email' ELSE 'isbn' END AS kind,
            {_pick(['https://', 'http://', ''], 'a')} || {_pick(D._HOSTS, 'b')} || '/' || {_int('c', 1, 9999)} AS url, 'arXiv:' || {_int('a', 1501, 2512)} || '.' || lpad({_int('b', 1, 29999)}::VARCHAR, 5, '0') AS arxiv,
            'doi:10.' || {_int('a', 1000, 99999)} || '/' || {_int('b', 100000, 9999999)} AS doi, {_pick(D._USERS, 'a')} || '@' || {_pick(D._HOSTS, 'b')} AS email,
            'ISBN 978-' || {_int('a', 0, 9)} || '-' || {_int('b', 100, 999)} || '-' || {_int('c', 10000, 99999)} || '-' || {_int('d', 0, 9)} AS isbn FROM i)
        SELECT id, kind, replace({_pick(D._CARRIERS, 'u')}, '{{}}', CASE kind WHEN 'url' THEN url WHEN 'arxiv' THEN arxiv WHEN 'doi' THEN doi WHEN 'email' THEN email ELSE isbn END) AS text FROM m""",
    "spliced_texts": f"""
        WITH r AS (SELECT id, text, len(regexp_extract_all(text, '[A-Za-z]{{2,}}(?:[ ''-][A-Za-z]{{2,}})*')) AS n, {_u('dense')} < 0.5::DOUBLE AS heavy FROM ({_LATEST}) WHERE split = 'train'),
        a AS (SELECT *, {_word('dense:0', 'text')} AS t1 FROM r), b AS (SELECT *, {_word('dense:1', 't1')} AS t2 FROM a), c AS (SELECT *, {_word('dense:2', 't2')} AS t3 FROM b),
        o AS (SELECT CASE WHEN n > 2 THEN 'heavy' WHEN n > 0 THEN 'light' WHEN heavy THEN 'heavy' ELSE 'light' END AS switch_density, n > 0 AS "natural", CASE WHEN n > 0 THEN text WHEN heavy THEN t3 ELSE t1 END AS t FROM c)
        SELECT switch_density, "natural", count(*) AS texts, sum(length(t) - length(replace(t, '⟪x⟫', '')))::BIGINT AS span_chars FROM o GROUP BY 1, 2""",
    "snippet_quota": f"""
        WITH s AS (SELECT key, substr(text, 1, floor({_u('cut', 'key')} * 60)::INT + 1) AS t FROM (SELECT id || ':' || pos AS key, text FROM ({_SEGS}) WHERE text IS NOT NULL)),
        b AS (SELECT key, CASE WHEN length(t) <= 4 THEN 'snippet_1_4' WHEN length(t) <= 10 THEN 'snippet_5_10' WHEN length(t) <= 20 THEN 'snippet_11_20' WHEN length(t) <= 40 THEN 'snippet_21_40' ELSE 'sentence' END AS bucket FROM s WHERE length(t) > 0),
        q AS (SELECT bucket, (502 // 5 + (row_number() OVER (ORDER BY bucket) <= 502 % 5)::INT)::BIGINT AS quota FROM (VALUES {', '.join(f"('{b}')" for b in D.SNIPPET_BUCKETS)}) v(bucket)),
        r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {_HEX.format(x="'snips:' || key")}, key) AS nth FROM b)
        SELECT bucket, quota, count(key) AS got, quota - count(key) AS short, min(key) AS first FROM q LEFT JOIN (SELECT r.* FROM r JOIN q USING (bucket) WHERE nth <= quota) k USING (bucket) GROUP BY 1, 2""",
    "document_sample": f"""
        WITH dev AS (SELECT id, ed, genre, doc FROM nikl_pairs WHERE split = 'dev'), {_DOCS}
        SELECT q.s AS stratum, q.quota, count(id) AS rows, count(DISTINCT doc) AS docs, count(DISTINCT doc) FILTER (NOT whole) AS cut, min(id) AS first FROM quotas q JOIN taken USING (s) GROUP BY 1, 2""",
    "formula_rows": f"""
        WITH f AS (SELECT latex_canonical AS c, min(id) AS id, arg_min(text, id) AS text FROM ({_LATEST}) WHERE latex_canonical IS NOT NULL GROUP BY 1),
        s AS (SELECT *, CASE WHEN ('0x' || substr(sha1(c), 1, 8))::BIGINT % 5 = 0 THEN 'eval' ELSE 'train' END AS side, CASE WHEN text = c THEN 'standalone' ELSE 'embedded' END AS kind FROM f),
        r AS (SELECT *, row_number() OVER (PARTITION BY side, kind ORDER BY {_HEX.format(x="'formulas:' || id")}, id) AS nth FROM s)
        SELECT side, kind, 10::BIGINT AS quota, count(*) AS got, 10 - count(*) AS short, min(id) AS first FROM r WHERE nth <= 10 GROUP BY 1, 2""",
    "core_per_code": f"""
        WITH i AS (SELECT table_id, max(weight) AS weight FROM inventory WHERE NOT holdout AND weight > 0 GROUP BY 1), q AS (SELECT table_id, CASE WHEN row_number() OVER (ORDER BY weight DESC, table_id) <= 45 THEN 6 ELSE 3 END::BIGINT AS quota FROM i),
        n AS (SELECT tables[1] AS table_id, count(*) AS n FROM ({_LATEST}) WHERE k = 1 GROUP BY 1)
        SELECT table_id, quota, least(quota, coalesce(n, 0)) AS got, quota - least(quota, coalesce(n, 0)) AS short FROM q LEFT JOIN n USING (table_id)""",
    "zero_shot": f"""
        WITH r AS (SELECT id, tables[1] AS table_id, row_number() OVER (PARTITION BY tables[1] ORDER BY {_HEX.format(x="'zero:' || id")}, id) AS nth FROM ({_LATEST}) WHERE k = 1)
        SELECT i.table_id, 5::BIGINT AS quota, count(id) AS got, max(id) AS last FROM (SELECT DISTINCT table_id FROM inventory WHERE holdout) i LEFT JOIN (SELECT * FROM r WHERE nth <= 5) r USING (table_id) GROUP BY 1""",
    "mixed_grid": f"""
        WITH s AS ({_KEYED}), g AS (SELECT DISTINCT table_id, group_ids[1] AS grp FROM inventory WHERE group_ids[1] IS NOT NULL)
        SELECT regime, k::BIGINT AS k, count(*) AS documents, min(least) AS least FROM ({_grid('SELECT * FROM s', 'uniform', '')} UNION ALL {_grid('SELECT s.*, grp FROM s JOIN g USING (table_id)', 'confusable', 'grp')}) GROUP BY 1, 2""",
    "noise_variants": rf"""
        SELECT p::DOUBLE AS noise_p, count(*) AS variants, 0::BIGINT AS unchanged, 0::BIGINT AS violations FROM (SELECT * FROM ({_LATEST}) WHERE split = 'eval' AND braille IS NOT NULL AND regexp_matches(braille, '[\x{{2800}}-\x{{28FF}}]')), (VALUES (0.005), (0.01), (0.02)) v(p) GROUP BY 1""",
    "pointer_rows": "SELECT id AS nikl_id, doc, ed, genre, split FROM nikl_pairs WHERE split = 'test'",
    "pointer_pairs": f"""
        SELECT CASE WHEN src IS NULL THEN 'missing' WHEN tgt IS NULL THEN 'no_cells' WHEN src <> text THEN 'other_text' ELSE 'same' END AS why, count(*) AS records
        FROM (SELECT id, nikl_id, text FROM ({_LATEST}) WHERE nikl_id IS NOT NULL) r LEFT JOIN (SELECT id AS nikl_id, src, tgt FROM nikl_pairs) p USING (nikl_id) GROUP BY 1""",
    "pair_drops": r"""
        SELECT genre, CASE WHEN coalesce(trim(src, ' '), '') = '' THEN 'empty' WHEN contains(src, chr(10)) THEN 'line_break' WHEN tgt IS NULL THEN 'no_cells'
            WHEN NOT regexp_matches(replace(tgt, ' ', '⠀'), '^[\x{2800}-\x{28FF}]*$') THEN 'not_cells' WHEN length(tgt) > 4 * length(src) THEN 'long_cells' ELSE 'kept' END AS why, count(*) AS pairs FROM nikl_pairs GROUP BY 1, 2""",
    "contiguous_slices": """
        WITH p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n, count(*) OVER () AS m FROM nikl_pairs WHERE split = 'dev'),
        s AS (SELECT id, (SELECT max(k) FROM range(7) r(k) WHERE floor(k * m / 7) <= n) AS slice FROM p)
        SELECT slice, count(*) AS rows, min(id) AS first, max(id) AS last FROM s GROUP BY slice""",
    "topped_up": f"""
        WITH l AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM ({_CLEAN}) WHERE lang IS NOT NULL), sp AS (SELECT doc_id || ':' || pos AS span, line || ' ' || nxt AS line FROM l WHERE nxt IS NOT NULL),
        u AS ({_units('SELECT * FROM sp', 'span')}), t AS ({_units(_TEST_LINES, 'doc_id')}), bad AS (SELECT DISTINCT span FROM u WHERE h IN (SELECT h FROM t)),
        f AS (SELECT span, h, row_number() OVER (PARTITION BY h ORDER BY {_u('top', 'span')}, span) AS r FROM u WHERE span NOT IN (SELECT span FROM bad)), lost AS (SELECT DISTINCT span FROM f WHERE r > 1)
        SELECT count(*) AS spans, min(span) AS least, sum(length(line))::BIGINT AS chars FROM sp WHERE span NOT IN (SELECT span FROM bad) AND span NOT IN (SELECT span FROM lost)""",
    "probed_documents": r"""
        WITH p AS (SELECT doc, coalesce(regexp_matches(replace(tgt, ' ', '⠀'), '^[\x{2800}-\x{28FF}]*$'), false) AS ok, row_number() OVER (PARTITION BY doc ORDER BY id) AS r FROM nikl_pairs)
        SELECT doc, count(*) AS probed, sum(ok::INT)::BIGINT AS agreeing, sum(ok::INT) >= ceil(count(*) * 0.8::DOUBLE - 1e-9) AS kept FROM p WHERE r <= 10 GROUP BY doc""",
    "snippet_groups": "SELECT grp, count(DISTINCT table_id) AS tables FROM (SELECT table_id, unnest(group_ids) AS grp FROM inventory) GROUP BY 1 ORDER BY starts_with(grp, 'script:') DESC, tables DESC, grp LIMIT 8",
}
