"""Queries over the lines and units of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import lines as L
from textloom.session import table

# SQL pieces shared by the counterparts.
_STRIP = r"regexp_replace({x}, '^[ \t]+|[ \t]+$', '', 'g')"
_SQZ = r"trim(regexp_replace({x}, '[ \t\r\n]+', ' ', 'g'), ' ')"
# DuckDB has no NFKC and no case folding: what the tables hold of them is written out (full-width letters and digits,
# ordinal letters, sharp s, final sigma, Thai sara am); tests compare the rest with the definition.
_WIDE = "".join(chr(i) for a, z in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)) for i in range(a, z + 1))
_LOOSE = (
    f"regexp_replace(nfc_normalize(replace(replace(translate(lower({{x}}), '{_WIDE}ªºς', '{''.join(chr(ord(c) - 0xFEE0) for c in _WIDE).lower()}aoσ'), 'ß', 'ss'), chr(3635), chr(3661) || chr(3634))), "
    + r"'[\p{{P}}\p{{S}}\p{{Z}}\p{{Cc}}\p{{Cf}}]+', '', 'g')"
)
_KEY = "(('0x' || substr(sha1({x}), 1, 16))::UBIGINT::HUGEINT - CASE WHEN substr(sha1({x}), 1, 1) >= '8' THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT"
_U = "(('0x' || substr(sha1({x}), 1, 13))::BIGINT)::DOUBLE / pow(2, 52)"
_LINES = "SELECT doc_id, source, lang, unnest(string_split(nfc_normalize(text), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL"
_CLEAN = f"SELECT * REPLACE ({_STRIP.format(x='line')} AS line) FROM ({_LINES}) WHERE length({_STRIP.format(x='line')}) BETWEEN 20 AND 600"


def _subs(x: str) -> str:
    marked = rf"regexp_replace(regexp_replace({x}, '([.!?…؟।])[ ]+', '\1⟂', 'g'), '([。！？；;])', '\1⟂', 'g')"
    return (
        f"list_filter(list_transform(string_split({marked}, '⟂'), lambda p: trim(p, ' ')), "
        f"lambda p: length(p) >= 16 OR (length(p) >= 8 AND regexp_matches(p, '[\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FFF}}]')))"
    )


def _units(lines_sql: str, key: str) -> str:
    sqz = _SQZ.format(x="line")
    return f"""
        SELECT DISTINCT {key}, unnest(list_filter([{_KEY.format(x=_SQZ.format(x='unit'))},
            CASE WHEN length({_LOOSE.format(x='unit')}) >= 8 THEN {_KEY.format(x="'~' || " + _LOOSE.format(x='unit'))} END], lambda h: h IS NOT NULL)) AS h
        FROM (SELECT {key}, unnest(list_distinct(list_concat([{sqz}], {_subs('line')}))) AS unit FROM ({lines_sql})) WHERE unit <> ''"""


def _doc_lines(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split(T.nfc("text"), "\n")).alias("pos", "line"))


def _test_lines(spark, d):
    return table(spark, d, "nikl_pairs").where("split = 'test' and src is not null").select(F.col("id").alias("doc_id"), F.explode(F.split(T.nfc("src"), "\n")).alias("line"))


def line_clean(spark, d):
    return L.clean_lines(_doc_lines(spark, d)).groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def line_dedup_first_wins(spark, d):
    lines = L.clean_lines(_doc_lines(spark, d)).select(F.sha1("line").alias("h"), "doc_id", "pos")
    return L.first_of_each(lines, "h", ["doc_id", "pos"]).select("h", "doc_id", F.col("pos").cast("bigint").alias("pos"))


def source_preference(spark, d):
    lines = L.clean_lines(_doc_lines(spark, d)).where("lang is not null")
    best = L.prefer_sources(lines, {"wiki_pool_a": 0, "flores_like": 1, "helpdesk": 2}, "lang")
    return best.groupBy("lang", "source").agg(F.count("*").alias("lines"))


def sourced_langs(spark, d):
    return L.clean_lines(_doc_lines(spark, d)).where("lang is not null").select(F.lower(F.substring("lang", 1, 2)).alias("lang")).distinct()


def contamination_units(spark, d):
    """Documents that share a line or sub-sentence with the held-out sentences, by language and source."""
    docs = table(spark, d, "documents")
    hits = L.units_in(L.text_units(_doc_lines(spark, d), distinct=False), L.text_units(_test_lines(spark, d)))
    joined = docs.select("doc_id", "lang", "source").join(hits, "doc_id", "left")
    return joined.groupBy("lang", "source").agg(F.count("*").alias("documents"), F.count("hits").alias("leaking"), F.sum(F.coalesce("hits", F.lit(0))).alias("units"))


def unit_counts(spark, d):
    return L.text_units(_doc_lines(spark, d)).groupBy("doc_id").agg(F.count("*").alias("units"))


def eval_anti_join(spark, d):
    """Clean lines that no held-out sentence shares, loosely compared."""
    test = _test_lines(spark, d).select(T.loose("line").alias("k")).distinct()
    lines = L.clean_lines(_doc_lines(spark, d)).withColumn("k", T.loose("line"))
    return lines.join(test, "k", "left_anti").groupBy("source").agg(F.count("*").alias("lines"))


def alpha_ratio_filter(spark, d):
    ok = L.clean_lines(_doc_lines(spark, d)).where(T.letters("line") >= 0.5 * F.length(F.regexp_replace("line", "[ ]", "")))
    return ok.groupBy("source").agg(F.count("*").alias("lines"))


def latin_runs(spark, d):
    lines = L.clean_lines(_doc_lines(spark, d))
    return lines.groupBy("source").agg(F.sum(T.latin_runs("line")).alias("runs"), F.sum((T.latin_share("line") > 0.5).cast("bigint")).alias("latin_lines"))


_REASONS = ["length", "unterminated", "no_capital", "mathematics", "digits", "unbalanced"]


def _rejected(spark, d):
    x = F.col("line")
    quotes = F.length(x) - F.length(F.regexp_replace(x, "[“”]", ""))
    return L.reject_reasons(
        _doc_lines(spark, d).withColumn("line", T.stripped("line")),
        [
            ("length", ~F.length(x).between(25, 300)),
            ("unterminated", ~x.rlike("[.!?…。！？।][”»」]?$")),
            ("no_capital", x.rlike("^[a-z]")),
            ("mathematics", x.contains("$")),
            ("digits", F.length(F.regexp_replace(x, "[^0-9]", "")) > 8),
            ("unbalanced", quotes % 2 == 1),
        ],
    )


def reject_reason_ordered(spark, d):
    return _rejected(spark, d).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("lines"))


def rejection_pivot(spark, d):
    return L.reason_table(_rejected(spark, d), "source", _REASONS)


_REJECT_SQL = rf"""
    SELECT source, CASE WHEN length(line) NOT BETWEEN 25 AND 300 THEN 'length'
        WHEN NOT regexp_matches(line, '[.!?…。！？।][”»」]?$') THEN 'unterminated'
        WHEN regexp_matches(line, '^[a-z]') THEN 'no_capital'
        WHEN contains(line, '$') THEN 'mathematics'
        WHEN length(regexp_replace(line, '[^0-9]', '', 'g')) > 8 THEN 'digits'
        WHEN (length(line) - length(regexp_replace(line, '[“”]', '', 'g'))) % 2 = 1 THEN 'unbalanced' END AS reason
    FROM (SELECT source, {_STRIP.format(x='line')} AS line FROM ({_LINES}))"""


def clean_runs(spark, d):
    lines = _doc_lines(spark, d).withColumn("ok", F.length(T.stripped("line")).between(20, 600))
    runs = L.clean_runs(lines, "doc_id", "pos", "ok")
    return runs.groupBy("k").agg(F.sum("runs").alias("runs"), F.sum((F.col("runs") > 0).cast("bigint")).alias("documents")).select(F.col("k").cast("bigint").alias("k"), "runs", "documents")


def consecutive_runs(spark, d):
    runs = L.consecutive(L.clean_lines(_doc_lines(spark, d)), 3)
    return runs.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.sha1("run").alias("run"))


def carve_blocks(spark, d):
    lines = L.carve_blocks(L.clean_lines(_doc_lines(spark, d)), 0.03, 8, "carve")
    return lines.groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.col("held_out").cast("bigint")).alias("held_out"))


def word_ngrams(spark, d):
    return L.word_ngrams(L.clean_lines(_doc_lines(spark, d)), 3).where("uses >= 5")


def wordlist_top(spark, d):
    words = L.clean_lines(_doc_lines(spark, d)).select(F.explode(F.regexp_extract_all(F.lower("line"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("uses"))
    return counts.orderBy(F.desc("uses"), "word").limit(50)


def running_distinct(spark, d):
    lines = L.clean_lines(_doc_lines(spark, d)).select("source", "doc_id", F.col("pos").cast("bigint").alias("pos"), F.sha1("line").alias("h"))
    return L.running_distinct(lines, "source", ["doc_id", "pos"], "h", 40).groupBy("source").agg(F.count("*").alias("rows_read"), F.max("distinct_so_far").alias("kept"))


def source_overlap_matrix(spark, d):
    keys = L.clean_lines(_doc_lines(spark, d)).select("source", F.sha1("line").alias("h")).distinct()
    other = keys.select(F.col("source").alias("other"), "h")
    return keys.join(other, "h").where("source < other").groupBy("source", "other").agg(F.count("*").alias("shared"))


def registry_symdiff(spark, d):
    """Units only in the first wiki pool, only in the second, and in both."""
    units = L.text_units(_doc_lines(spark, d).where("source in ('wiki_pool_a', 'wiki_pool_b')").select(F.col("source").alias("doc_id"), "line"))
    sides = units.groupBy("h").agg(F.max((F.col("doc_id") == "wiki_pool_a").cast("int")).alias("a"), F.max((F.col("doc_id") == "wiki_pool_b").cast("int")).alias("b"))
    return sides.groupBy(F.when(F.expr("a = 1 and b = 1"), "both").when(F.expr("a = 1"), "first").otherwise("second").alias("side")).agg(F.count("*").alias("units"))


def set_digest(spark, d):
    """Order-independent digest of the line keys of each source: sums of key parts over distinct keys."""
    keys = L.clean_lines(_doc_lines(spark, d)).select("source", T.key64("line").alias("h")).distinct()
    return keys.groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.col("h") % 1000000007).alias("sum_a"), F.sum(F.col("h") % 998244353).alias("sum_b"), F.min("h").alias("least"), F.max("h").alias("most")
    )


def registry_set_ops(spark, d):
    """Distinct loose keys of train lines and of held-out sentences: union, intersection, differences."""
    a = L.clean_lines(_doc_lines(spark, d)).select(T.key64(T.loose("line")).alias("h")).distinct()
    b = _test_lines(spark, d).select(T.key64(T.loose("line")).alias("h")).distinct()
    ops = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "first_only": a.exceptAll(b), "second_only": b.subtract(a)}
    out = None
    for name, rows in ops.items():
        part = rows.agg(F.count("*").alias("keys")).select(F.lit(name).alias("op"), "keys")
        out = part if out is None else out.unionAll(part)
    return out


def sub_sentence_counts(spark, d):
    return _doc_lines(spark, d).select("source", F.explode(T.sub_sentences("line")).alias("s")).groupBy("source").agg(F.count("*").alias("pieces"), F.sum(F.length("s")).alias("chars"))


def sentence_counts(spark, d):
    return table(spark, d, "nikl_pairs").where("src is not null").groupBy("genre").agg(F.sum(T.sentence_count("src")).cast("bigint").alias("sentences"), F.count("*").alias("pairs"))


QUERIES = {
    f.__name__: f
    for f in (
        line_clean, line_dedup_first_wins, source_preference, sourced_langs, contamination_units, unit_counts, eval_anti_join, alpha_ratio_filter, latin_runs,
        reject_reason_ordered, rejection_pivot, clean_runs, consecutive_runs, carve_blocks, word_ngrams, wordlist_top, running_distinct, source_overlap_matrix,
        registry_symdiff, set_digest, registry_set_ops, sub_sentence_counts, sentence_counts,
    )
}

_TEST_LINES = "SELECT id AS doc_id, unnest(string_split(nfc_normalize(src), chr(10))) AS line FROM nikl_pairs WHERE split = 'test' AND src IS NOT NULL"
ORACLES = {
    "line_clean": f"SELECT source, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM ({_CLEAN}) GROUP BY source",
    "line_dedup_first_wins": f"SELECT sha1(line) AS h, doc_id, pos::BIGINT AS pos FROM ({_CLEAN}) QUALIFY row_number() OVER (PARTITION BY sha1(line) ORDER BY doc_id, pos) = 1",
    "source_preference": f"""
        WITH l AS (SELECT *, CASE source WHEN 'wiki_pool_a' THEN 0 WHEN 'flores_like' THEN 1 WHEN 'helpdesk' THEN 2 END AS p FROM ({_CLEAN}) WHERE lang IS NOT NULL)
        SELECT lang, source, count(*) AS lines FROM l WHERE p = (SELECT min(p) FROM l m WHERE m.lang = l.lang) GROUP BY lang, source""",
    "sourced_langs": f"SELECT DISTINCT lower(substr(lang, 1, 2)) AS lang FROM ({_CLEAN}) WHERE lang IS NOT NULL",
    "contamination_units": f"""
        WITH du AS ({_units(_LINES, 'doc_id')}), tu AS ({_units(_TEST_LINES, 'doc_id')}),
        hits AS (SELECT doc_id, count(*) AS hits FROM du WHERE h IN (SELECT h FROM tu) GROUP BY doc_id)
        SELECT lang, source, count(*) AS documents, count(hits) AS leaking, sum(coalesce(hits, 0))::BIGINT AS units
        FROM documents LEFT JOIN hits USING (doc_id) GROUP BY lang, source""",
    "unit_counts": f"SELECT doc_id, count(*) AS units FROM ({_units(_LINES, 'doc_id')}) GROUP BY doc_id",
    "eval_anti_join": f"""
        SELECT source, count(*) AS lines FROM ({_CLEAN})
        WHERE {_LOOSE.format(x='line')} NOT IN (SELECT {_LOOSE.format(x='line')} FROM ({_TEST_LINES})) GROUP BY source""",
    "alpha_ratio_filter": rf"""
        SELECT source, count(*) AS lines FROM ({_CLEAN})
        WHERE length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) >= 0.5 * length(regexp_replace(line, '[ ]', '', 'g')) GROUP BY source""",
    "latin_runs": rf"""
        SELECT source, sum(len(regexp_extract_all(line, '[A-Za-z]{{2,}}(?:[ ''-][A-Za-z]{{2,}})*')))::BIGINT AS runs,
            sum(CASE WHEN length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) = 0 THEN 1
                WHEN length(regexp_replace(lower(line), '[^a-z]', '', 'g')) / length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) > 0.5 THEN 1 ELSE 0 END)::BIGINT AS latin_lines
        FROM ({_CLEAN}) GROUP BY source""",
    "reject_reason_ordered": f"SELECT coalesce(reason, 'accepted') AS reason, count(*) AS lines FROM ({_REJECT_SQL}) GROUP BY 1",
    "rejection_pivot": "SELECT source, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in _REASONS) + f", count(*) FILTER (reason IS NULL) AS accepted FROM ({_REJECT_SQL}) GROUP BY source",
    "clean_runs": f"""
        WITH l AS (SELECT doc_id, pos, length({_STRIP.format(x='line')}) BETWEEN 20 AND 600 AS ok FROM ({_LINES})),
        w AS (SELECT k, doc_id, min(b.ok::INT) AS whole FROM range(1, 9) r(k), l a JOIN l b USING (doc_id)
              WHERE b.pos BETWEEN a.pos - k + 1 AND a.pos AND a.pos >= k - 1 GROUP BY k, doc_id, a.pos)
        SELECT k::BIGINT AS k, sum(whole)::BIGINT AS runs, count(DISTINCT doc_id) FILTER (whole = 1) AS documents FROM w GROUP BY k""",
    "consecutive_runs": f"""
        SELECT doc_id, pos::BIGINT AS pos, sha1(array_to_string(run, ' ')) AS run
        FROM (SELECT doc_id, pos, list(line) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM ({_CLEAN})) WHERE len(run) = 3""",
    "carve_blocks": f"""
        SELECT source, count(*) AS lines, sum(({_U.format(x="'carve:' || doc_id || ':' || (pos // 8)")} < 0.03)::INT)::BIGINT AS held_out FROM ({_CLEAN}) GROUP BY source""",
    "word_ngrams": f"""
        WITH w AS (SELECT string_split({_SQZ.format(x='line')}, ' ') AS w FROM ({_CLEAN}))
        SELECT gram, count(*) AS uses FROM (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS gram FROM w WHERE len(w) >= 3) GROUP BY gram HAVING count(*) >= 5""",
    "wordlist_top": f"""
        SELECT word, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(lower(line), '[a-z]{{4,}}')) AS word FROM ({_CLEAN}))
        GROUP BY word ORDER BY uses DESC, word LIMIT 50""",
    "running_distinct": f"""
        WITH f AS (SELECT source, doc_id, pos, (row_number() OVER (PARTITION BY source, sha1(line) ORDER BY doc_id, pos) = 1)::INT AS n FROM ({_CLEAN})),
        s AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id, pos) AS so_far FROM f)
        SELECT source, count(*) AS rows_read, max(so_far)::BIGINT AS kept FROM s WHERE so_far < 40 OR (so_far = 40 AND n = 1) GROUP BY source""",
    "source_overlap_matrix": f"""
        WITH k AS (SELECT DISTINCT source, sha1(line) AS h FROM ({_CLEAN}))
        SELECT a.source, b.source AS other, count(*) AS shared FROM k a JOIN k b USING (h) WHERE a.source < b.source GROUP BY 1, 2""",
    "registry_symdiff": f"""
        WITH u AS ({_units("SELECT source AS doc_id, line FROM (" + _LINES + ") WHERE source IN ('wiki_pool_a', 'wiki_pool_b')", 'doc_id')}),
        s AS (SELECT h, max((doc_id = 'wiki_pool_a')::INT) AS a, max((doc_id = 'wiki_pool_b')::INT) AS b FROM u GROUP BY h)
        SELECT CASE WHEN a = 1 AND b = 1 THEN 'both' WHEN a = 1 THEN 'first' ELSE 'second' END AS side, count(*) AS units FROM s GROUP BY 1""",
    "set_digest": f"""
        WITH k AS (SELECT DISTINCT source, {_KEY.format(x='line')} AS h FROM ({_CLEAN}))
        SELECT source, count(*) AS n, sum(h % 1000000007)::BIGINT AS sum_a, sum(h % 998244353)::BIGINT AS sum_b, min(h) AS least, max(h) AS most FROM k GROUP BY source""",
    "registry_set_ops": f"""
        WITH a AS (SELECT DISTINCT {_KEY.format(x=_LOOSE.format(x='line'))} AS h FROM ({_CLEAN})), b AS (SELECT DISTINCT {_KEY.format(x=_LOOSE.format(x='line'))} AS h FROM ({_TEST_LINES}))
        SELECT 'union' AS op, count(*) AS keys FROM (SELECT h FROM a UNION SELECT h FROM b)
        UNION ALL SELECT 'intersect', count(*) FROM (SELECT h FROM a INTERSECT SELECT h FROM b)
        UNION ALL SELECT 'first_only', count(*) FROM (SELECT h FROM a EXCEPT SELECT h FROM b)
        UNION ALL SELECT 'second_only', count(*) FROM (SELECT h FROM b EXCEPT SELECT h FROM a)""",
    "sub_sentence_counts": f"SELECT source, count(*) AS pieces, sum(length(s))::BIGINT AS chars FROM (SELECT source, unnest({_subs('line')}) AS s FROM ({_LINES})) GROUP BY source",
    "sentence_counts": r"""
        SELECT genre, sum(1 + len(regexp_extract_all(trim(src, ' '), '[.!?…][ ]+[^ ]')))::BIGINT AS sentences, count(*) AS pairs FROM nikl_pairs WHERE src IS NOT NULL GROUP BY genre""",
}
