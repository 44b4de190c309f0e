"""Queries of the dataset checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import audit as A, lines as L, records as R
from textloom.plans.q_lines import _CLEAN, _KEY, _doc_lines, _units
from textloom.plans.q_records import _LATEST, _SEGS, _records
from textloom.session import table
from textloom.sources import corpora as C


def unknown_codes(spark, d):
    return A.unknown_codes(_records(spark, d), table(spark, d, "inventory")).groupBy("why").agg(F.count("*").alias("uses"), F.count_distinct("id").alias("records"))


def shared_train_eval_units(spark, d):
    r = _records(spark, d).where("text is not null")
    hits = A.shared_units(r.where("split = 'train'"), r.where("split = 'eval'"))
    return hits.groupBy(F.least("hits", F.lit(5)).alias("hits")).agg(F.count("*").alias("records"))


def shared_train_dev_units(spark, d):
    r = _records(spark, d).where("text is not null")
    return A.shared_units(r.where("split = 'train'"), r.where("split = 'dev'")).select("id", "hits")


def one_code_per_text(spark, d):
    return A.one_code_per_text(_records(spark, d)).groupBy("codes").agg(F.count("*").alias("texts"))


def missed_targets(spark, d):
    targets = table(spark, d, "sample_targets").groupBy("form").agg(F.sum("min_rows").alias("target"))
    return A.missed_targets(_records(spark, d).where("split = 'train'"), targets, "form")


def registry_difference(spark, d):
    """Line keys of the documents added before and after the middle of their ids."""
    lines = L.clean_lines(_doc_lines(spark, d)).select("source", "doc_id", T.key64("line").alias("h"))
    return A.registry_difference(lines.where("doc_id % 2 = 0"), lines.where("doc_id % 2 = 1"))


def dataset_verdict(spark, d):
    r, inv = _records(spark, d), table(spark, d, "inventory")
    keys = r.select("id", R.joint_key(F.col("tables"), F.col("text")).alias("key"))
    checks = {
        "redelivered": A.repeated(table(spark, d, "records"), ["id"]).select("id"),
        "tables": A.unknown_codes(r, inv).select("id", "table_id", "why"),
        "dedup": A.repeated(keys, ["key"]),
        "schema": R.schema_errors(r).where("size(errors) > 0"),
    }
    return A.verdict(A.report(checks, {"dedup", "tables"}))


def pair_checks(spark, d):
    return A.real_row_checks(table(spark, d, "nikl_pairs").select("genre", F.col("src").alias("text"), F.translate("tgt", " ", "⠀").alias("braille")), "genre")


def article_shards(spark, d):
    """Documents of each language as articles: shard B up to 200 lines, then A up to 400."""
    docs = table(spark, d, "documents").where("text is not null and lang is not null").select("lang", "doc_id", F.split("text", "\n").alias("s"))
    return C.article_shards(docs, "doc_id", "s", "lang", 200, 400).groupBy("lang", "shard").agg(F.count("*").alias("articles"), F.sum(F.size("s")).alias("lines"))


def capped_lines(spark, d):
    lines = L.clean_lines(_doc_lines(spark, d)).select("source", F.sha1("line").alias("h"))
    return C.capped(lines, "source", "h", 15).groupBy("source").agg(F.count("*").alias("kept"), F.min("h").alias("least"))


def redelivered_texts(spark, d):
    raw = table(spark, d, "records")
    return raw.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"), F.max("loaded_at").alias("last")).where("n > 1")


QUERIES = {
    f.__name__: f
    for f in (
        unknown_codes, shared_train_eval_units, shared_train_dev_units, one_code_per_text, missed_targets, registry_difference, dataset_verdict, pair_checks, article_shards,
        capped_lines, redelivered_texts,
    )
}


def _split_units(split: str) -> str:
    return _units(f"SELECT id, unnest(string_split(nfc_normalize(text), chr(10))) AS line FROM ({_LATEST}) WHERE split = '{split}' AND text IS NOT NULL", "id")


_CC = r"length(regexp_replace(braille, '[^\x{2800}-\x{28FF}]', '', 'g'))"
_UNKNOWN = f"""
    SELECT id, table_id, CASE WHEN i.table_id IS NULL THEN 'unknown' WHEN split IN ('train', 'dev') AND coalesce(holdout, false) THEN 'holdout' WHEN split IN ('train', 'dev') AND coalesce(weight, 0) <= 0 THEN 'weightless' END AS why
    FROM (SELECT id, split, unnest(tables) AS table_id FROM ({_LATEST})) u LEFT JOIN (SELECT table_id, holdout, weight FROM inventory) i USING (table_id)"""
ORACLES = {
    "unknown_codes": f"SELECT why, count(*) AS uses, count(DISTINCT id) AS records FROM ({_UNKNOWN}) WHERE why IS NOT NULL GROUP BY why",
    "shared_train_eval_units": f"""
        WITH a AS ({_split_units('train')}), b AS ({_split_units('eval')}), h AS (SELECT id, count(*) AS hits FROM a WHERE h IN (SELECT h FROM b) GROUP BY id)
        SELECT least(hits, 5) AS hits, count(*) AS records FROM h GROUP BY 1""",
    "shared_train_dev_units": f"WITH a AS ({_split_units('train')}), b AS ({_split_units('dev')}) SELECT id, count(*) AS hits FROM a WHERE h IN (SELECT h FROM b) GROUP BY id",
    "one_code_per_text": f"SELECT codes, count(*) AS texts FROM (SELECT text, count(DISTINCT table_id) AS codes FROM ({_SEGS}) GROUP BY text HAVING count(DISTINCT table_id) > 1) GROUP BY 1",
    "missed_targets": f"""
        WITH t AS (SELECT form, sum(min_rows)::BIGINT AS target FROM sample_targets GROUP BY 1), g AS (SELECT form, count(*) AS got FROM ({_LATEST}) WHERE split = 'train' GROUP BY 1)
        SELECT form, coalesce(target, 0) AS target, coalesce(got, 0) AS got FROM t FULL JOIN g USING (form) WHERE coalesce(target, 0) <> coalesce(got, 0)""",
    "registry_difference": f"""
        WITH k AS (SELECT source, {_KEY.format(x='line')} AS h, doc_id % 2 AS o FROM ({_CLEAN})), s AS (SELECT source, h, min(o) AS lo, max(o) AS hi FROM k GROUP BY 1, 2)
        SELECT CASE WHEN hi = 0 THEN 'stored' ELSE 'recomputed' END AS side, source, count(*) AS n FROM s WHERE lo = hi GROUP BY 1, 2""",
    "dataset_verdict": f"""
        WITH r AS ({_LATEST}), v AS (SELECT 'redelivered' AS name, count(*) AS n FROM (SELECT id FROM records GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'tables', count(*) FROM ({_UNKNOWN}) WHERE why IS NOT NULL
            UNION ALL SELECT 'dedup', count(*) FROM (SELECT 1 FROM r GROUP BY array_to_string(tables, chr(31)) || chr(30) || text HAVING count(*) > 1)
            UNION ALL SELECT 'schema', count(*) FROM r WHERE NOT regexp_matches(id, '{R.FORMS_ID}') OR braille IS NULL OR {_CC} <> cells OR len_bucket IS NULL OR source IS NULL OR n_sentences <= 0 OR len(segments) <> k
                OR len(segments) <> len(tables) OR len(langs) <> len(tables) OR list_sort(confusable_set) <> confusable_set OR list_has_any(confusable_set, tables) OR coalesce(length(text), 0) = 0
                OR NOT regexp_matches(braille, '^[\\x{{2800}}-\\x{{28FF}}\\n]*$') OR coalesce(len(tables), 0) = 0)
        SELECT bool_and(n = 0) FILTER (name IN ('dedup', 'tables')) AS freezable, bool_and(n = 0) AS clean, count(*) AS checks, sum(n)::BIGINT AS violations FROM v""",
    "pair_checks": r"""
        SELECT genre, count(*) AS "rows", sum(coalesce(contains(src, chr(10)), false)::INT)::BIGINT AS line_breaks, sum((src IS NULL OR trim(src) = '')::INT)::BIGINT AS empty,
            sum(coalesce(NOT regexp_matches(replace(tgt, ' ', '⠀'), '^[\x{2800}-\x{28FF}]*$'), false)::INT)::BIGINT AS not_cells, sum((tgt IS NULL)::INT)::BIGINT AS no_cells, count(DISTINCT src) AS texts
        FROM nikl_pairs GROUP BY genre""",
    "article_shards": """
        WITH d AS (SELECT lang, doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
        s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
        SELECT lang, CASE WHEN before < 200 THEN 'B' WHEN before < 600 THEN 'A' END AS shard, count(*) AS articles, sum(n)::BIGINT AS lines FROM s GROUP BY 1, 2""",
    "redelivered_texts": "SELECT id, count(*) AS n, count(DISTINCT text) AS texts, max(loaded_at) AS last FROM records GROUP BY id HAVING count(*) > 1",
    "capped_lines": f"""
        WITH l AS (SELECT DISTINCT source, sha1(line) AS h FROM ({_CLEAN})), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (('0x' || substr(sha1('cap:' || h), 1, 13))::BIGINT)::DOUBLE / pow(2, 52), h) AS r FROM l)
        SELECT source, count(*) AS kept, min(h) AS least FROM r WHERE r <= 15 GROUP BY source""",
}
