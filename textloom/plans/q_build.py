"""Queries over building, resuming and re-encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import builder as B, lines as L, records as R, sampling as S
from textloom.plans.q_lines import _CLEAN, _U, _doc_lines
from textloom.plans.q_records import _LATEST, _SEGS, _records
from textloom.sources import readers
from textloom.session import table
from textloom.streaming import events as V


def _segments(spark, d):
    return R.segments_long(_records(spark, d))


def transcription_reasons(spark, d):
    done = B.transcribe(_segments(spark, d), "table_id", "text")
    return done.groupBy("table_id", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("segments"), F.sum(F.length("braille")).alias("cells"))


def transcription_pending(spark, d):
    return B.transcribe(_segments(spark, d), "table_id", "text", provider="external").groupBy("reason").agg(F.count("*").alias("segments"))


def rejection_examples(spark, d):
    r = B.rejections(B.transcribe(_segments(spark, d), "table_id", "text"), "table_id")
    return r.select("table_id", "reason", "n", F.sha1(F.array_join("examples", "\u001f")).alias("examples"))


def usable_tables(spark, d):
    """Tables that accept at least 2 % of their segments."""
    done = B.transcribe(_segments(spark, d), "table_id", "text").groupBy("table_id").agg(F.count("*").alias("n"), F.count("braille").alias("accepted"))
    return done.select("table_id", "n", "accepted", (F.col("accepted") >= 0.02 * F.col("n")).alias("usable"))


def feasible_shares(spark, d):
    h = _segments(spark, d).where("braille is not null").select("table_id", "text", "braille")
    f = B.feasible(h)
    return f.groupBy("table_id").agg(F.count("*").alias("n"), F.sum(F.col("feasible").cast("bigint")).alias("feasible"), F.count("d_cell").alias("encoded"))


def joined_lines(spark, d):
    """All clean lines of each document, joined as its language joins sentences."""
    lines = L.clean_lines(_doc_lines(spark, d)).where("lang is not null")
    each = lines.groupBy("doc_id", "lang").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("p"))
    return each.select("doc_id", F.sha1(B.joined_sentences(F.lower(F.substring("lang", 1, 2)), F.transform("p", lambda s: s["line"]))).alias("joined"))


def snippets(spark, d):
    s = R.segments_long(_records(spark, d)).withColumn("lang", F.split_part("table_id", F.lit("-"), F.lit(1)))
    cut = B.snippet(F.col("text"), F.col("lang"), F.lit(3), T.uniform("snip", "id", "pos"))
    return s.select("id", F.col("pos").cast("bigint").alias("pos"), F.sha1(cut).alias("snippet"))


def mixed_documents(spark, d):
    """Segments of different tables in documents of three."""
    s = _segments(spark, d).select(F.concat_ws(":", "id", "pos").alias("id"), "table_id", "text")
    m = B.mixed(s, 3, "mix")
    return m.select("doc", F.array_join(F.transform("segments", lambda x: x["table_id"]), ",").alias("tables"), F.array_join(F.transform("segments", lambda x: x["id"]), ",").alias("ids"))


def line_spreading(spark, d):
    """Lines given to tables of their language by need: every need held, no line twice."""
    lines = L.clean_lines(_doc_lines(spark, d)).where("lang is not null").select(F.concat_ws(":", "doc_id", "pos").alias("line"), F.lower(F.substring("lang", 1, 2)).alias("lang"))
    inv = table(spark, d, "inventory").where("not holdout and status = 'current'").select(F.col("table_id").alias("table"), F.lower(F.substring("base_lang", 1, 2)).alias("lang")).distinct()
    accepts = lines.join(inv, "lang").select("line", "table")
    needs = inv.select("table", F.lit(20).alias("need")).distinct()
    return B.spread_lines(lines, needs, accepts, "spread").groupBy("table").agg(F.count("*").alias("lines"), F.max("line").alias("last"))


def filled_strata(spark, d):
    cand = _records(spark, d).where("split = 'train'").select("id", "form")
    accepted, short = B.filled(cand, "form", cand.select("form").distinct().withColumn("target", F.lit(60)), "fill", "id")
    return accepted.groupBy("form").agg(F.count("*").alias("got"), F.min("id").alias("first")).join(short.select("form", (F.col("target") - F.col("got")).alias("short")), "form", "left")


def resumed(spark, d):
    """What is left to do when every third record, by its number, is done."""
    r = _records(spark, d).select("id", "split")
    return readers.resume(r, r.where("cast(right(id, 7) as int) % 3 = 0"), "id").groupBy("split").agg(F.count("*").alias("left"))


def stream_first_seen(spark, d):
    """Users of a stream of events, each given out once, when first seen."""
    s = V.first_seen(V.event_stream(spark, d), "user_id", "ts", "400 days").select("user_id")
    return V.run_once(s, "f" + uuid.uuid4().hex, "append").select("user_id")


def source_mix_weights(spark, d):
    """A thousand seats for the sources that documents have, by their target shares."""
    known = table(spark, d, "documents").select("source").distinct()
    t = table(spark, d, "source_targets").join(known, "source", "left_semi")
    return S.largest_remainder(t.select("source", "target_share"), 1000, "target_share", "source").select("source", "seats")


QUERIES = {
    f.__name__: f
    for f in (
        transcription_reasons, transcription_pending, rejection_examples, usable_tables, feasible_shares, joined_lines, snippets, mixed_documents, line_spreading, filled_strata, resumed,
        stream_first_seen, source_mix_weights,
    )
}

_A64 = T.ASCII64.replace("'", "''")
_UPPER = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_TR = f"SELECT *, CASE WHEN translate({_UPPER}, '{_A64}', '') = '' THEN translate({_UPPER}, '{_A64}', '{T.CELLS64}') END AS enc FROM ({_SEGS})"
_REASON = "CASE WHEN text IS NULL THEN 'missing' WHEN enc IS NULL THEN 'undefined' END"
ORACLES = {
    "transcription_reasons": f"SELECT table_id, coalesce({_REASON}, 'ok') AS reason, count(*) AS segments, sum(length(enc))::BIGINT AS cells FROM ({_TR}) GROUP BY 1, 2",
    "transcription_pending": f"SELECT 'pending' AS reason, count(*) AS segments FROM ({_SEGS})",
    "rejection_examples": f"""
        WITH c AS (SELECT table_id, {_REASON} AS reason, text, count(*) AS k, row_number() OVER (PARTITION BY table_id, {_REASON} ORDER BY text) AS r FROM ({_TR}) WHERE {_REASON} IS NOT NULL GROUP BY 1, 2, 3)
        SELECT table_id, reason, sum(k)::BIGINT AS n, sha1(string_agg(text, chr(31) ORDER BY text) FILTER (r <= 5)) AS examples FROM c GROUP BY 1, 2""",
    "usable_tables": f"SELECT table_id, count(*) AS n, count(enc) AS accepted, count(enc) >= 0.02::DOUBLE * count(*) AS usable FROM ({_TR}) GROUP BY 1",
    "feasible_shares": f"SELECT table_id, count(*) AS n, sum(coalesce(enc = braille, false)::INT)::BIGINT AS feasible, count(enc) AS encoded FROM ({_TR}) WHERE braille IS NOT NULL GROUP BY 1",
    "snippets": f"""
        WITH s AS (SELECT id, pos, text, split_part(table_id, '-', 1) AS lang, string_split(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' '), ' ') AS w, {_U.format(x="'snip:' || id || ':' || pos")} AS u FROM ({_SEGS}))
        SELECT id, pos::BIGINT AS pos, sha1(CASE WHEN lang IN ('zh', 'ja', 'th', 'lo', 'my', 'km', 'bo', 'yue') THEN substr(text, least(floor(u * greatest(length(text) - 2, 1))::INT, greatest(length(text) - 3, 0)) + 1, 3)
            ELSE array_to_string(w[least(floor(u * greatest(len(w) - 2, 1))::INT, greatest(len(w) - 3, 0)) + 1:least(floor(u * greatest(len(w) - 2, 1))::INT, greatest(len(w) - 3, 0)) + 3], ' ') END) AS snippet FROM s""",
    "filled_strata": f"""
        WITH r AS (SELECT id, form, row_number() OVER (PARTITION BY form ORDER BY {_U.format(x="'fill:' || id")}, id) AS k FROM ({_LATEST}) WHERE split = 'train')
        SELECT form, count(*) AS got, min(id) AS first, CASE WHEN count(*) < 60 THEN 60 - count(*) END AS short FROM r WHERE k <= 60 GROUP BY form""",
    "resumed": f"SELECT split, count(*) AS left FROM ({_LATEST}) WHERE right(id, 7)::INT % 3 <> 0 GROUP BY split",
    "mixed_documents": f"""
        WITH s AS (SELECT id || ':' || pos AS id, table_id, text FROM ({_SEGS})),
        r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY ('0x' || substr(sha1('mix:' || id), 1, 13))::BIGINT, id) AS r FROM s),
        g AS (SELECT *, (row_number() OVER (PARTITION BY r ORDER BY {_U.format(x="'mix:' || table_id")}, table_id) - 1) // 3 AS g FROM r)
        SELECT concat_ws('-', 'm3', r, g) AS doc, string_agg(table_id, ',' ORDER BY table_id, text, id) AS tables, string_agg(id, ',' ORDER BY table_id, text, id) AS ids FROM g GROUP BY r, g HAVING count(*) = 3""",
    "line_spreading": f"""
        WITH l AS (SELECT doc_id || ':' || pos AS line, lower(substr(lang, 1, 2)) AS lang FROM ({_CLEAN}) WHERE lang IS NOT NULL),
        i AS (SELECT DISTINCT table_id AS "table", lower(substr(base_lang, 1, 2)) AS lang FROM inventory WHERE NOT holdout AND status = 'current'),
        p AS (SELECT line, "table" FROM l JOIN i USING (lang) QUALIFY row_number() OVER (PARTITION BY line ORDER BY -ln({_U.format(x="'spread:' || line || ':' || " + '"table"')}) / 20, "table") = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY ('0x' || substr(sha1('spread2:' || line), 1, 13))::BIGINT, line) AS nth FROM p)
        SELECT "table", count(*) AS lines, max(line) AS last FROM r WHERE nth <= 20 GROUP BY 1""",
    "stream_first_seen": "SELECT DISTINCT user_id FROM events",
    "joined_lines": f"""
        WITH l AS (SELECT doc_id, lower(substr(lang, 1, 2)) AS lang, list(line ORDER BY pos) AS p FROM ({_CLEAN}) WHERE lang IS NOT NULL GROUP BY 1, 2)
        SELECT doc_id, sha1(CASE WHEN lang IN ({', '.join(f"'{x}'" for x in B.JOINED)}) THEN array_to_string(p, '')
            ELSE list_reduce(p, lambda a, x: a || CASE WHEN regexp_matches(right(a, 1), '{B.WIDE}') AND regexp_matches(left(x, 1), '{B.WIDE}') THEN '' ELSE ' ' END || x) END) AS joined FROM l""",
    "source_mix_weights": """
        WITH e AS (SELECT source, 1000 * target_share / sum(target_share) OVER () AS x FROM source_targets WHERE source IN (SELECT source FROM documents)), f AS (SELECT *, floor(x) AS lo, round(x - floor(x), 9) AS rest FROM e)
        SELECT source, (lo + (row_number() OVER (ORDER BY rest DESC, source) <= 1000 - sum(lo) OVER ())::INT)::BIGINT AS seats FROM f""",
}
