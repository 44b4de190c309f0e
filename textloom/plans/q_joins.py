"""Queries over joins, cells, prompts and formulas."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import edits as E, text as T
from textloom.operators import joins as J, noise as N, records as R
from textloom.plans.q_lines import _LOOSE, _U
from textloom.plans.q_records import _LATEST, _SEGS, _records
from textloom.session import cut, table


def near_dup_shingles(spark, d):
    """Train records near a dev or eval record, by first reason."""
    r = cut(_records(spark, d).select("id", "split", "text"))
    return J.near_duplicate_reasons(r.where("split = 'train'"), r.where("split <> 'train'"), "id", "text").groupBy("reason").agg(F.count("*").alias("records"))


def retrieval_top3(spark, d):
    """Held-out sentences with the dev sentences that share most character 4-grams."""
    p = table(spark, d, "nikl_pairs").where("src is not null").select("id", "split", F.col("src").alias("t"))
    q = p.where("split = 'test'")
    return J.gram_retrieval(q, p.where("split = 'dev'"), "id", "t").select("query", "item", "shared", F.col("rank").cast("bigint").alias("rank"))


def alias_rate(spark, d):
    """Codes of one language whose cells agree on the texts that both have."""
    s = R.segments_long(_records(spark, d)).where("braille is not null").withColumn("lang", F.split_part("table_id", F.lit("-"), F.lit(1)))
    each = s.groupBy("lang", "table_id", "text").agg(F.min("braille").alias("b"))
    return J.agreement(each, "lang", "table_id", "text", "b")


def shared_texts(spark, d):
    """For each code: texts that it shares with other codes, how many have the same cells there, and how many other codes."""
    s = R.segments_long(_records(spark, d)).where("braille is not null").select("table_id", "text", F.sha1("braille").alias("b")).distinct()
    o = s.select(F.col("table_id").alias("other"), "text", F.col("b").alias("ob"))
    met = s.join(o, "text").where("table_id <> other")
    near = met.withColumn("same", (F.col("b") == F.col("ob")).cast("int")).groupBy("table_id").agg(F.count("*").alias("pairs"), F.sum("same").alias("identical"), F.count_distinct("other").alias("others"))
    return near


def span_containment(spark, d):
    """Characters of train texts covered by spans: positions 10 to 29 and 50 to 59, met with every tenth position."""
    r = _records(spark, d).where("split = 'train'").select("id", F.length("text").alias("n"))
    points = r.select("id", F.explode(F.expr("sequence(0, n - 1, 10)")).alias("at"))
    ranges = r.select("id", F.explode(F.array(F.struct(F.lit(10).alias("low"), F.lit(30).alias("high")), F.struct(F.lit(50).alias("low"), F.lit(60).alias("high")))).alias("s")).select("id", "s.*")
    return J.within_ranges(points, ranges, "id", "at", "low", "high").groupBy("low").agg(F.count("*").alias("points"), F.count_distinct("id").alias("records")).select(F.col("low").cast("bigint").alias("low"), "points", "records")


def cosine_top5(spark, d):
    v = table(spark, d, "embeddings")
    return J.nearest(v, "vec_id", "embedding").select("query", "item", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


def braille_ascii(spark, d):
    """Cells of the pairs to braille ASCII and back."""
    p = table(spark, d, "nikl_pairs").where("tgt is not null").withColumn("a", T.cells_ascii("tgt"))
    return p.groupBy("split").agg(F.count("*").alias("pairs"), F.sum((T.ascii_cells("a") == F.translate("tgt", " ", "⠀")).cast("bigint")).alias("same"), F.min("a").alias("least"), F.max("a").alias("most"))


def dot_flip_audit(spark, d):
    r = _records(spark, d).where("split = 'eval' and braille is not null").select("id", F.col("braille").alias("b"))
    a = N.flips_audit(N.flipped(r, "id", "b", 0.02, "noise"), "id")
    return a.agg(F.count("*").alias("records"), F.sum("cells").alias("cells"), F.sum("changed").alias("changed"), F.sum("flips").alias("flips"))


def dot_histogram(spark, d):
    """How often each dot stands in the cells of the pairs."""
    p = table(spark, d, "nikl_pairs").where("tgt is not null")
    return p.select(F.explode(N.cell_codes("tgt")).alias("c")).where("c >= 0").select(F.explode(N.dots(F.col("c"))).alias("dot")).groupBy(F.col("dot").cast("bigint").alias("dot")).agg(F.count("*").alias("uses"))


def _prompts(spark, d):
    r = _records(spark, d).where("braille is not null")
    own = F.coalesce(
        F.transform("segments", lambda s: F.struct(s["table_id"].alias("table_id"), s["text"].alias("text"))), F.array(F.struct(F.get("tables", F.lit(0)).alias("table_id"), F.col("text").alias("text")))
    )
    return r.select("id", "form", N.prompt(F.col("tables"), F.col("braille")).alias("prompt"), N.completion(own).alias("completion"), own.alias("own"))


def prompt_roundtrip(spark, d):
    """Completions parsed by both parsers, against the segments they were made of."""
    p = _prompts(spark, d).withColumn("s", N.parse_strict("completion")).withColumn("l", N.parse_loose("completion"))
    return p.groupBy("form").agg(
        F.count("*").alias("records"), F.sum((F.col("s") == F.col("own")).cast("bigint")).alias("strict_same"), F.sum((F.coalesce(F.size("l"), F.lit(0)) == F.size("own")).cast("bigint")).alias("loose_same"),
        F.sum(F.length("prompt")).alias("prompt_chars"), F.sum(2 * F.length("completion") + 32).alias("token_room"),
    )


def splice_insert(spark, d):
    r = _records(spark, d).where("split = 'train'").select("id", "text")
    return r.select("id", F.sha1(N.spliced("text", F.lit("⟪x⟫"), T.uniform("splice", "id"))).alias("spliced"))


def latex_canonical(spark, d):
    """Formula records: distinct formulas before and after canonicalisation, and whether it is idempotent."""
    r = _records(spark, d).where("form in ('S5', 'Emath') or latex_canonical is not null").select(F.coalesce("latex_canonical", "text").alias("x"))
    c = r.withColumn("c", E.latex_form("x")).withColumn("cc", E.latex_form("c"))
    return c.agg(F.count("*").alias("records"), F.count_distinct("x").alias("raw"), F.count_distinct("c").alias("canonical"), F.sum((F.col("c") == F.col("cc")).cast("bigint")).alias("idempotent"))


def source_places(spark, d):
    """Lines of 40 cells with the places of their first and last cell in the pair's cells."""
    p = table(spark, d, "nikl_pairs").where("tgt is not null").select("id", F.posexplode(E.wrapped_places("tgt", F.lit(40))).alias("line", "w"))
    return p.groupBy("line").agg(F.count("*").alias("lines"), F.sum(F.element_at("w.places", 1)).alias("first"), F.sum(F.element_at("w.places", -1)).alias("last"))


def wrapped_pages(spark, d):
    """Cells of the pairs wrapped to 40 per line and 25 lines a page."""
    p = table(spark, d, "nikl_pairs").where("tgt is not null").select("doc", F.size(E.wrapped_lines("tgt", F.lit(40))).alias("n"))
    return p.groupBy("doc").agg(F.sum("n").alias("lines"), F.ceil(F.sum("n") / 25).cast("bigint").alias("pages"))


def byte_lengths(spark, d):
    p = table(spark, d, "nikl_pairs").where("src is not null")
    return p.groupBy("genre").agg(F.sum(F.octet_length("src") + 1).alias("ids"), F.max(F.octet_length("src") + 1).cast("bigint").alias("most"))


def byte_codec(spark, d):
    p = table(spark, d, "nikl_pairs").where("src is not null")
    return p.groupBy("genre").agg(F.sum(F.size(E.byte_codec("src"))).alias("ids"))


def normal_forms(spark, d):
    """Documents that change under NFC, and distinct bare forms."""
    t = table(spark, d, "documents").where("text is not null")
    return t.agg(F.count("*").alias("documents"), F.sum((E.nfc("text") != F.col("text")).cast("bigint")).alias("changed"), F.count_distinct(E.bare_form("text")).alias("bare_forms"))


def identical_twins(spark, d):
    """Records of one text under several codes: all kept only if every code of the pair is there."""
    s = R.segments_long(_records(spark, d)).select("text", "table_id").distinct()
    n = s.groupBy("text").agg(F.count("*").alias("codes"))
    return n.groupBy("codes").agg(F.count("*").alias("texts"))


def audit_report(spark, d):
    """One row per check: name and violations."""
    r = _records(spark, d)
    inv = table(spark, d, "inventory").select(F.col("table_id").alias("t")).distinct()
    used = r.select("id", F.explode("tables").alias("t"))
    unknown = used.join(inv, "t", "left_anti")
    raw = table(spark, d, "records")
    key = r.select("id", "split", R.joint_key(F.col("tables"), F.col("text")).alias("key"))
    seg = R.segments_long(r)
    n = r.join(table(spark, d, "nikl_pairs").select(F.col("id").alias("nikl_id")), "nikl_id", "left_anti").where("nikl_id is not null")
    checks = {
        "schema": R.schema_errors(r).where("size(errors) > 0"),
        "redelivered": raw.groupBy("id").count().where("count > 1"),
        "unknown_table": unknown.select("id").distinct(),
        "duplicate_key": key.groupBy("key").count().where("count > 1"),
        "train_eval_key": key.where("split = 'train'").join(key.where("split <> 'train'").select("key").distinct(), "key", "left_semi"),
        "cell_count": r.where(F.col("braille").isNotNull() & (T.cell_count("braille") != F.col("cells"))),
        "segment_join": R.assembled(seg).select("id", F.col("text").alias("again")).join(r.select("id", "text"), "id").where("text <> again"),
        "nikl_reference": n,
        "late_load": r.where("loaded_at < built_at"),
    }
    out = None
    for name, rows in checks.items():
        part = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        out = part if out is None else out.unionAll(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        near_dup_shingles, retrieval_top3, alias_rate, shared_texts, span_containment, cosine_top5, braille_ascii, dot_flip_audit, dot_histogram, prompt_roundtrip, splice_insert,
        latex_canonical, source_places, wrapped_pages, byte_lengths, byte_codec, normal_forms, identical_twins, audit_report,
    )
}

_SH = f"SELECT DISTINCT id, CASE WHEN length(t) < 20 THEN t ELSE unnest(list_transform(range(1, greatest(length(t) - 18, 2)), lambda i: substr(t, i, 20))) END AS h FROM (SELECT id, split, {_LOOSE.format(x='text')} AS t FROM ({_LATEST})) WHERE t <> ''"
_JOINT = "sha1(array_to_string(tables, chr(31)) || chr(30) || text)"
_CC = r"length(regexp_replace(braille, '[^\x{2800}-\x{28FF}]', '', 'g'))"
ORACLES = {
    "near_dup_shingles": f"""
        WITH r AS (SELECT id, split, {_LOOSE.format(x='text')} AS t FROM ({_LATEST})), s AS ({_SH}), a AS (SELECT s.* FROM s JOIN r USING (id) WHERE split = 'train'), b AS (SELECT s.* FROM s JOIN r USING (id) WHERE split <> 'train'),
        na AS (SELECT id, count(*) AS n FROM a GROUP BY id), nb AS (SELECT id, count(*) AS n FROM b GROUP BY id),
        x AS (SELECT id, 1 AS o FROM r WHERE split = 'train' AND t IN (SELECT t FROM r WHERE split <> 'train')
            UNION ALL SELECT a.id, 2 FROM a JOIN na USING (id) WHERE h IN (SELECT h FROM b) GROUP BY a.id, na.n HAVING count(*) >= 0.8::DOUBLE * na.n
            UNION ALL SELECT a.id, 3 FROM a JOIN b USING (h) JOIN nb ON nb.id = b.id GROUP BY a.id, b.id, nb.n HAVING count(*) >= 0.8::DOUBLE * nb.n)
        SELECT CASE o WHEN 1 THEN 'loose_exact' WHEN 2 THEN 'covered' ELSE 'contains' END AS reason, count(*) AS records FROM (SELECT id, min(o) AS o FROM x GROUP BY id) GROUP BY 1""",
    "retrieval_top3": """
        WITH p AS (SELECT id, split, src AS t FROM nikl_pairs WHERE src IS NOT NULL),
        g AS (SELECT DISTINCT id, split, unnest(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) AS g FROM p WHERE length(t) >= 4)
        SELECT a.id AS query, b.id AS item, count(*) AS shared, row_number() OVER (PARTITION BY a.id ORDER BY count(*) DESC, b.id) AS rank FROM g a JOIN g b USING (g) WHERE a.split = 'test' AND b.split = 'dev' GROUP BY 1, 2 QUALIFY rank <= 3""",
    "alias_rate": f"""
        WITH e AS (SELECT split_part(table_id, '-', 1) AS lang, table_id, text, min(braille) AS b FROM ({_SEGS}) WHERE braille IS NOT NULL GROUP BY 1, 2, 3)
        SELECT a.lang, a.table_id AS a, c.table_id AS b, count(*) AS both, sum((a.b = c.b)::INT)::BIGINT AS same, round(sum((a.b = c.b)::INT) / count(*), 9) AS rate FROM e a JOIN e c ON a.lang = c.lang AND a.text = c.text AND a.table_id < c.table_id GROUP BY 1, 2, 3""",
    "shared_texts": f"""
        WITH s AS (SELECT DISTINCT table_id, text, braille AS b FROM ({_SEGS}) WHERE braille IS NOT NULL)
        SELECT a.table_id, count(*) AS pairs, sum((a.b = c.b)::INT)::BIGINT AS identical, count(DISTINCT c.table_id) AS others FROM s a JOIN s c ON a.text = c.text AND a.table_id <> c.table_id GROUP BY 1""",
    "span_containment": f"""
        WITH p AS (SELECT id, unnest(range(0, length(text), 10)) AS pos FROM ({_LATEST}) WHERE split = 'train')
        SELECT low::BIGINT AS low, count(*) AS points, count(DISTINCT id) AS records FROM p JOIN (VALUES (10, 30), (50, 60)) v(low, high) ON pos >= low AND pos < high GROUP BY 1""",
    "cosine_top5": """
        SELECT a.vec_id AS query, b.vec_id AS item, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine,
            row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rank <= 5""",
    "braille_ascii": f"""
        WITH p AS (SELECT split, tgt, translate(tgt, '{T.CELLS64}', '{T.ASCII64.replace(chr(39), chr(39) * 2)}') AS a FROM nikl_pairs WHERE tgt IS NOT NULL)
        SELECT split, count(*) AS pairs, sum((translate(upper(a), '{T.ASCII64.replace(chr(39), chr(39) * 2)}', '{T.CELLS64}') = replace(tgt, ' ', '⠀'))::INT)::BIGINT AS same, min(a) AS least, max(a) AS most FROM p GROUP BY split""",
    "dot_histogram": """
        SELECT d::BIGINT AS dot, count(*) AS uses FROM (SELECT unicode(unnest(string_split(tgt, ''))) - 10240 AS c FROM nikl_pairs WHERE tgt IS NOT NULL), range(1, 9) r(d) WHERE c BETWEEN 0 AND 255 AND (c >> (d - 1)) & 1 = 1 GROUP BY 1""",
    "prompt_roundtrip": f"""
        WITH r AS (SELECT form, tables, braille, CASE WHEN segments IS NULL THEN [{{'t': tables[1], 'x': text}}] ELSE list_transform(segments, lambda s: {{'t': s.table_id, 'x': s.text}}) END AS own FROM ({_LATEST}) WHERE braille IS NOT NULL),
        p AS (SELECT *, '<|tables|>' || array_to_string(tables, ',') || '<|braille|>' || braille AS prompt, '<|text|>' || array_to_string(list_transform(own, lambda s: '⟨' || s.t || '⟩' || s.x), chr(10)) AS completion FROM r)
        SELECT form, count(*) AS records, sum((len(list_filter(own, lambda s: contains(s.x, chr(10)))) = 0)::INT)::BIGINT AS strict_same, sum((len(list_filter(own, lambda s: contains(s.x, chr(10) || '⟨'))) = 0)::INT)::BIGINT AS loose_same,
            sum(length(prompt))::BIGINT AS prompt_chars, sum(2 * length(completion) + 32)::BIGINT AS token_room FROM p GROUP BY form""",
    "normal_forms": f"""
        SELECT count(*) AS documents, sum((nfc_normalize(text) <> text)::INT)::BIGINT AS changed, count(DISTINCT regexp_replace({_LOOSE.format(x='text')}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]', '', 'g')) AS bare_forms FROM documents WHERE text IS NOT NULL""",
    "dot_flip_audit": f"""
        WITH c AS (SELECT id, generate_subscripts(string_split(braille, ''), 1) - 1 AS pos, unicode(unnest(string_split(braille, ''))) - 10240 AS v FROM ({_LATEST}) WHERE split = 'eval' AND braille IS NOT NULL),
        m AS (SELECT id, pos, sum(({_U.format(x="'noise:' || id || ':' || pos || ':' || d")} < 0.02::DOUBLE)::INT) AS n FROM c, range(6) r(d) WHERE v BETWEEN 0 AND 255 GROUP BY 1, 2)
        SELECT count(DISTINCT id) AS records, count(*) AS cells, sum((n > 0)::INT)::BIGINT AS changed, sum(n)::BIGINT AS flips FROM m""",
    "splice_insert": f"""
        WITH r AS (SELECT id, text, string_split(text, ' ') AS w, {_U.format(x="'splice:' || id")} AS u FROM ({_LATEST}) WHERE split = 'train'), k AS (SELECT *, least(floor(u * (len(w) - 1))::INT + 1, len(w) - 1) AS cutpos FROM r)
        SELECT id, sha1(CASE WHEN len(w) < 2 THEN text ELSE array_to_string(list_concat(list_concat(w[1:cutpos], ['⟪x⟫']), w[cutpos + 1:len(w)]), ' ') END) AS spliced FROM k""",
    "byte_lengths": "SELECT genre, sum(strlen(src) + 1)::BIGINT AS ids, max(strlen(src) + 1)::BIGINT AS most FROM nikl_pairs WHERE src IS NOT NULL GROUP BY genre",
    "byte_codec": "SELECT genre, sum(strlen(src) + 1)::BIGINT AS ids FROM nikl_pairs WHERE src IS NOT NULL GROUP BY genre",
    "identical_twins": f"SELECT codes, count(*) AS texts FROM (SELECT text, count(DISTINCT table_id) AS codes FROM ({_SEGS}) GROUP BY text) GROUP BY codes",
    "audit_report": f"""
        WITH r AS ({_LATEST}), u AS (SELECT id, unnest(tables) AS t FROM r), k AS (SELECT id, split, {_JOINT} AS key FROM r)
        SELECT 'schema' AS check_name, (SELECT count(*) FROM r WHERE NOT regexp_matches(id, '{R.FORMS_ID}') OR braille IS NULL OR {_CC} <> cells OR len_bucket IS NULL OR source IS NULL OR n_sentences <= 0 OR len(segments) <> k
            OR len(segments) <> len(tables) OR len(langs) <> len(tables) OR list_sort(confusable_set) <> confusable_set OR list_has_any(confusable_set, tables) OR coalesce(length(text), 0) = 0
            OR NOT regexp_matches(braille, '^[\\x{{2800}}-\\x{{28FF}}\\n]*$') OR coalesce(len(tables), 0) = 0) AS violations
        UNION ALL SELECT 'redelivered', count(*) FROM (SELECT id FROM records GROUP BY id HAVING count(*) > 1)
        UNION ALL SELECT 'unknown_table', count(DISTINCT id) FROM u WHERE t NOT IN (SELECT table_id FROM inventory)
        UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT key FROM k GROUP BY key HAVING count(*) > 1)
        UNION ALL SELECT 'train_eval_key', count(*) FROM k WHERE split = 'train' AND key IN (SELECT key FROM k WHERE split <> 'train')
        UNION ALL SELECT 'cell_count', count(*) FROM r WHERE braille IS NOT NULL AND {_CC} <> cells
        UNION ALL SELECT 'segment_join', count(*) FROM r JOIN (SELECT id, string_agg(text, chr(10) ORDER BY pos) AS again FROM ({_SEGS}) GROUP BY id) USING (id) WHERE text <> again
        UNION ALL SELECT 'nikl_reference', count(*) FROM r WHERE nikl_id IS NOT NULL AND nikl_id NOT IN (SELECT id FROM nikl_pairs)
        UNION ALL SELECT 'late_load', count(*) FROM r WHERE loaded_at < built_at""",
}
