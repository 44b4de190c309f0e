"""Queries over table metadata, strict record rules, prose, formulas, providers and options."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import edits as E, prose as P, text as T
from textloom.operators import audit as A, datasets as D, lines as L, providers as V, records as R, scoring as S
from textloom.plans.q_lines import _LINES, _STRIP, _U, _doc_lines
from textloom.plans.q_records import _LATEST, _SEGS, _records
from textloom.session import table
from textloom.sources import inventory as I


def base_languages(spark, d):
    """Language tags under their primary code, names of one language brought together."""
    return table(spark, d, "inventory").groupBy(P.base_language("lang_tag").alias("lang")).agg(F.count("*").alias("tables"))


def best_tables(spark, d):
    """Per language the table to use: current ones first, then grade, contraction, name."""
    return I.best_tables(table(spark, d, "inventory"))


def strict_schema_errors(spark, d):
    return R.strict_errors(_records(spark, d)).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("records"))


def label_filters(spark, d):
    """Records by what the prefixes of their engine and of their first code say."""
    r = _records(spark, d)
    return r.groupBy(F.startswith("engine", F.lit("eng-3b")).alias("newer_engine"), F.startswith(F.get("tables", F.lit(0)), F.lit("zh")).alias("chinese")).agg(F.count("*").alias("records"))


def length_caps(spark, d):
    """Records per form whose cells and text, in bytes, fit in a cap, and those dropped; none is cut."""
    r = _records(spark, d).withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("braille"), F.lit(0)))
    return r.groupBy("form").agg(F.sum((F.col("n") <= 1024).cast("bigint")).alias("kept"), F.sum((F.col("n") > 1024).cast("bigint")).alias("dropped"), F.max(F.when(F.col("n") <= 1024, F.col("n"))).cast("bigint").alias("longest"))


def padded_ids(spark, d):
    """Byte ids of sentences padded to their genre's longest: ids, and pads among them."""
    p = table(spark, d, "nikl_pairs").where("src is not null").select("genre", E.byte_codec("src").alias("ids"))
    most = p.groupBy("genre").agg(F.max(F.size("ids")).alias("most"))
    padded = p.join(most, "genre").withColumn("row", F.concat("ids", F.array_repeat(F.lit(0), F.col("most") - F.size("ids"))))
    return padded.groupBy("genre").agg(F.sum(F.size("row")).alias("ids"), F.sum(F.size(F.filter("row", lambda x: x == 0))).alias("pads"))


def term_frequencies(spark, d):
    """The fifty most frequent word pairs and capitalised words of the lines."""
    lines = L.clean_lines(_doc_lines(spark, d))
    pairs = L.word_ngrams(lines.withColumn("line", F.lower("line")), 2).select(F.lit("pair").alias("kind"), F.col("gram").alias("term"), "uses")
    caps = lines.select(F.explode(F.regexp_extract_all("line", F.lit("[A-Z][a-z]{2,}"), F.lit(0))).alias("term")).groupBy("term").agg(F.count("*").alias("uses")).select(F.lit("capital").alias("kind"), "term", "uses")
    return pairs.orderBy(F.desc("uses"), "term").limit(50).unionAll(caps.orderBy(F.desc("uses"), "term").limit(50))


def clean_paragraphs(spark, d):
    """Paragraphs without page addresses and stray white space, of 20 characters or more."""
    p = _doc_lines(spark, d).select("source", P.without_urls("line").alias("p"))
    return p.where(F.length("p") >= 20).groupBy("source").agg(F.count("*").alias("paragraphs"), F.sum(F.length("p")).alias("chars"), F.min(F.sha1("p")).alias("least"))


def one_line_changes(spark, d):
    """How many texts change when line breaks become blanks, and under NFC."""
    t = table(spark, d, "documents").where("text is not null").withColumn("one", P.one_line("text"))
    return t.groupBy("source").agg(F.count("*").alias("documents"), F.sum((F.col("one") != F.col("text")).cast("bigint")).alias("breaks"), F.sum((T.nfc("text") != F.col("text")).cast("bigint")).alias("forms"))


def math_spans(spark, d):
    """Prose and formula pieces of the cells, where a formula stands between its marks."""
    r = _records(spark, d).where("braille is not null")
    marked = r.withColumn("braille", F.when(F.col("doc_type") == "math", F.concat(F.lit(P.MATH_OPEN), "braille", F.lit(P.MATH_CLOSE), "braille")).otherwise(F.col("braille")))
    s = marked.select("form", F.explode(P.math_spans("braille")).alias("s"))
    return s.groupBy("form", "s.kind").agg(F.count("*").alias("pieces"), F.sum(F.length("s.cells")).alias("cells"))


def formula_texts(spark, d):
    """Formulas between double dollars, and cells of formula engines brought to one form."""
    r = _records(spark, d).select("form", F.concat(F.lit("a $$"), "latex_canonical", F.lit("$$ b")).alias("x"), P.formula_cells(F.concat(F.lit(" "), "braille", F.lit("\t"))).alias("c"), "latex_canonical", "braille")
    return r.groupBy("form").agg(F.sum((P.formula_of("x") == F.col("latex_canonical")).cast("bigint")).alias("same"), F.count("c").alias("cell_rows"), F.min("c").alias("least"))


def folded_texts(spark, d):
    """Distinct lines before and after typographic distinctions are folded."""
    x = L.clean_lines(_doc_lines(spark, d)).select("source", "line", P.unwritten_folded("line").alias("f"))
    return x.groupBy("source").agg(F.count_distinct("line").alias("lines"), F.count_distinct("f").alias("folded"), F.min(F.sha1("f")).alias("least"))


def prose_sentences(spark, d):
    """Sentences of the English lines read as a LaTeX body."""
    x = L.clean_lines(_doc_lines(spark, d)).where("lower(substring(lang, 1, 2)) = 'en'").withColumn("p", P.prose_of("line"))
    s = x.select("source", F.explode(P.sentences_of("p")).alias("s"))
    return s.groupBy("source").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("chars"))


def packed_paragraphs(spark, d):
    """Lines packed at blanks into chunks of at most 120 characters, with what was dropped."""
    x = _doc_lines(spark, d).select("source", P.packed_chunks(P.without_urls("line"), F.lit(120)).alias("p"))
    return x.groupBy("source").agg(F.sum(F.size("p.chunks")).alias("chunks"), F.sum("p.short").alias("short"), F.sum("p.long").alias("long"), F.sum("p.symbols").alias("symbols"))


def unit_cuts(spark, d):
    """Documents cut at sentence ends into units of 40 to 200 characters."""
    x = table(spark, d, "documents").where("text is not null").select("source", F.explode(P.unit_spans("text", F.lit(200))).alias("u"))
    return x.groupBy("source").agg(F.count("*").alias("units"), F.sum(F.col("u.end_pos") - F.col("u.start_pos")).alias("chars"), F.max(F.col("u.end_pos") - F.col("u.start_pos")).alias("longest"))


def wrong_offsets(spark, d):
    """Places of the records' texts that their first candidates got wrong."""
    refs = _records(spark, d).select("id", "form", F.col("text").alias("ref"))
    c = S.candidates_long(table(spark, d, "cand_pools").groupBy("id").agg(F.min_by("cands", F.to_json("cands")).alias("cands"))).where("idx = 0").join(refs, "id")
    return c.groupBy("form").agg(F.sum(F.size(P.wrong_places("ref", "text"))).alias("places"), F.count("*").alias("pairs"))


def last_lines(spark, d):
    """Candidates cut to their last line."""
    c = S.candidates_long(table(spark, d, "cand_pools")).where("text is not null").withColumn("l", P.last_line("text"))
    return c.groupBy("finish").agg(F.count("*").alias("candidates"), F.sum((F.col("l") != F.col("text")).cast("bigint")).alias("cut"), F.sum(F.length("l")).alias("chars"))


def model_verdicts(spark, d):
    """Per record and code what each model made of it: exact, close (up to a tenth wrong), wrong, or not scored."""
    s = R.latest(table(spark, d, "score_rows"), ["rec_id", "table_id", "model", "cond", "decoding"], "loaded_at").where("decoding = 'greedy'")
    v = s.groupBy("rec_id", "table_id", "model").agg(F.min("edit").alias("e"), F.min("cer").alias("c"))
    v = v.withColumn("verdict", F.when(F.col("e") == 0, "exact").when(F.col("c") <= 0.1, "close").when(F.col("c").isNotNull(), "wrong").otherwise("unscored"))
    return v.groupBy("model", "verdict").agg(F.count("*").alias("records"))


def judge_inputs(spark, d):
    """What a judge of first candidates is asked: empty ones get the least rating without a call, others at most 6,000 characters of both texts."""
    refs = _records(spark, d).select("id", F.col("text").alias("ref"))
    c = S.candidates_long(table(spark, d, "cand_pools").groupBy("id").agg(F.min_by("cands", F.to_json("cands")).alias("cands"))).where("idx = 0").join(refs, "id")
    asked = F.trim(F.coalesce("text", F.lit(""))) != ""
    size = F.least(F.length("ref"), F.lit(6000)) + F.least(F.length("text"), F.lit(6000))
    return c.groupBy(F.when(asked, F.lit(None).cast("int")).otherwise(1).cast("bigint").alias("rating")).agg(F.count("*").alias("pairs"), F.sum(F.when(asked, size)).alias("chars"))


def normal_form_steps(spark, d):
    """Micro error rate of the first candidates under growing normal forms: as they are, NFC, without zero-width spaces, loose."""
    refs = _records(spark, d).select("id", F.col("text").alias("ref"))
    c = S.candidates_long(table(spark, d, "cand_pools").groupBy("id").agg(F.min_by("cands", F.to_json("cands")).alias("cands"))).where("idx = 0 and text is not null").join(refs, "id")
    plain = lambda x: F.replace(T.nfc(x), F.lit(E.ZERO_WIDTH), F.lit(""))
    steps = {"raw": F.col, "nfc": T.nfc, "no_zero_width": plain, "loose": T.loose}
    wide = c.select(*[f(side).alias(f"{side}_{name}") for name, f in steps.items() for side in ("ref", "text")])
    rates = wide.agg(*[F.round(F.sum(F.levenshtein(f"ref_{n}", f"text_{n}")) / F.sum(F.length(f"ref_{n}")), 9).alias(n) for n in steps])
    return S.long_metrics(rates.withColumn("all", F.lit("all")), ["all"], list(steps)).select(F.col("metric").alias("step"), F.col("value").alias("rate"))


def option_spans(spark, d):
    """Spans of the first Latin run of each document, some shifted, some doubled: why they are no valid option."""
    p = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("src"), F.regexp_extract("text", "[A-Za-z]+", 0).alias("run")).where("run <> ''")
    a = F.instr("src", F.col("run")) - 1
    b = a + F.length("run")
    how = F.pmod(F.col("doc_id"), F.lit(4))
    pair = lambda x, y: F.array(x.cast("int"), y.cast("int"))
    spans = F.when(how == 0, F.array(pair(a, b))).when(how == 1, F.array(pair(a, b), pair(a, b))).when(how == 2, F.array(pair(a, F.length("src") + 1))).otherwise(F.array(pair(a, b - 1)))
    return p.select(P.option_error("src", spans).alias("why")).groupBy(F.coalesce("why", F.lit("valid")).alias("why")).agg(F.count("*").alias("documents"))


_ROUTED = ("en", "de", "fr", "es")


def _routed(spark, d):
    routes = table(spark, d, "inventory").where(F.col("base_lang").isin(*_ROUTED)).select("table_id", F.lit("basic").alias("engine"))
    return V.transcribe_routed(R.segments_long(_records(spark, d)).select("id", "pos", "table_id", "text"), routes)


def routed_transcription(spark, d):
    """Segments by what their table's engine says; tables without an engine stay pending."""
    return _routed(spark, d).groupBy("table_id", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("segments"), F.sum(F.length("braille")).alias("cells"), F.sum(F.element_at("places", -1)).alias("last"))


def back_translation(spark, d):
    """Transcribed segments read back from their cells: how many give their text in lower case again."""
    done = V.back_translated(_routed(spark, d).where("braille is not null"), "basic")
    return done.groupBy("table_id").agg(F.count("*").alias("segments"), F.sum(F.coalesce(F.col("back") == F.lower("text"), F.lit(False)).cast("bigint")).alias("same"))


def homophone_edits(spark, d):
    """Replaced characters of the first candidates: those that the code writes with the same cells, and the others."""
    refs = _records(spark, d).select("id", F.get("tables", F.lit(0)).alias("table_id"), F.col("text").alias("ref"))
    c = S.candidates_long(table(spark, d, "cand_pools").groupBy("id").agg(F.min_by("cands", F.to_json("cands")).alias("cands"))).where("idx = 0 and text is not null").join(refs, "id")
    e = c.select("table_id", "ref", "text", F.explode(E.edits("ref", "text")).alias("e")).where("e.op = 'replace'")
    pairs = e.select("table_id", F.expr("substring(ref, e.ref_pos + 1, 1)").alias("a"), F.expr("substring(text, e.hyp_pos + 1, 1)").alias("b"))
    return V.homophones(pairs, "basic").groupBy("homophone").agg(F.count("*").alias("edits"))


def consistency_rates(spark, d):
    """Segments whose cells are those that the built-in provider gives, per split."""
    from textloom.operators import builder as B

    s = R.segments_long(_records(spark, d)).where("braille is not null").join(_records(spark, d).select("id", "split"), "id")
    f = B.feasible(s.select("split", "table_id", "text", "braille"))
    return f.groupBy("split").agg(F.count("*").alias("segments"), F.sum(F.col("feasible").cast("bigint")).alias("consistent"), F.round(F.avg(F.col("feasible").cast("double")), 9).alias("rate"))


def inventory_identity(spark, d):
    """Entries of the inventory that differ between two readings: each row's digest, against one in which holdout tables are gone and superseded ones have another state."""
    inv = table(spark, d, "inventory")
    digest = lambda status: F.sha2(F.concat_ws("|", "table_id", "base_lang", F.coalesce("grade", F.lit("-")), status), 256)
    now = inv.select(F.col("table_id").alias("label"), digest(F.col("status")).alias("sha256"))
    then = inv.where("not holdout").select(F.col("table_id").alias("label"), digest(F.when(F.col("status") == "superseded", "current").otherwise(F.col("status"))).alias("sha256"))
    return I.changed_entries(now, then).groupBy("why").agg(F.count("*").alias("tables"))


def records_at(spark, d):
    """Every hundredth record in the order of the ids, by its place."""
    r = _records(spark, d).select("id", "split")
    places = spark.range(0, 100_000_000, 100).select(F.col("id").alias("at"))
    return I.rows_at(r, ["id"], places).select("at", "id", "split")


def wrong_joiners(spark, d):
    """Blanks between ideographs in made-up texts of the first two lines of each Chinese and Japanese document: joints that should have had none."""
    lines = L.clean_lines(_doc_lines(spark, d), 8).where("lower(substring(lang, 1, 2)) in ('zh', 'ja')").select("doc_id", "pos", "line").where("line rlike '^[\\\\x{4E00}-\\\\x{9FFF}].*[\\\\x{4E00}-\\\\x{9FFF}]$'")
    pairs = L.consecutive(lines, 2).select(F.col("doc_id").alias("id"), F.col("run").alias("text"), "pos")
    bad = A.wrong_joiners(pairs.select(F.concat_ws(":", "id", "pos").alias("id"), "text"), lines.select("line"))
    return bad.agg(F.count_distinct("id").alias("texts"))


QUERIES = {
    f.__name__: f
    for f in (
        base_languages, best_tables, strict_schema_errors, label_filters, length_caps, padded_ids, term_frequencies, clean_paragraphs, one_line_changes, math_spans, formula_texts, folded_texts,
        prose_sentences, packed_paragraphs, unit_cuts, wrong_offsets, last_lines, model_verdicts, judge_inputs, normal_form_steps, option_spans, routed_transcription, back_translation, homophone_edits, consistency_rates,
        inventory_identity, records_at, wrong_joiners,
    )
}

_CLEAN20 = f"SELECT * REPLACE ({_STRIP.format(x='line')} AS line) FROM ({_LINES}) WHERE length({_STRIP.format(x='line')}) BETWEEN 20 AND 600"
_NB = "length({x}) - length(replace({x}, chr(10), ''))"
_CELLC = r"length(regexp_replace({x}, '[^\x{{2800}}-\x{{28FF}}]', '', 'g'))"
_LATEST_SCORES = "SELECT DISTINCT * FROM score_rows QUALIFY row_number() OVER (PARTITION BY rec_id, table_id, model, cond, decoding ORDER BY loaded_at DESC) = 1"
_BUCKET = "CASE WHEN cells <= 4 THEN 'snippet_1_4' WHEN cells <= 10 THEN 'snippet_5_10' WHEN cells <= 20 THEN 'snippet_11_20' WHEN cells <= 40 THEN 'snippet_21_40' WHEN cells <= 80 THEN 'snippet_41_80' WHEN n_sentences >= 4 THEN 'paragraph' ELSE 'sentence' END"
_JOINED = "replace(array_to_string(list_transform(segments, lambda s: coalesce(s.{p}, '')), chr(29)), chr(29), coalesce(seg_join, chr(10)))"
_LINED = "segments IS NOT NULL AND coalesce(seg_join, chr(10)) = chr(10)"
_OWN = "coalesce(confusable_set, [])"
_STRICT = {
    "id_pattern": f"NOT coalesce(regexp_matches(id, '{R.FORM_ID}'), false)",
    "id_form": f"regexp_matches(id, '{R.FORM_ID}') AND NOT coalesce(regexp_extract(id, '{R.FORM_ID}', 1) = form, false)",
    "split": "NOT coalesce(split IN ('train', 'dev', 'eval'), false)",
    "doc_type": "NOT coalesce(doc_type IN ('single', 'intra_switch', 'inter', 'math'), false)",
    "regime": "NOT coalesce(regime IN ('single', 'anchor', 'uniform', 'confusable', 'math'), false)",
    "switch_density": "NOT coalesce(switch_density IN ('none', 'light', 'heavy'), false)",
    "tables": "coalesce(len(tables), 0) <= 0",
    "langs_length": "coalesce(len(langs), -1) <> coalesce(len(tables), -1)",
    "status_length": "coalesce(len(table_status), -1) <> coalesce(len(tables), -1)",
    "k": "NOT coalesce(k = len(tables), false)",
    "segments_missing": "segments IS NULL AND k <> 1 AND doc_type <> 'math'",
    "segments_few": "segments IS NOT NULL AND len(segments) < 2",
    "segments_text": f"segments IS NOT NULL AND {_JOINED.format(p='text')} <> text",
    "segments_cells": f"segments IS NOT NULL AND {_JOINED.format(p='braille')} <> coalesce(braille, '')",
    "segments_tables": f"{_LINED} AND list_transform(segments, lambda s: s.table_id) <> tables",
    "cells_stale": f"coalesce({_CELLC.format(x='braille')}, 0) <> coalesce(cells, -1)",
    "len_bucket_stale": f"NOT coalesce({_BUCKET} = len_bucket, false)",
    "confusable_self": f"CASE WHEN segments IS NOT NULL THEN len(list_filter(segments, lambda s: coalesce(list_contains(s.confusable_set, s.table_id), false))) > 0 ELSE list_contains({_OWN}, tables[1]) END",
    "text_empty": "coalesce(length(text), 0) = 0",
    "cells_empty": "coalesce(length(braille), 0) = 0",
    "sentences": "coalesce(n_sentences, 0) < 1",
    "tag_empty": "coalesce(length(tag), 0) = 0",
    "source_type": "source IS NULL",
    "ambiguous_type": "fiber_ambiguous IS NULL",
    "items_null": "len(list_filter(list_concat(list_concat(coalesce(tables, []), coalesce(langs, [])), list_concat(coalesce(confusable_set, []), coalesce(table_status, []))), lambda x: x IS NULL)) > 0",
    "confusable_order": f"{_OWN} <> list_sort(list_distinct({_OWN}))",
    "confusable_union": f"segments IS NOT NULL AND list_sort(list_distinct(flatten(list_transform(segments, lambda s: coalesce(s.confusable_set, []))))) <> {_OWN}",
    "seg_join_alone": "segments IS NULL AND seg_join IS NOT NULL AND seg_join <> chr(10)",
    "break_count": f"{_LINED} AND ({_NB.format(x='text')} <> len(segments) - 1 OR coalesce({_NB.format(x='braille')}, -1) <> len(segments) - 1)",
    "break_inline": "segments IS NOT NULL AND coalesce(seg_join, chr(10)) <> chr(10) AND (contains(text, chr(10)) OR contains(braille, chr(10)))",
    "break_single": "segments IS NULL AND (contains(text, chr(10)) OR coalesce(contains(braille, chr(10)), false))",
}
_BASE_LANG = "CASE split_part(split_part(lower(trim(lang_tag)), '-', 1), '_', 1) WHEN 'zh' THEN 'cmn' WHEN 'zho' THEN 'cmn' WHEN 'no' THEN 'nb' WHEN 'iw' THEN 'he' WHEN 'in' THEN 'id' ELSE split_part(split_part(lower(trim(lang_tag)), '-', 1), '_', 1) END"
_NOURL = r"trim(regexp_replace(regexp_replace(line, 'https?://[^ \t\r\n]+|www\.[^ \t\r\n]+', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ')"
_FOLDED = "line"
for _a, _b in P.UNWRITTEN.items():
    _FOLDED = f"replace({_FOLDED}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
_FOLDED = rf"trim(regexp_replace({_FOLDED}, '[ \t\r\n]+', ' ', 'g'), ' ')"
_RULES = V.Rules.read(V.BASIC_RULES.splitlines())
_TOKENS = "|".join([*sorted(_RULES.groups, key=len, reverse=True), "."])
_ONE = f"translate(t, '{''.join(_RULES.chars).replace(chr(39), chr(39) * 2)}', '{''.join(_RULES.chars.values())}')"
_GROUP = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _RULES.groups.items())
# Each token's cells: groups, digits after a number sign unless a digit stands before, letters a to j after a letter sign if one does.
_CELLS_OF = f"""
    list_transform(range(1, len(tok) + 1), lambda i: CASE WHEN length(tok[i]) > 1 THEN CASE tok[i] {_GROUP} END
        WHEN regexp_matches(tok[i], '[0-9]') THEN CASE WHEN i > 1 AND regexp_matches(tok[i - 1], '^[0-9]$') THEN '' ELSE '{_RULES.number}' END || translate(tok[i], '{''.join(_RULES.digits)}', '{''.join(_RULES.digits.values())}')
        WHEN regexp_matches(tok[i], '[a-j]') AND i > 1 AND regexp_matches(tok[i - 1], '^[0-9]$') THEN '{_RULES.letter}' || {_ONE.replace('(t,', '(tok[i],')} ELSE {_ONE.replace('(t,', '(tok[i],')} END)"""
_KNOWN = "".join(_RULES.chars).replace("'", "''").replace("-", "") + "0-9-"
_ROUTES = f"""
    SELECT s.id, s.pos, s.table_id, s.text, CASE WHEN i.table_id IS NULL THEN 'pending' WHEN s.text IS NULL THEN 'missing' WHEN NOT regexp_matches(lower(s.text), '^[{_KNOWN}]*$') THEN 'undefined' ELSE 'ok' END AS reason,
        regexp_extract_all(lower(s.text), '{_TOKENS}') AS tok FROM ({_SEGS}) s LEFT JOIN (SELECT table_id FROM inventory WHERE base_lang IN ('en', 'de', 'fr', 'es')) i USING (table_id)"""
_ENC = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_A64 = T.ASCII64.replace("'", "''")
_OPENED = f"CASE WHEN doc_type = 'math' THEN '{P.MATH_OPEN}' || braille || '{P.MATH_CLOSE}' || braille ELSE braille END"
ORACLES = {
    "base_languages": f"SELECT {_BASE_LANG} AS lang, count(*) AS tables FROM inventory GROUP BY 1",
    "best_tables": """
        SELECT base_lang, table_id FROM inventory QUALIFY row_number() OVER (PARTITION BY base_lang ORDER BY (status = 'current')::INT DESC, coalesce(try_cast(grade AS INT), -1) DESC,
            CASE contraction WHEN 'no' THEN 0 WHEN 'partial' THEN 1 WHEN 'full' THEN 2 ELSE -1 END DESC, table_id) = 1""",
    "strict_schema_errors": f"WITH r AS ({_LATEST}) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS error, count(*) AS records FROM r WHERE {c}" for n, c in _STRICT.items()) + ") WHERE records > 0",
    "label_filters": f"SELECT starts_with(engine, 'eng-3b') AS newer_engine, starts_with(tables[1], 'zh') AS chinese, count(*) AS records FROM ({_LATEST}) GROUP BY 1, 2",
    "length_caps": f"""
        WITH r AS (SELECT form, coalesce(strlen(text), 0) + coalesce(strlen(braille), 0) AS n FROM ({_LATEST}))
        SELECT form, sum((n <= 1024)::INT)::BIGINT AS kept, sum((n > 1024)::INT)::BIGINT AS dropped, max(n) FILTER (n <= 1024)::BIGINT AS longest FROM r GROUP BY form""",
    "padded_ids": "SELECT genre, (count(*) * max(strlen(src) + 1))::BIGINT AS ids, (count(*) * max(strlen(src) + 1) - sum(strlen(src) + 1))::BIGINT AS pads FROM nikl_pairs WHERE src IS NOT NULL GROUP BY genre",
    "term_frequencies": rf"""
        WITH l AS ({_CLEAN20}), w AS (SELECT string_split(trim(regexp_replace(lower(line), '[ \t\r\n]+', ' ', 'g'), ' '), ' ') AS w FROM l),
        p AS (SELECT gram AS term, count(*) AS uses FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w) GROUP BY 1 ORDER BY uses DESC, term LIMIT 50),
        c AS (SELECT term, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(line, '[A-Z][a-z]{{2,}}')) AS term FROM l) GROUP BY 1 ORDER BY uses DESC, term LIMIT 50)
        SELECT 'pair' AS kind, term, uses FROM p UNION ALL SELECT 'capital', term, uses FROM c""",
    "clean_paragraphs": f"SELECT source, count(*) AS paragraphs, sum(length(p))::BIGINT AS chars, min(sha1(p)) AS least FROM (SELECT source, {_NOURL} AS p FROM ({_LINES})) WHERE length(p) >= 20 GROUP BY source",
    "one_line_changes": r"""
        SELECT source, count(*) AS documents, sum((regexp_replace(text, '\r\n|\r|\n', ' ', 'g') <> text)::INT)::BIGINT AS breaks, sum((nfc_normalize(text) <> text)::INT)::BIGINT AS forms
        FROM documents WHERE text IS NOT NULL GROUP BY source""",
    "math_spans": f"""
        WITH r AS (SELECT form, string_split({_OPENED}, '{P.MATH_OPEN}') AS p FROM ({_LATEST}) WHERE braille IS NOT NULL), e AS (SELECT form, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM r),
        s AS (SELECT form, 'prose' AS kind, CASE WHEN i = 1 THEN x WHEN contains(x, '{P.MATH_CLOSE}') THEN substr(x, strpos(x, '{P.MATH_CLOSE}') + 2) ELSE '' END AS c FROM e
            UNION ALL SELECT form, 'math', CASE WHEN i = 1 THEN '' WHEN contains(x, '{P.MATH_CLOSE}') THEN substr(x, 1, strpos(x, '{P.MATH_CLOSE}') - 1) ELSE x END FROM e)
        SELECT form, kind, count(*) AS pieces, sum(length(c))::BIGINT AS cells FROM s WHERE c <> '' GROUP BY 1, 2""",
    "formula_texts": rf"""
        WITH r AS (SELECT form, latex_canonical, regexp_replace(regexp_replace(' ' || braille || chr(9), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '[ \t\r\n]+', '⠀', 'g') AS c FROM ({_LATEST}))
        SELECT form, sum((latex_canonical IS NOT NULL)::INT) FILTER (latex_canonical IS NOT NULL)::BIGINT AS same, count(c) FILTER (regexp_matches(c, '^[\x{{2800}}-\x{{28FF}}]+$')) AS cell_rows, min(c) FILTER (regexp_matches(c, '^[\x{{2800}}-\x{{28FF}}]+$')) AS least
        FROM r GROUP BY form""",
    "folded_texts": f"SELECT source, count(DISTINCT line) AS lines, count(DISTINCT f) AS folded, min(sha1(f)) AS least FROM (SELECT source, line, {_FOLDED} AS f FROM ({_CLEAN20})) GROUP BY source",
    "last_lines": r"""
        WITH c AS (SELECT unnest(cands) AS c FROM cand_pools), l AS (SELECT c.finish AS finish, c.text AS text, trim(array_to_string(string_split(regexp_replace(c.text, '[ \t\r\n]+$', ''), chr(10))[-1:], ''), ' ') AS l FROM c WHERE c.text IS NOT NULL)
        SELECT finish, count(*) AS candidates, sum((l <> text)::INT)::BIGINT AS cut, sum(length(l))::BIGINT AS chars FROM l GROUP BY finish""",
    "model_verdicts": f"""
        WITH v AS (SELECT rec_id, table_id, model, min(edit) AS e, min(cer) AS c FROM ({_LATEST_SCORES}) WHERE decoding = 'greedy' GROUP BY 1, 2, 3)
        SELECT model, CASE WHEN e = 0 THEN 'exact' WHEN c <= 0.1::DOUBLE THEN 'close' WHEN c IS NOT NULL THEN 'wrong' ELSE 'unscored' END AS verdict, count(*) AS records FROM v GROUP BY 1, 2""",
    "routed_transcription": f"""
        WITH r AS ({_ROUTES}), c AS (SELECT *, CASE WHEN reason = 'ok' THEN array_to_string({_CELLS_OF}, '') END AS cells FROM r)
        SELECT table_id, reason, count(*) AS segments, sum(length(cells))::BIGINT AS cells, sum(CASE WHEN reason = 'ok' THEN length(text) - length(tok[len(tok)]) END)::BIGINT AS last FROM c GROUP BY 1, 2""",
    "back_translation": f"WITH r AS ({_ROUTES}) SELECT table_id, count(*) AS segments, count(*) AS same FROM r WHERE reason = 'ok' GROUP BY 1",
    "judge_inputs": f"""
        WITH c AS (SELECT id, arg_min(cands, to_json(cands)::VARCHAR)[1].text AS text FROM cand_pools GROUP BY id), j AS (SELECT c.text AS text, r.text AS ref, trim(coalesce(c.text, ''), ' ') <> '' AS asked FROM c JOIN ({_LATEST}) r USING (id))
        SELECT CASE WHEN asked THEN NULL ELSE 1 END::BIGINT AS rating, count(*) AS pairs, sum(least(length(ref), 6000) + least(length(text), 6000)) FILTER (asked)::BIGINT AS chars FROM j GROUP BY 1""",
    "option_spans": """
        WITH p AS (SELECT doc_id % 4 AS how, regexp_extract(text, '[A-Za-z]+') AS run FROM documents WHERE text IS NOT NULL)
        SELECT CASE WHEN how = 0 THEN 'valid' WHEN how IN (1, 2) OR length(run) = 1 THEN 'order' ELSE 'part_of_run' END AS why, count(*) AS documents FROM p WHERE run <> '' GROUP BY 1""",
    "wrong_joiners": rf"""
        WITH n AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {_STRIP.format(x='line')} AS line FROM ({_LINES}) WHERE lower(substr(lang, 1, 2)) IN ('zh', 'ja'))
            WHERE length(line) BETWEEN 8 AND 600 AND regexp_matches(line, '^[\x{{4E00}}-\x{{9FFF}}].*[\x{{4E00}}-\x{{9FFF}}]$') GROUP BY 1)
        SELECT coalesce(sum(n - 1), 0)::BIGINT AS texts FROM n""",
    "consistency_rates": f"""
        WITH s AS (SELECT split, coalesce(CASE WHEN translate({_ENC}, '{_A64}', '') = '' THEN translate({_ENC}, '{_A64}', '{T.CELLS64}') END = s.braille, false) AS ok FROM (SELECT * FROM ({_SEGS})) s JOIN (SELECT id, split FROM ({_LATEST})) USING (id) WHERE s.braille IS NOT NULL)
        SELECT split, count(*) AS segments, sum(ok::INT)::BIGINT AS consistent, round(avg(ok::INT::DOUBLE), 9) AS rate FROM s GROUP BY split""",
    "inventory_identity": "SELECT CASE WHEN holdout THEN 'new' ELSE 'changed' END AS why, count(*) AS tables FROM inventory WHERE holdout OR status = 'superseded' GROUP BY 1",
    "records_at": f"SELECT n AS at, id, split FROM (SELECT id, split, row_number() OVER (ORDER BY id) - 1 AS n FROM ({_LATEST})) WHERE n % 100 = 0",
}
