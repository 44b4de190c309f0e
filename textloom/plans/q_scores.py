"""Queries over candidate pools and score rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import edits as E, text as T
from textloom.operators import records as R, scoring as S
from textloom.plans.q_lines import _U
from textloom.plans.q_records import _LATEST, _records
from textloom.session import table


def _scores(spark, d):
    return R.latest(table(spark, d, "score_rows"), ["rec_id", "table_id", "model", "cond", "decoding"], "loaded_at")


# A later delivery of a score wins; equal deliveries are the same row.
_SCORES = "SELECT DISTINCT * FROM score_rows QUALIFY row_number() OVER (PARTITION BY rec_id, table_id, model, cond, decoding ORDER BY loaded_at DESC) = 1"


def _pools(spark, d):
    """Each pool once, by its candidates; scored against the record's whole text."""
    pools = table(spark, d, "cand_pools")
    return pools.groupBy("id").agg(F.min_by("cands", F.to_json("cands")).alias("cands"))


def _scored(spark, d):
    """(id, idx, text, lp, d, cer): d is a stand-in for the distance of cells, the distance of the whole texts in code points."""
    refs = _records(spark, d).select("id", F.col("text").alias("ref"))
    cands = S.candidates_long(_pools(spark, d)).join(refs, "id")
    hyp = F.col("text")
    return cands.withColumn("d", F.levenshtein("ref", hyp)).withColumn("cer", T.error_rate(F.col("ref"), hyp))


# The pool of an id that was delivered in several forms is the one that comes first as JSON.
_ONE_POOL = "SELECT id, arg_min(cands, to_json(cands)::VARCHAR) AS cands FROM cand_pools GROUP BY id"
_CANDS = f"SELECT id, generate_subscripts(cands, 1) - 1 AS idx, unnest(list_transform(cands, lambda c: c.lp)) AS lp, unnest(list_transform(cands, lambda c: c.text)) AS text FROM ({_ONE_POOL})"


def policy_select(spark, d):
    """The candidate that each policy takes."""
    return S.choose(_scored(spark, d), *S.POLICIES).select("id", "policy", F.col("idx").cast("bigint").alias("idx"))


def policy_likely(spark, d):
    """The policies that need no reference."""
    cands = S.candidates_long(_pools(spark, d)).withColumns({"d": F.lit(None).cast("int"), "cer": F.lit(None).cast("double")})
    return S.choose(cands, "greedy", "likely").select("id", "policy", F.col("idx").cast("bigint").alias("idx"))


def policy_rates(spark, d):
    chosen = S.choose(_scored(spark, d), *S.POLICIES)
    return chosen.groupBy("policy").agg(F.count("*").alias("pools"), F.round(F.avg("cer"), 6).alias("cer"), F.sum((F.col("d") == 0).cast("bigint")).alias("exact"))


def pool_checks(spark, d):
    c = S.candidates_long(_pools(spark, d))
    return c.groupBy("finish").agg(
        F.count("*").alias("candidates"),
        F.sum((F.coalesce(F.length("text"), F.lit(0)) == 0).cast("bigint")).alias("empty"),
        F.sum(F.col("lp").isNull().cast("bigint")).alias("no_lp"),
        F.sum((F.col("greedy") & (F.col("idx") != 0)).cast("bigint")).alias("greedy_late"),
    )


def repeated_pools(spark, d):
    return table(spark, d, "cand_pools").groupBy("id").agg(F.count("*").alias("deliveries"), F.count_distinct(F.to_json("cands")).alias("forms")).where("deliveries > 1")


def reward_rule(spark, d):
    """Reward per first candidate: error part, exactness, and a penalty for empty or runaway text."""
    c = _scored(spark, d).where("idx = 0")
    n = F.length("text")
    runaway = n > 3 * F.length("ref") + 64
    r = F.when((F.coalesce(n, F.lit(0)) == 0), F.lit(-0.5)).otherwise(F.greatest(F.lit(0.0), 1 - F.col("cer")) + F.when((F.col("d") == 0) & ~runaway, 0.75).otherwise(0.0))
    return c.select("id", F.round(r, 6).alias("reward"))


def best_alpha(spark, d):
    """The length weight with the least mean error, the smallest on ties."""
    cands = _scored(spark, d).withColumn("lp", F.coalesce("lp", F.lit(-1e9)))
    grid = cands.select("*", F.explode(F.array(*[F.lit(a) for a in (0.0, 0.01, 0.02, 0.05, 0.1)])).alias("alpha"))
    score = F.round(F.col("lp") + F.col("alpha") * F.length("text"), 9)
    picked = grid.groupBy("alpha", "id").agg(F.min_by("cer", F.struct(-score, "idx")).alias("cer"))
    return picked.groupBy("alpha").agg(F.round(F.avg("cer"), 6).alias("cer")).orderBy("cer", "alpha").limit(1)


def micro_macro_summary(spark, d):
    s = _scores(spark, d).where("cer is not null")
    return s.groupBy("model", "decoding").agg(
        F.count("*").alias("n"), F.round(S.micro("edit", "n_ref"), 9).alias("micro_cer"), F.round(F.avg("cer"), 12).alias("macro_cer"), F.sum((F.col("edit") == 0).cast("bigint")).alias("exact"),
        F.sum(F.col("fallback").cast("bigint")).alias("fallbacks"), F.sum((F.col("cer") > 2).cast("bigint")).alias("runaway"),
    )


def order_statistics(spark, d):
    s = _scores(spark, d).where("cer is not null").withColumn("cer", F.round("cer", 6))
    out = S.order_statistics(s, ["model"], "cer")
    return out.select("model", "n", "median", "p90", F.round("trimmed", 12).alias("trimmed"))


def grouped_rates(spark, d):
    s = _scores(spark, d)
    sets = s.groupingSets([[F.col("model")], [F.col("model"), F.col("decoding")], [F.col("table_id")], []], "model", "decoding", "table_id")
    return sets.agg(F.count("*").alias("n"), F.sum("edit").alias("edits"), F.sum("n_ref").alias("refs"))


def long_metrics(spark, d):
    s = _scores(spark, d).groupBy("model").agg(F.round(S.micro("edit", "n_ref"), 9).alias("cer"), F.round(S.micro("edit_st", "n_ref"), 9).alias("cer_st"), F.round(F.avg("bcer"), 12).alias("bcer"))
    return S.long_metrics(s, ["model"], ["cer", "cer_st", "bcer"])


def metric_pivot(spark, d):
    s = _scores(spark, d)
    return s.groupBy("model").pivot("decoding", ["greedy", "vbon20"]).agg(F.round(S.micro("edit", "n_ref"), 9))


def score_histogram(spark, d):
    s = _scores(spark, d).where("cer is not null")
    b = F.least(F.greatest(F.floor(F.col("cer") * 20 + 0.5), F.lit(0)), F.lit(20))
    return s.groupBy(b.cast("bigint").alias("bin")).agg(F.count("*").alias("n"), F.round(F.count("*") / F.sum(F.count("*")).over(Window.partitionBy()), 9).alias("share"))


def score_gap(spark, d):
    """Rates against the greedy ones of the same model and code."""
    s = _scores(spark, d).groupBy("model", "table_id", "decoding").agg(S.micro("edit", "n_ref").alias("cer"))
    a, b = s.where("decoding = 'greedy'").drop("decoding").withColumnRenamed("cer", "base"), s.where("decoding <> 'greedy'")
    return b.join(a, ["model", "table_id"]).select("model", "table_id", "decoding", F.round(F.col("cer") - F.col("base"), 9).alias("gap"))


def code_verdicts(spark, d):
    s = _scores(spark, d).where("cer is not null").groupBy("table_id").agg(F.every(F.col("edit") == 0).alias("p"), F.every(F.col("edit") > 0).alias("z"), F.count_distinct(F.round("cer", 9)).alias("v"))
    v = F.when(F.col("p"), "all_perfect").when(F.col("v") == 1, "no_variance").when(F.col("z"), "all_wrong").otherwise("mixed")
    return s.groupBy(v.alias("verdict")).agg(F.count("*").alias("codes"))


def top_codes(spark, d):
    """The three codes of most errors for each model, with their share of its errors."""
    s = _scores(spark, d).groupBy("model", "table_id").agg(F.sum("edit").alias("edits"))
    w = Window.partitionBy("model")
    ranked = s.withColumn("r", F.row_number().over(w.orderBy(F.desc("edits"), "table_id"))).withColumn("share", F.round(F.col("edits") / F.sum("edits").over(w), 9))
    return ranked.where("r <= 3").select("model", "table_id", "edits", "share", F.col("r").cast("bigint").alias("r"))


def score_slope(spark, d):
    """Least-squares slope of the error rate over days, where a model has two days or more."""
    s = _scores(spark, d).where("cer is not null").withColumn("day", F.datediff(F.col("scored_at"), F.lit("2030-01-01").cast("date")))
    return s.groupBy("model").agg(F.round(F.regr_slope("cer", "day") * 1000, 5).alias("slope"), F.count_distinct("day").alias("days")).where("days >= 2")


def score_corrections(spark, d):
    """Scores delivered again: how many, and how many of them changed."""
    s = table(spark, d, "score_rows").groupBy("rec_id", "table_id", "model", "cond", "decoding").agg(F.count("*").alias("n"), F.count_distinct("edit").alias("v"))
    return s.where("n > 1").groupBy("model").agg(F.count("*").alias("again"), F.sum((F.col("v") > 1).cast("bigint")).alias("corrected"))


def late_scores(spark, d):
    s = table(spark, d, "score_rows")
    hours = F.floor((F.unix_micros(F.col("loaded_at").cast("timestamp")) - F.unix_micros(F.col("scored_at").cast("timestamp"))) / 3_600_000_000)
    return s.groupBy(F.least(hours, F.lit(48)).cast("bigint").alias("hours_late")).agg(F.count("*").alias("n"))


def bootstrap_ci(spark, d):
    s = _scores(spark, d).where("edit is not null")
    out = S.bootstrap(s, ["model"], "edit", "n_ref", "rec_id")
    return out.select("model", F.round("point", 6).alias("point"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def corpus_bleu(spark, d):
    refs = _records(spark, d).select("id", F.col("text").alias("ref"))
    return S.bleu(S.candidates_long(_pools(spark, d)).where("idx = 0").join(refs, "id").where("text is not null"), "ref", "text")


def chrf_mean(spark, d):
    refs = _records(spark, d).select("id", F.col("text").alias("ref"))
    c = S.candidates_long(_pools(spark, d)).where("idx = 0").join(refs, "id")
    return c.agg(F.count("*").alias("pairs"), F.round(F.avg(E.chrf_score("ref", "text")), 6).alias("chrf"))


def edit_categories(spark, d):
    refs = _records(spark, d).select("id", F.col("text").alias("ref"))
    c = S.candidates_long(_pools(spark, d)).where("idx = 0").join(refs, "id")
    e = c.select(F.explode(E.edits("ref", "text")).alias("e"))
    return e.groupBy("e.op", "e.category").agg(F.count("*").alias("edits"))


def word_error_rates(spark, d):
    refs = _records(spark, d).select("id", "form", F.col("text").alias("ref"))
    c = S.candidates_long(_pools(spark, d)).where("idx = 0").join(refs, "id")
    words = F.size(F.split(T.squeezed_blanks("ref"), " "))
    return c.withColumn("w", words).withColumn("e", E.word_edits("ref", "text")).groupBy("form").agg(F.count("*").alias("pairs"), F.round(S.micro("e", "w"), 6).alias("wer"))


def cell_error_rates(spark, d):
    refs = _records(spark, d).where("braille is not null").select("id", "form", F.col("text").alias("ref"), "braille")
    c = S.candidates_long(_pools(spark, d)).where("idx = 0").join(refs, "id").withColumn("ce", E.cell_edits("ref", "braille", "text"))
    return c.groupBy("form").agg(F.sum("ce.err").alias("err"), F.sum("ce.cells").alias("cells"))


def expected_digit(spark, d):
    """Expected value of a rating whose log probabilities are those of the first five candidates."""
    c = S.candidates_long(_pools(spark, d)).where("idx < 5 and lp is not null")
    return c.groupBy("id").agg(F.round(F.sum((F.col("idx") + 1) * F.exp("lp")) / F.sum(F.exp("lp")), 6).alias("rating"))


def segment_error_rates(spark, d):
    """Cell errors per code: the first candidate of each record against its segments."""
    seg = F.coalesce(
        F.transform("segments", lambda s: F.struct(s["table_id"].alias("table_id"), s["text"].alias("text"), s["braille"].alias("braille"))),
        F.array(F.struct(F.get("tables", F.lit(0)).alias("table_id"), F.col("text").alias("text"), F.col("braille").alias("braille"))),
    )
    r = _records(spark, d).select("id", seg.alias("segs"))
    c = S.candidates_long(_pools(spark, d)).where("idx = 0 and text is not null").select("id", "text").join(r, "id")
    hyp = F.transform(F.split("text", "\n"), lambda line, i: F.struct(F.get("segs", F.least(i, F.size("segs") - 1))["table_id"].alias("table_id"), line.alias("text")))
    e = c.select(F.explode(F.arrays_zip("segs", E.segment_cell_edits("segs", hyp).alias("e"))).alias("x"))
    return e.groupBy(F.col("x.segs.table_id").alias("table_id")).agg(F.sum("x.e.err").alias("err"), F.sum("x.e.cells").alias("cells"))


def _paired(spark, d):
    """(table_id, unit, edits and lengths under both decodings) of rows scored both ways by one model and condition."""
    s = _scores(spark, d).where("edit is not null")
    side = lambda decoding, a, b: s.where(F.col("decoding") == decoding).select("rec_id", "table_id", "model", "cond", F.col("edit").alias(a), F.col("n_ref").alias(b))
    a, b = side("greedy", "ea", "na"), side("vbon20", "eb", "nb").withColumnRenamed("cond", "_c")
    return a.join(b, ["rec_id", "table_id", "model"]).where(F.col("cond").eqNullSafe(F.col("_c"))).drop("_c")


def paired_difference(spark, d):
    """Points: micro error rate of verified best-of-20 less that of greedy decoding on the rows scored both ways, per model."""
    return _paired(spark, d).groupBy("model").agg(F.count("*").alias("units"), F.round(S.micro("eb", "nb") - S.micro("ea", "na"), 9).alias("difference"))


def paired_bootstrap(spark, d):
    """The same difference with its interval over resamples of the records."""
    out = S.paired_bootstrap(_paired(spark, d), ["model"], ("ea", "na"), ("eb", "nb"), "rec_id")
    return out.select("model", "units", *[F.round(c, 6).alias(c) for c in ("difference", "low", "high", "not_below")])


def _first(spark, d):
    refs = _records(spark, d).select("id", "form", F.col("text").alias("ref"))
    return S.candidates_long(_pools(spark, d)).where("idx = 0").join(refs, "id")


def bleu_tokenizers(spark, d):
    """Corpus BLEU of the first candidates under each tokenizer."""
    out = None
    for how in ("none", "13a", "zh"):
        part = S.bleu(_first(spark, d).where("text is not null"), "ref", "text", how).select(F.lit(how).alias("tokenizer"), "*")
        out = part if out is None else out.unionAll(part)
    return out


def chrf_corpus(spark, d):
    """Corpus F-score of characters alone, and with words of orders 1 and 2."""
    pairs = _first(spark, d).where("text is not null")
    return S.chrf(pairs, "ref", "text", 0).select(F.lit(0).alias("word_order"), "*").unionAll(S.chrf(pairs, "ref", "text", 2).select(F.lit(2).alias("word_order"), "*"))


QUERIES = {
    f.__name__: f
    for f in (
        policy_select, policy_likely, policy_rates, segment_error_rates, paired_difference, paired_bootstrap, bleu_tokenizers, chrf_corpus, pool_checks, repeated_pools, reward_rule, best_alpha, micro_macro_summary, order_statistics, grouped_rates, long_metrics, metric_pivot, score_histogram,
        score_gap, code_verdicts, top_codes, score_slope, score_corrections, late_scores, bootstrap_ci, corpus_bleu, chrf_mean, edit_categories, word_error_rates, cell_error_rates, expected_digit,
    )
}


ORACLES = {
    "policy_likely": f"""
        WITH c AS ({_CANDS}) SELECT id, 'greedy' AS policy, 0::BIGINT AS idx FROM c GROUP BY id
        UNION ALL SELECT id, 'likely', idx::BIGINT FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY -coalesce(lp, -1e9), idx) = 1""",
    "paired_difference": f"""
        WITH s AS (SELECT * FROM ({_SCORES}) WHERE edit IS NOT NULL)
        SELECT a.model, count(*) AS units, round(sum(b.edit) / sum(b.n_ref) - sum(a.edit) / sum(a.n_ref), 9) AS difference
        FROM s a JOIN s b ON a.rec_id = b.rec_id AND a.table_id = b.table_id AND a.model = b.model AND a.cond IS NOT DISTINCT FROM b.cond AND a.decoding = 'greedy' AND b.decoding = 'vbon20' GROUP BY a.model""",
    "pool_checks": f"""
        WITH c AS (SELECT unnest(cands) AS c, generate_subscripts(cands, 1) - 1 AS idx FROM ({_ONE_POOL}))
        SELECT c.finish AS finish, count(*) AS candidates, sum((coalesce(length(c.text), 0) = 0)::INT)::BIGINT AS empty, sum((c.lp IS NULL)::INT)::BIGINT AS no_lp, sum((c.greedy AND idx <> 0)::INT)::BIGINT AS greedy_late FROM c GROUP BY 1""",
    "repeated_pools": "SELECT id, count(*) AS deliveries, count(DISTINCT to_json(cands)::VARCHAR) AS forms FROM cand_pools GROUP BY id HAVING count(*) > 1",
    "micro_macro_summary": f"""
        SELECT model, decoding, count(*) AS n, round(sum(edit) / sum(n_ref), 9) AS micro_cer, round(avg(cer), 12) AS macro_cer, sum((edit = 0)::INT)::BIGINT AS exact, sum(fallback::INT)::BIGINT AS fallbacks,
            sum((cer > 2)::INT)::BIGINT AS runaway FROM ({_SCORES}) WHERE cer IS NOT NULL GROUP BY 1, 2""",
    "order_statistics": f"""
        WITH s AS (SELECT model, round(cer, 6) AS cer, row_number() OVER (PARTITION BY model ORDER BY round(cer, 6)) - 1 AS r, count(*) OVER (PARTITION BY model) AS n FROM ({_SCORES}) WHERE cer IS NOT NULL)
        SELECT model, count(*) AS n, max(cer) FILTER (r = floor(n / 2)) AS median, max(cer) FILTER (r = floor(n * 0.9::DOUBLE)) AS p90,
            round(avg(cer) FILTER (r >= floor(n * 0.05::DOUBLE) AND r < floor(n * 0.95::DOUBLE)), 12) AS trimmed FROM s GROUP BY model""",
    "grouped_rates": f"SELECT model, decoding, table_id, count(*) AS n, sum(edit)::BIGINT AS edits, sum(n_ref)::BIGINT AS refs FROM ({_SCORES}) GROUP BY GROUPING SETS ((model), (model, decoding), (table_id), ())",
    "long_metrics": f"""
        UNPIVOT (SELECT model, round(sum(edit) / sum(n_ref), 9) AS cer, round(sum(edit_st) / sum(n_ref), 9) AS cer_st, round(avg(bcer), 12) AS bcer FROM ({_SCORES}) GROUP BY model)
        ON cer, cer_st, bcer INTO NAME metric VALUE value""",
    "metric_pivot": f"""
        SELECT model, round(sum(edit) FILTER (decoding = 'greedy') / sum(n_ref) FILTER (decoding = 'greedy'), 9) AS greedy, round(sum(edit) FILTER (decoding = 'vbon20') / sum(n_ref) FILTER (decoding = 'vbon20'), 9) AS vbon20
        FROM ({_SCORES}) GROUP BY model""",
    "score_histogram": f"""
        SELECT least(greatest(floor(cer * 20 + 0.5), 0), 20)::BIGINT AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM ({_SCORES}) WHERE cer IS NOT NULL GROUP BY 1""",
    "score_gap": f"""
        WITH s AS (SELECT model, table_id, decoding, sum(edit) / sum(n_ref) AS cer FROM ({_SCORES}) GROUP BY 1, 2, 3)
        SELECT b.model, b.table_id, b.decoding, round(b.cer - a.cer, 9) AS gap FROM s b JOIN s a USING (model, table_id) WHERE a.decoding = 'greedy' AND b.decoding <> 'greedy'""",
    "code_verdicts": f"""
        WITH v AS (SELECT table_id, bool_and(edit = 0) AS p, bool_and(edit > 0) AS z, count(DISTINCT round(cer, 9)) AS v FROM ({_SCORES}) WHERE cer IS NOT NULL GROUP BY 1)
        SELECT CASE WHEN p THEN 'all_perfect' WHEN v = 1 THEN 'no_variance' WHEN z THEN 'all_wrong' ELSE 'mixed' END AS verdict, count(*) AS codes FROM v GROUP BY 1""",
    "top_codes": f"""
        WITH s AS (SELECT model, table_id, sum(edit)::BIGINT AS edits FROM ({_SCORES}) GROUP BY 1, 2)
        SELECT model, table_id, edits, round(edits / sum(edits) OVER (PARTITION BY model), 9) AS share, row_number() OVER (PARTITION BY model ORDER BY edits DESC, table_id) AS r FROM s QUALIFY r <= 3""",
    "score_slope": f"""
        SELECT model, round(regr_slope(cer, date_diff('day', DATE '2030-01-01', scored_at::DATE)) * 1000, 5) AS slope, count(DISTINCT scored_at::DATE) AS days FROM ({_SCORES}) WHERE cer IS NOT NULL GROUP BY model HAVING count(DISTINCT scored_at::DATE) >= 2""",
    "score_corrections": """
        WITH s AS (SELECT model, count(*) AS n, count(DISTINCT edit) AS v FROM score_rows GROUP BY rec_id, table_id, model, cond, decoding)
        SELECT model, count(*) AS again, sum((v > 1)::INT)::BIGINT AS corrected FROM s WHERE n > 1 GROUP BY model""",
    "late_scores": "SELECT least(floor((epoch_us(loaded_at) - epoch_us(scored_at)) / 3600000000), 48)::BIGINT AS hours_late, count(*) AS n FROM score_rows GROUP BY 1",
    "expected_digit": f"SELECT id, round(sum((idx + 1) * exp(lp)) / sum(exp(lp)), 6) AS rating FROM ({_CANDS}) WHERE idx < 5 AND lp IS NOT NULL GROUP BY id",
}
