"""Readers of external corpora: parallel pairs, verse files, article shards, logs, sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators.ranking import ordered_rank
from textloom.operators.sampling import hash_rank

PAIRS_SCHEMA = "document struct<id:string>, parallel array<struct<id:string,src:string,tgt:string>>"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(id, ed, genre, doc, split, src, tgt): nested parallel files; the edition is in the path, the genre in the name.

    A fifth of the documents, by hash, is the test split.
    """
    raw = spark.read.schema(PAIRS_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("_p", F.col("_metadata.file_path"))
    doc = F.coalesce("document.id", F.regexp_extract("_p", "([^/]+)[.]json$", 1))
    rows = raw.select(F.regexp_extract("_p", "([0-9]{4})", 1).alias("ed"), F.substring(F.regexp_extract("_p", "([^/]+)[.]json$", 1), 1, 2).alias("genre"), doc.alias("doc"), F.explode("parallel").alias("x"))
    split = F.when(T.hex_sum_mod5("doc") == 0, "test").otherwise("dev")
    return rows.select("x.id", "ed", "genre", "doc", split.alias("split"), "x.src", "x.tgt")


def read_verses(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, verse, text): nested chapters of verses."""
    raw = spark.read.schema("chapters array<struct<chapter:int,verses:array<struct<verse:int,text:string>>>>").option("multiLine", True).json(path)
    c = raw.select(F.explode("chapters").alias("c")).select("c.chapter", F.explode("c.verses").alias("v"))
    return c.select("chapter", "v.verse", "v.text")


def parse_verse_stream(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chapter, verse, body, note): a stream cut at ``#c3v`` markers (letters a to j are the digits 1 to 0).

    Markers that repeat or don't ascend are noted, not dropped.
    """
    number = lambda x: F.translate(x, "abcdefghij", "1234567890").cast("int")
    marked = F.split(F.regexp_replace(text, "#([a-j]+)c([a-j]+)v", "⟂$1⟂$2⟂"), "⟂")
    parts = rows.select(key, marked.alias("m")).select(key, F.explode(F.expr("case when size(m) > 3 then transform(sequence(1, size(m) - 3, 3), i -> struct(i, m[i] as c, m[i + 1] as v, m[i + 2] as body)) else array() end")).alias("x"))
    out = parts.select(key, "x.i", number("x.c").alias("chapter"), number("x.v").alias("verse"), F.trim("x.body").alias("body"))
    before = F.lag(F.struct("chapter", "verse")).over(Window.partitionBy(key).orderBy("i"))
    here = F.struct("chapter", "verse")
    return out.withColumn("note", F.when(before == here, "repeated").when(before > here, "not_ascending")).drop("i")


def article_shards(articles: DataFrame, order: str, sentences: str, lang: str, first_target: int, second_target: int) -> DataFrame:
    """(lang, order, shard): articles fill shard B up to its target of sentences, then A; the rest is spare.

    The boundary is where the running number of sentences reaches the target.
    """
    n = ordered_rank(articles.withColumn("_size", F.size(sentences)), [lang], [order], out="_before_it", value="_size")
    shard = F.when(F.col("_before_it") < first_target, "B").when(F.col("_before_it") < first_target + second_target, "A")
    return n.withColumn("shard", shard).drop("_size", "_before_it")


def capped(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """At most ``most`` distinct keys of each group, in hash order."""
    return hash_rank(rows.dropDuplicates([group, key]), [group], "cap", key, "_r").where(F.col("_r") <= most).drop("_r")


def normalised_for(lang: str, text: str):
    """Language-specific clean-up: zero-width spaces of Thai, Lao, Khmer and Burmese become blanks; Bengali nukta letters their pairs."""
    x, code = F.col(text), F.lower(F.substring(lang, 1, 2))
    spaced = T.squeezed_blanks(F.regexp_replace(x, "\\x{200B}", " "))
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "ড\\x{09BC}", "ড়"), "ঢ\\x{09BC}", "ঢ়"), "য\\x{09BC}", "য়")
    return F.when(code.isin("th", "lo", "km", "my"), spaced).when(code == "bn", joined).otherwise(x)


def best_code(langs: DataFrame, codes: DataFrame, scripts: list[str], preferred: dict[str, str] | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """(lang, code): the code ``xxx_Script`` of each (lang, lang3).

    An override of a language counts alone, if it is one of the codes; else the
    language's preferred script comes first, then ``scripts`` in order, then names.
    A language without a code isn't there.
    """
    c = codes.select("code", F.split_part("code", F.lit("_"), F.lit(1)).alias("lang3"), F.split_part("code", F.lit("_"), F.lit(2)).alias("_script"))
    looked_up = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("lang")] if m else F.lit(None).cast("string")
    at = F.array_position(F.array(*[F.lit(s) for s in scripts]), F.col("_script")) if scripts else F.lit(0)
    rank = F.when(F.col("_script") == looked_up(preferred), 0).otherwise(F.coalesce(F.nullif(at, F.lit(0)), F.lit(99)))
    named = langs.withColumn("_own", looked_up(overrides))
    free = named.where("_own is null").join(c, "lang3").groupBy("lang").agg(F.min_by("code", F.struct(rank, "code")).alias("code"))
    return free.unionByName(named.where("_own is not null").join(c.select(F.col("code").alias("_own")), "_own", "left_semi").select("lang", F.col("_own").alias("code")))


def read_log(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, line_no, value): numbers that the pattern's first group finds in logs, in order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\r?\n").alias("l"))
    lines = whole.select("file", F.posexplode("l").alias("line_no", "line"))
    return lines.select("file", "line_no", F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1))).alias("v")).select("file", "line_no", F.col("v").cast("double").alias("value"))


def attach(rows: DataFrame, sidecar: DataFrame, key: str, text: str) -> DataFrame:
    """(key, options, problem): options of a sidecar bound to the text's digest; problems are named, not dropped.

    unknown: no such row.  repeated: two sidecar rows.  stale: another text.  leaked: made from annotations of a test row.
    """
    side = sidecar.groupBy(key).agg(F.count("*").alias("_n"), F.min_by(F.struct("source_sha256", "options", "provenance"), "source_sha256").alias("_o"))
    j = rows.join(side, key, "full")
    problem = (
        F.when(F.col(text).isNull() & F.col("_n").isNotNull(), "unknown")
        .when(F.col("_n") > 1, "repeated")
        .when(F.col("_o.source_sha256") != F.sha2(F.col(text), 256), "stale")
        .when((F.col("split") == "test") & (F.col("_o.provenance") == "dev_annotation"), "leaked")
    )
    return j.select(key, F.coalesce("_o.options", F.lit("{}")).alias("options"), problem.alias("problem"))


def tolerant_examples(spark: SparkSession, path: str, fields: list[str], least: int = 2) -> DataFrame:
    """(field, text): texts under any of the fields of JSON lines; broken lines and short texts are passed over."""
    schema = ", ".join(f"`{f}` string" for f in fields)
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return raw.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")).select("x.*").where(F.length("text") >= least)
