"""Cell strings: dot noise and its audit, prompts and their parsing, splicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import text as T


def cell_codes(x: str | Column) -> Column:
    """Code of each character: 0 to 255 for cells, -1 for others."""
    chars = F.filter(F.split(T.c(x), ""), lambda ch: ch != "")
    return F.transform(chars, lambda ch: F.when((F.ascii(ch) >= 0x2800) & (F.ascii(ch) <= 0x28FF), F.ascii(ch) - 0x2800).otherwise(F.lit(-1)))


def dots(code: Column) -> Column:
    """Dot numbers of a cell code."""
    return F.filter(F.sequence(F.lit(1), F.lit(8)), lambda d: F.expr("1").cast("int") * F.getbit(code, d - 1) == 1)


def flip_mask(seed: str, key: str | Column, position: Column, p: float, n_dots: int = 6) -> Column:
    """Bits to flip in one cell: each of the dots independently with chance p, by hash."""
    bit = lambda d: F.when(T.uniform(seed, key, position, F.lit(d)) < p, F.lit(1 << d)).otherwise(F.lit(0))
    out = bit(0)
    for d in range(1, n_dots):
        out = out + bit(d)
    return out


def flipped(rows: DataFrame, key: str, braille: str, p: float, seed: str) -> DataFrame:
    """(key, pos, old, new): each cell with its noisy form; a row per cell, characters that are no cells stay."""
    cells = rows.select(key, F.posexplode(cell_codes(braille)).alias("pos", "old"))
    return cells.withColumn("new", F.when(F.col("old") < 0, F.col("old")).otherwise(F.col("old").bitwiseXOR(flip_mask(seed, key, F.col("pos"), p))))


def flips_audit(noisy: DataFrame, key: str) -> DataFrame:
    """Per row: cells, cells changed, dots flipped."""
    cells = noisy.where("old >= 0")
    return cells.groupBy(key).agg(
        F.count("*").alias("cells"), F.sum((F.col("old") != F.col("new")).cast("bigint")).alias("changed"), F.sum(F.bit_count(F.col("old").bitwiseXOR(F.col("new"))).cast("bigint")).alias("flips")
    )


def prompt(tables: Column, braille: Column) -> Column:
    """The prompt of a record: its tables, then its cells."""
    return F.concat(F.lit("<|tables|>"), F.array_join(tables, ","), F.lit("<|braille|>"), braille)


def completion(segments: Column) -> Column:
    """The completion: each segment's table in angle brackets before its text, one per line."""
    return F.concat(F.lit("<|text|>"), F.array_join(F.transform(segments, lambda s: F.concat(F.lit("⟨"), s["table_id"], F.lit("⟩"), s["text"])), "\n"))


def parse_strict(x: str | Column) -> Column:
    """Segments of a completion whose every line is ``⟨table⟩text``; an empty array if any line isn't."""
    lines = F.split(F.regexp_replace(T.c(x), "^<\\|text\\|>", ""), "\n")
    good = F.forall(lines, lambda line: line.rlike("^⟨[^⟨⟩]+⟩.*$"))
    parsed = F.transform(lines, lambda line: F.struct(F.regexp_extract(line, "^⟨([^⟨⟩]+)⟩(.*)$", 1).alias("table_id"), F.regexp_extract(line, "^⟨([^⟨⟩]+)⟩(.*)$", 2).alias("text")))
    return F.when(good, parsed).otherwise(F.from_json(F.lit("[]"), "array<struct<table_id:string,text:string>>"))


def parse_loose(x: str | Column) -> Column:
    """Segments of a completion cut before each ``⟨``, texts over several lines allowed; null if malformed."""
    body = F.trim(F.regexp_replace(T.c(x), "^<\\|text\\|>", ""))
    parts = F.split(body, "\n(?=⟨)")
    good = F.forall(parts, lambda p: p.rlike("(?s)^⟨[^⟩]*⟩.*$"))
    return F.when(good, F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, "(?s)^⟨([^⟩]*)⟩(.*)$", 1)).alias("table_id"), F.regexp_extract(p, "(?s)^⟨([^⟩]*)⟩(.*)$", 2).alias("text"))))


def spliced(x: str | Column, span: str | Column, u: Column) -> Column:
    """The text with the span put before one of its later words, chosen by u; one-word texts stay."""
    words = F.split(T.c(x), " ")
    at = F.least(F.floor(u * (F.size(words) - 1)).cast("int") + 1, F.size(words) - 1)
    return F.when(F.size(words) < 2, T.c(x)).otherwise(F.array_join(F.concat(F.slice(words, F.lit(1), at), F.array(T.c(span)), F.slice(words, at + 1, F.size(words))), " "))
