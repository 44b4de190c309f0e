"""Column functions on text, cells and keys.

All but the Unicode normal forms (``nfc``, ``loose``, which the JVM functions lack
and which go by Arrow batches) stay inside whole-stage code generation.  White
space is ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from textloom.functions import forms

CELL = "\\x{2800}-\\x{28FF}"
# Upper bounds of the length buckets, and the bucket names of the records.
BUCKETS = ((4, "snippet_1_4"), (10, "snippet_5_10"), (20, "snippet_11_20"), (40, "snippet_21_40"), (80, "snippet_41_80"))
# The 64 cells of six dots in the order of North American braille ASCII.
ASCII64 = " A1B'K2L@CIF/MSP\"E3H9O6R^DJG>NTQ,*5<-U8V.%[$+X!&;:4\\0Z7(_?W]#Y)="
CELLS64 = "".join(chr(0x2800 + i) for i in range(64))


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _loose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else forms.loose(x))


def nfc(x: str | Column) -> Column:
    """The composed normal form."""
    return _nfc(c(x))


def stripped(x: str | Column) -> Column:
    """Without blanks and tabs at the ends."""
    return F.regexp_replace(c(x), "^[ \\t]+|[ \\t]+$", "")


def squeezed_blanks(x: str | Column) -> Column:
    """Ends trimmed, each run of white space one blank."""
    return F.trim(F.regexp_replace(c(x), "[ \\t\\r\\n]+", " "))


def loose(x: str | Column) -> Column:
    """The case-folded NFKC form without punctuation, symbols, separators, control and format characters."""
    return _loose(c(x))


def key64(x: str | Column) -> Column:
    """The first 64 bits of SHA-1 as a signed number."""
    return F.conv(F.substring(F.sha1(c(x)), 1, 16), 16, -10).cast("bigint")


def uniform(seed: str, *keys: str | Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone."""
    text = F.concat_ws(":", F.lit(seed), *[c(k).cast("string") for k in keys])
    return F.conv(F.substring(F.sha1(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def sub_sentences(x: str | Column) -> Column:
    """Pieces after sentence punctuation: followed by a blank for spaced scripts, anywhere for full-width marks.

    Pieces of at least 16 characters stay, of 8 if a kana or ideograph is in them.
    """
    marked = F.regexp_replace(c(x), "([.!?…؟।])[ ]+", "$1⟂")
    marked = F.regexp_replace(marked, "([。！？；;])", "$1⟂")
    parts = F.transform(F.split(marked, "⟂"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (F.length(p) >= 16) | ((F.length(p) >= 8) & p.rlike("[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}]")))


def unit_keys(x: str | Column, lo: str | Column) -> Column:
    """64-bit keys of a unit in NFC and of its loose form, where that has at least 8 characters."""
    return F.array_compact(F.array(F.xxhash64(squeezed_blanks(x)), F.when(F.length(c(lo)) >= 8, F.xxhash64(F.concat(F.lit("~"), c(lo))))))


def letters(x: str | Column) -> Column:
    return F.length(F.regexp_replace(c(x), "[^\\p{L}]", ""))


def latin_share(x: str | Column) -> Column:
    """Share of a-z among the letters; 1 where there are none."""
    n = letters(x)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(F.lower(c(x)), "[^a-z]", "")) / n)


def latin_runs(x: str | Column) -> Column:
    """Number of runs of Latin words."""
    return F.size(F.regexp_extract_all(c(x), F.lit("[A-Za-z]{2,}(?:[ '-][A-Za-z]{2,})*"), F.lit(0)))


def cell_count(x: str | Column) -> Column:
    """Number of braille cells; other characters don't count."""
    return F.length(F.regexp_replace(c(x), f"[^{CELL}]", ""))


def is_cells(x: str | Column, line_breaks: bool = True) -> Column:
    return c(x).rlike(f"^[{CELL}{chr(92) + 'n' if line_breaks else ''}]*$")


def with_blank_cells(x: str | Column) -> Column:
    """ASCII blanks as empty cells; null if anything else is no cell."""
    out = F.translate(c(x), " ", "⠀")
    return F.when(out.rlike(f"^[{CELL}]*$"), out)


def ascii_cells(x: str | Column) -> Column:
    """Braille ASCII to cells, letters in either case."""
    return F.translate(F.upper(c(x)), ASCII64, CELLS64)


def cells_ascii(x: str | Column) -> Column:
    return F.translate(c(x), CELLS64, ASCII64)


def len_bucket(cells: str | Column, sentences: str | Column) -> Column:
    """Bucket of a text by cells, longer ones by their number of sentences."""
    out = F.when(c(sentences) >= 4, "paragraph").otherwise("sentence")
    for most, name in reversed(BUCKETS):
        out = F.when(c(cells) <= most, name).otherwise(out)
    return out


def sentence_count(x: str | Column) -> Column:
    """One more than the sentence marks that are followed by a blank and more text."""
    return F.lit(1) + F.regexp_count(F.trim(c(x)), F.lit("[.!?…][ ]+[^ ]"))


def half_even_scaled(n: str | Column, s: float) -> Column:
    """n times s rounded half to even, at least 1; 0 stays 0."""
    return F.when(c(n) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(c(n) * F.lit(s)).cast("int")))


def hex_sum_mod5(x: str | Column) -> Column:
    """A SHA-256 number modulo 5: 16 is 1 modulo 5, so the digits' sum will do."""
    digits = F.split(F.sha2(c(x), 256), "")
    return F.pmod(F.aggregate(digits, F.lit(0), lambda a, d: a + F.coalesce(F.conv(d, 16, 10).cast("int"), F.lit(0))), F.lit(5))


def ascii_only(x: str | Column) -> Column:
    return F.regexp_replace(c(x), "[^ -~]", "")


def error_rate(ref: str | Column, hyp: str | Column) -> Column:
    """Edit distance over the reference's length, at least 1 character."""
    return F.levenshtein(c(ref), c(hyp)) / F.greatest(F.length(c(ref)), F.lit(1))
