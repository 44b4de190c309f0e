"""Edit scripts, word errors, cell errors, n-gram counts and text codecs that have no native form.

Edit scripts have a fixed preference: match or replace, then delete, then insert.
"""

from __future__ import annotations

import html
import re
import string
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as t

WHOLE = 4_000_000  # cells of a distance table that is kept to trace the script back
ZERO_WIDTH = chr(0x200B)


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _rows(a: np.ndarray, b: np.ndarray):
    """Rows of the table of distances of the beginnings of ``a`` and ``b``, one at a time."""
    steps = np.arange(len(b) + 1, dtype=np.int32)
    row = steps.copy()
    yield row
    for i, c in enumerate(a):
        new = np.minimum(row + 1, np.concatenate(([i + 1], row[:-1] + (b != c))).astype(np.int32))
        row = np.minimum.accumulate(new - steps) + steps  # an insertion may follow any cell to the left
        yield row


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    for row in _rows(a, b):
        pass
    return row


def _shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Lengths of the common beginning and of the common rest's end."""
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    lead = int(differs[0]) if len(differs) else n
    n -= lead
    differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    return lead, int(differs[0]) if len(differs) else n


def _script(a: np.ndarray, b: np.ndarray, at_a: int, at_b: int, out: list) -> None:
    lead, tail = _shared_ends(a, b)
    a, b, at_a, at_b = a[lead : len(a) - tail], b[lead : len(b) - tail], at_a + lead, at_b + lead
    if not len(a) or not len(b):
        out += [("delete", at_a + i, at_b) for i in range(len(a))] + [("insert", at_a, at_b + j) for j in range(len(b))]
        return
    if (len(a) + 1) * (len(b) + 1) > WHOLE and len(a) > 1:
        # Too large to trace back: halve, where the halves' distances sum to the least.
        half = len(a) // 2
        cut = int(np.argmin(_last_row(a[:half], b) + _last_row(a[half:][::-1], b[::-1])[::-1]))
        _script(a[:half], b[:cut], at_a, at_b, out)
        _script(a[half:], b[cut:], at_a + half, at_b + cut, out)
        return
    rows, found = list(_rows(a, b)), []
    i, j = len(a), len(b)
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                found.append(("replace", at_a + i, at_b + j))
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
            found.append(("delete", at_a + i, at_b + j))
        else:
            j -= 1
            found.append(("insert", at_a + i, at_b + j))
    out += found[::-1]


def edit_script(ref: str, hyp: str) -> list[tuple[str, int, int]]:
    """(op, position in ref, position in hyp) of a shortest script; op is replace, delete or insert.

    The memory grows with the texts, not with their product.
    """
    out: list[tuple[str, int, int]] = []
    _script(_codes(ref), _codes(hyp), 0, 0, out)
    return out


def word_distance(ref: str, hyp: str) -> int:
    """Edit distance over blank-separated words."""
    known: dict[str, int] = {}
    a, b = (np.array([known.setdefault(w, len(known)) for w in s.split()], np.uint32) for s in (ref, hyp))
    lead, tail = _shared_ends(a, b)
    return int(_last_row(a[lead : len(a) - tail], b[lead : len(b) - tail])[-1])


QUOTES = frozenset("\"'`´‘’‚‛“”„‟«»‹›「」『』＂＇")


def edit_category(ref: str, hyp: str, op: tuple[str, int, int]) -> str:
    """Kind of one edit: case, whitespace, quotes, punctuation, digits or characters."""
    kind, i, j = op
    a = ref[i] if kind != "insert" else ""
    b = hyp[j] if kind != "delete" else ""
    if a and b and a.lower() == b.lower():
        return "case"
    both = a + b
    if both.isspace():
        return "whitespace"
    if all(c in QUOTES for c in both):
        return "quotes"
    if all(not c.isalnum() for c in both):
        return "punctuation"
    if all(c.isdigit() for c in both):
        return "digits"
    return "characters"


def cells_of_characters(text: str, braille: str) -> list[list[int]]:
    """Cells each character answers for, each cell in proportion under one of them: word by word where the words agree in number."""
    words, cells = text.split(" "), re.split("[ ⠀]", braille)
    if len(words) != len(cells):
        words, cells = [text], [braille]
    out: list[list[int]] = []
    base = 0
    for w, b in zip(words, cells):
        mine: list[list[int]] = [[] for _ in w]
        if w:
            for k in range(len(b)):
                mine[k * len(w) // len(b)].append(base + k)
        out += [*mine, []]  # the blank after a word has no cell of its own
        base += len(b) + 1
    return out[:-1]


def composed_with_map(text: str) -> tuple[str, list[int]]:
    """The text in NFC without zero-width spaces, and where each of its characters stood in ``text``."""
    out: list[str] = []
    where: list[int] = []
    start = 0
    for end in range(1, len(text) + 1):
        if end < len(text) and (unicodedata.combining(text[end]) or "ᅠ" <= text[end] <= "ᇿ" or unicodedata.category(text[end]) == "Mc"):
            continue
        for k, c in enumerate(unicodedata.normalize("NFC", text[start:end])):
            if c != ZERO_WIDTH:
                out.append(c)
                where.append(start + min(k, end - start - 1))
        start = end
    return "".join(out), where


def scoring_form(text: str, label: str = "", fold: dict[int, int] | None = None) -> str:
    """NFC without zero-width spaces; lines of a Chinese label are folded, character by character, by the given map."""
    plain = unicodedata.normalize("NFC", text).replace(ZERO_WIDTH, "")
    return plain.translate(fold) if fold and label.startswith("zh") else plain


def segment_cell_errors(segments: list[tuple[str, str, str]], hyp: list[tuple[str, str]], fold: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """(cells touched by edits, cells) of each (label, text, cells) segment against (label, text) lines of output.

    Texts are compared in their scoring form, as lines joined by a break.  An edit
    touches the cells of its place in the reference (an insertion those of the
    character it stands before, at the end the last); a character without cells
    passes the edit on to the last cell before it, else to the first.
    """
    cells: list[list[int]] = []
    owner: list[int] = []
    form: list[str] = []
    where: list[int] = []
    for n, (label, text, braille) in enumerate(segments):
        if n:
            form.append("\n")
            where.append(len(cells))
            cells.append([])
        plain, places = composed_with_map(text)
        form.append(plain.translate(fold) if fold and label.startswith("zh") else plain)
        where += [len(cells) + i for i in places]
        cells += [[len(owner) + c for c in mine] for mine in cells_of_characters(text, braille)]
        owner += [n] * len(braille)
    total = [owner.count(n) for n in range(len(segments))]
    bad: set[int] = set()
    if cells and owner:
        last = [0] * len(cells)  # the last cell at or before each character
        for i, mine in enumerate(cells):
            last[i] = mine[-1] if mine else last[i - 1] if i else 0
        for _, i, _ in edit_script("".join(form), "\n".join(scoring_form(x, label, fold) for label, x in hyp)):
            at = where[i] if i < len(where) else len(cells) - 1
            bad.update(cells[at] or [last[at]])
    return [(sum(owner[c] == n for c in bad), total[n]) for n in range(len(segments))]


def cell_errors(text: str, braille: str, hyp: str) -> tuple[int, int]:
    """(cells touched by the edits of hyp against text, all cells) of a one-segment text."""
    return segment_cell_errors([("", text, braille.replace(" ", "⠀"))], [("", hyp)])[0]


def _grams(s, n: int) -> dict:
    out: dict = {}
    for i in range(len(s) - n + 1):
        out[s[i : i + n]] = out.get(s[i : i + n], 0) + 1
    return out


def _matches(x: dict, y: dict) -> int:
    return sum(min(v, y.get(k, 0)) for k, v in x.items())


def tokens_13a(text: str) -> list[str]:
    """Words of the evaluation-campaign tokenizer: symbols apart, periods and commas apart unless between digits, dashes after digits."""
    text = html.unescape(text.replace("<skipped>", "").replace("-\n", "").replace("\n", " "))
    text = re.sub(r"([{-~\[-` -&(-+:-@/])", r" \1 ", f" {text} ")
    text = re.sub(r"([^0-9])([.,])", r"\1 \2 ", text)
    text = re.sub(r"([.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


_IDEOGRAPHS = re.compile("([\u2600-\u27bf\u2e80-\u2fdf\u2ff0-\u303f\u3040-\u30ff\u3100-\u312f\u31a0-\u31bf\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\ufe10-\ufe1f\ufe30-\ufe4f\uff00-\uffef\U00020000-\U0002fa1f])")


def tokens(text: str, how: str) -> list[str]:
    """Words by blanks (none), by ``tokens_13a``, or for zh with each ideograph apart as well."""
    if how == "13a":
        return tokens_13a(text)
    if how == "zh":
        return tokens_13a(_IDEOGRAPHS.sub(r" \1 ", text))
    return text.split()


def pair_bleu_counts(ref: str, hyp: str, how: str = "none") -> list[int]:
    """Clipped matches of orders 1 to 4, the output's n-grams of these orders, its words and the reference's."""
    r, h = tuple(tokens(ref, how)), tuple(tokens(hyp, how))
    return [_matches(_grams(h, n), _grams(r, n)) for n in range(1, 5)] + [max(0, len(h) - n + 1) for n in range(1, 5)] + [len(h), len(r)]


_PUNCTUATION = frozenset(string.punctuation)


def pair_chrf_counts(ref: str, hyp: str, word_order: int = 2) -> list[int]:
    """For each order (characters 1 to 6, then words): n-grams of the output, of the reference, and matches."""

    def words(s: str) -> tuple[str, ...]:
        out: list[str] = []
        for w in s.split():
            if len(w) > 1 and w[-1] in _PUNCTUATION:
                out += [w[:-1], w[-1]]
            elif len(w) > 1 and w[0] in _PUNCTUATION:
                out += [w[0], w[1:]]
            else:
                out.append(w)
        return tuple(out)

    out: list[int] = []
    for r, h, most in (("".join(ref.split()), "".join(hyp.split()), 6), (words(ref), words(hyp), word_order)):
        for n in range(1, most + 1):
            x, y = _grams(h, n), _grams(r, n)
            out += [sum(x.values()), sum(y.values()), _matches(x, y)]
    return out


def chrf(ref: str, hyp: str, order: int = 6, beta: float = 2.0) -> float:
    """Character n-gram F-score of one pair without blanks, averaged over the orders that occur."""
    counts = pair_chrf_counts(ref, hyp, 0)
    there = [(hit / h, hit / r) for h, r, hit in zip(counts[0 : 3 * order : 3], counts[1 : 3 * order : 3], counts[2 : 3 * order : 3]) if h and r]
    if not there:
        return 0.0
    p, r = sum(x for x, _ in there) / len(there), sum(x for _, x in there) / len(there)
    return 0.0 if p + r == 0 else (1 + beta**2) * p * r / (beta**2 * p + r)


# Commands that are spelled as others.
LATEX_ALIASES = {"\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\le": "\\leq", "\\ge": "\\geq", "\\ne": "\\neq", "\\to": "\\rightarrow"}
_LATEX = re.compile(r"\\[A-Za-z]+|\s+|.", re.S)


def _grouped(tokens: list[str]) -> list:
    """Tokens with each braced group as a list; braces without a partner stay tokens."""
    stack: list[list] = [[]]
    for token in tokens:
        if token == "{":
            stack.append([])
        elif token == "}" and len(stack) > 1:
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(token)
    while len(stack) > 1:
        done = stack.pop()
        stack[-1] += ["{", *done]
    return stack[0]


def _flat(items: list) -> list[str]:
    return [t for x in items for t in (["{", *_flat(x), "}"] if isinstance(x, list) else [x])]


def _trimmed(items: list) -> list:
    blank = [isinstance(x, str) and x.isspace() for x in items]
    return items[blank.index(False) : len(blank) - blank[::-1].index(False)] if False in blank else []


def _as_fraction(group: list) -> list:
    """What stands for a braced group: itself, or the fraction that its first ``\\over`` makes of it."""
    out: list = []
    for n, x in enumerate(group):
        if x == "\\over":
            return ["\\frac", _trimmed(out), *_as_fraction(_trimmed(group[n + 1 :]))]
        out += _as_fraction(x) if isinstance(x, list) else [x]
    return [out]


def canonical_latex(s: str) -> str:
    """One spelling of equal formulas: no comments, ``\\over`` in braces as ``\\frac``, one name of each relation, single scripts and roots braced, blanks only where a command would swallow a letter; idempotent."""
    items, plain = _grouped(_LATEX.findall(re.sub(r"(?<!\\)%.*", "", s))), []
    for n, x in enumerate(items):
        if x == "\\over":  # held by no braces: it and all that follows stay
            plain += items[n:]
            break
        plain += _as_fraction(x) if isinstance(x, list) else [x]
    tokens = [LATEX_ALIASES.get(x, x) for x in _flat(plain)]
    out: list[str] = []
    n, end = 0, len(tokens)
    alnum = lambda i: i < end and tokens[i].isascii() and tokens[i].isalnum()
    after = lambda i: i + 1 if i < end and tokens[i].isspace() else i
    while n < end:
        x, i = tokens[n], after(n + 1)
        if x in ("_", "^", "\\sqrt") and i < end:
            arg = tokens[i]
            command = x != "\\sqrt" and len(arg) > 1 and arg[0] == "\\"
            j = after(i + 1)
            if (command and not alnum(j) and tokens[j : j + 1] != ["{"]) or (alnum(i) and (x == "\\sqrt" or tokens[i + 1 : i + 2] != ["{"])):
                out += [x, "{", arg, "}"]
                n = i + 1
                continue
        if x.isspace():
            swallowed = out and len(out[-1]) > 1 and out[-1][0] == "\\" and n + 1 < end and tokens[n + 1][0].isascii() and tokens[n + 1][0].isalpha()
            out += [" "] if swallowed else []
        else:
            out.append(x)
        n += 1
    return "".join(out)


def wrapped_with_places(cells: str, places: list[int], width: int) -> list[tuple[str, list[int]]]:
    """Lines of at most ``width`` cells, broken at blanks (longer words are cut), with the source place of each cell."""
    out: list[tuple[str, list[int]]] = []
    line: list[int] = []

    def close() -> None:
        nonlocal line
        if line:
            out.append(("".join("⠀" if cells[i] == " " else cells[i] for i in line), [places[i] for i in line]))
        line = []

    for m in re.finditer("[^ ⠀]+", cells):
        word = list(range(*m.span()))
        if line and len(line) + 1 + len(word) <= width:
            line += [word[0] - 1, *word]
            continue
        close()
        while len(word) > width:
            line, word = word[:width], word[width:]
            close()
        line = word
    close()
    return out


def wrapped(cells: str, width: int) -> list[str]:
    """The lines of ``wrapped_with_places``."""
    return [line for line, _ in wrapped_with_places(cells, list(range(len(cells))), width)]


def byte_ids(s: str) -> list[int]:
    """UTF-8 bytes shifted by 3, then the end mark 1."""
    return [b + 3 for b in s.encode()] + [1]


def from_byte_ids(ids: list[int]) -> str:
    """The text of such ids; others and broken bytes are skipped."""
    return bytes(i - 3 for i in ids if 3 <= i < 259).decode(errors="ignore")


# ---- Arrow-batched column functions


@F.pandas_udf(t.ArrayType(t.StructType([t.StructField("op", t.StringType()), t.StructField("ref_pos", t.IntegerType()), t.StructField("hyp_pos", t.IntegerType()), t.StructField("category", t.StringType())])))
def edits(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else [(o[0], o[1], o[2], edit_category(a, b, o)) for o in edit_script(a, b)] for a, b in zip(ref, hyp)])


@F.pandas_udf(t.IntegerType())
def word_edits(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else word_distance(a, b) for a, b in zip(ref, hyp)], dtype="Int32")


_ERR = t.StructType([t.StructField("err", t.IntegerType()), t.StructField("cells", t.IntegerType())])


@F.pandas_udf(_ERR)
def cell_edits(text: pd.Series, braille: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if None in r else cell_errors(*r) for r in zip(text, braille, hyp)]
    return pd.DataFrame({"err": pd.array([r[0] for r in rows], "Int32"), "cells": pd.array([r[1] for r in rows], "Int32")})


@F.pandas_udf(t.ArrayType(_ERR))
def segment_cell_edits(segments: pd.Series, hyp: pd.Series) -> pd.Series:
    """Per segment of array<struct<table_id, text, braille>>: cell errors of the lines of array<struct<table_id, text>>."""

    def one(s, h):
        if s is None or h is None or any(x["text"] is None or x["braille"] is None for x in s):
            return None
        lines = [(x["table_id"] or "", x["text"] or "") for x in h]
        return segment_cell_errors([(x["table_id"] or "", x["text"], x["braille"].replace(" ", "⠀")) for x in s], lines)

    return pd.Series([one(s, h) for s, h in zip(segments, hyp)])


@F.pandas_udf(t.ArrayType(t.LongType()))
def bleu_counts(ref: pd.Series, hyp: pd.Series, how: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else pair_bleu_counts(a, b, w) for a, b, w in zip(ref, hyp, how)])


@F.pandas_udf(t.ArrayType(t.LongType()))
def chrf_counts(ref: pd.Series, hyp: pd.Series, order: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else pair_chrf_counts(a, b, int(o)) for a, b, o in zip(ref, hyp, order)])


@F.pandas_udf(t.DoubleType())
def chrf_score(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else chrf(a, b) for a, b in zip(ref, hyp)], dtype="float64")


@F.pandas_udf(t.StringType())
def latex_form(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else canonical_latex(x))


@F.pandas_udf(t.ArrayType(t.StringType()))
def wrapped_lines(s: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else wrapped(x, int(w)) for x, w in zip(s, width)])


@F.pandas_udf(t.ArrayType(t.StructType([t.StructField("line", t.StringType()), t.StructField("places", t.ArrayType(t.IntegerType()))])))
def wrapped_places(s: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else wrapped_with_places(x, list(range(len(x))), int(w)) for x, w in zip(s, width)])


@F.pandas_udf(t.StringType())
def nfc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(t.StringType())
def bare_form(s: pd.Series) -> pd.Series:
    from textloom.functions.forms import bare

    return s.map(lambda x: None if x is None else bare(x))


@F.pandas_udf(t.ArrayType(t.IntegerType()))
def byte_codec(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else byte_ids(x))
