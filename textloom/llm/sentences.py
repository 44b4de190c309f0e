"""Problem 4: sentence units in every language and script.

The rules are those of the standard sentence breaks, over the characters'
Sentence_Break property: terminators (STerm, ATerm) and what follows them
(Close, Sp, SContinue, Lower, Numeric, Upper, OLetter) decide, so every script
with terminators of its own is covered.  Every line break ends a unit.  On top
of the property stand, by language and script:

- abbreviations, initials, ordinals of dates and a line's leading number, after
  which a period ends nothing; numbers, code names and addresses are never split;
- quotations: terminators inside one end nothing; one right before the closing
  mark ends the unit if the quotation stood at the unit's end and nothing
  continues it;
- an STerm of a script other than Latin needs no space after it; a period needs
  none after Han and kana, and after Devanagari, Bengali, Gurmukhi, Odia and Thai
  letters it ends nothing (those scripts have a danda, or none);
- the ellipsis is a terminator, and so are the Tibetan shads and a doubled
  Ethiopic word space, which have no such property;
- Thai and Lao have no terminator: a space between two of their letters ends a
  unit, as does one after a closing bracket or after reported speech.

A mixed document takes the abbreviations of each segment's own language.  The
time grows in proportion to the text, lines of any length included.

Null and empty texts have no units.  Units start at their first visible character.
"""

from __future__ import annotations

import bisect
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from textloom.session import table

# Abbreviations that may stand before a capital letter, by language.
ABBREVIATIONS = {
    "en": "st mr mrs ms dr prof rev gen col sgt capt lt jr sr no nos vol vols fig figs pp p ch chs cf vs ver approx ave rd blvd mt ft dept ed eds e.g i.e p.o u.s u.k n.b q.v viz inc ltd co ref tel ext",
    "de": "z d u s o i vgl abb bzw ca nr bestellnr tel z.b d.h u.a z.t o.ä s.o s.u dr prof hr fr hrn st str kap bd abs art aufl hrsg verf geb gest ggf evtl inkl zzgl bspw sog max min ing dipl jh",
    "fr": "art no n chap cf p pp env ex p.ex c.-à-d mm mme mlle dr pr st ste av bd fig vol éd trad tél réf éq boul coll resp",
    "es": "art núm pág págs fig aprox tel tlf ej p.ej sr sra srta sres d dña dr dra ud uds avda av cap vol ed depto prov izq dcha núms c.p ee uu",
    "ru": "см рис с стр ок т.е е напр тел г ул пр просп пл пер бул д кв корп стр им проф акад др тов гр руб коп гл п т табл изд ред обл р рр гг в вв",
}
# Words before which a capital follows an ordinal, and German months.
_BEFORE_ORDINAL = set("am vom zum den der dem im beim ab bis seit des die das".split())
_MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

_THAI = "ก-๎ກ-ໟ"
_SPACE = r"\s" + "".join(map(chr, (0x200B, 0x2060, 0xFEFF)))  # with the zero-width ones
# Kinds of letters that the property calls OLetter, by script; other scripts are plain letters.
_SCRIPTS = (
    ("hangul", regex.compile(r"\p{Hangul}")),
    ("han", regex.compile(r"\p{Han}")),
    ("kana", regex.compile(r"[\p{Hiragana}\p{Katakana}ーｰ]")),
    ("arabic", regex.compile(r"\p{Arabic}")),
    ("danda", regex.compile(r"[\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Oriya}]")),
    ("thai", regex.compile(r"[\p{Thai}\p{Lao}]")),
)
_CLASSES = tuple((name, regex.compile(rf"[{sets}]")) for name, sets in (
    ("upper", r"\p{SB=Upper}"), ("lower", r"\p{SB=Lower}"), ("digit", r"\p{SB=Numeric}"), ("mark", r"\p{SB=Extend}\p{SB=Format}"), ("letter", r"\p{SB=OLetter}"),
))
_SHADS = "།-༒༔"
_CANDIDATE = regex.compile(rf"(?:[\p{{SB=STerm}}\p{{SB=ATerm}}…{_SHADS}]|፡፡)+")
_FULL = regex.compile(rf"[\p{{SB=STerm}}．﹒{_SHADS}፡--!?]", regex.V1)
_WIDE = frozenset("．﹒")
_AFTER = regex.compile(r"[\p{SB=SContinue}\p{SB=STerm}\p{SB=ATerm}\p{Pe}\p{Pf};；؛]")
_OPENING = regex.compile(r"[\p{Ps}\p{Pi}\"¿¡]")
_THAI_GAP = re.compile(f"(?<=[{_THAI})”’»\\]])[{_SPACE}]+(?=[{_THAI}“«])")
_PAIRS = "«[^«»]*»|„[^„“”]*[“”]|“[^“”]*”|「[^「」]*」|『[^『』]*』|‘[^‘’]*’|\"[^\"]*\""
_QUOTED = re.compile(_PAIRS)
_QUOTED_INWARD = re.compile(f"»[^«»]*«|{_PAIRS}")  # German may turn guillemets inward
_QUOTE_MARKS = re.compile("[«»„“「『‘\"]")
_BREAKS = "\n\r\x0b\x0c\x1c-\x1e\x85" + chr(0x2028) + chr(0x2029)
_LINE = re.compile(f"[^{_BREAKS}]+")
_VISIBLE = re.compile(f"[^{_SPACE}]")
_CLOSERS = re.compile(r"[)\]）】〕]*")
_WORD = re.compile(r"\w+")
_WORDLIKE = re.compile(r"[^\W_]")
_LEAD = re.compile(r"(?:[^\W\d_]+[ \xa0])?\d{1,4}[.)](?=[ \xa0])")
_TWO_LETTERS = re.compile(r"[^\W\d_]{2}$")
_QUANTITY = re.compile(r"จำนวน\s*\d")  # "to the number of": belongs to what stands before

_KINDS: dict[str, str] = {}
_UNCASED = {"hangul", "han", "kana", "arabic", "danda", "thai", "letter"}
_TABLES: dict[str, frozenset] = {k: frozenset(v.split()) for k, v in ABBREVIATIONS.items()}
_ALL = frozenset().union(*_TABLES.values())


def _kind(c: str) -> str:
    """Sentence-break class of a character: ``upper``, ``lower``, ``digit``, ``mark``, a kind of uncased letter, or ``other``."""
    known = _KINDS.get(c)
    if known is None:
        known = next((n for n, p in _CLASSES if p.match(c)), "other")
        if known == "letter":
            known = next((n for n, p in _SCRIPTS if p.match(c)), known)
        _KINDS[c] = known
    return known


def _before(line: str, at: int) -> str:
    """Class of the last base character before ``at``."""
    while at > 0:
        k = _kind(line[at - 1])
        if k != "mark":
            return k
        at -= 1
    return "other"


def _word_before(line: str, end: int) -> str:
    """The word that ends at ``end``; periods, hyphens and apostrophes inside it belong to it."""
    first = at = end
    marked = False
    while at > 0:
        c = line[at - 1]
        if c.isalnum():
            first = at - 1
        elif _kind(c) == "mark":
            marked = True
        elif c not in ".-'’" or at == end:
            break
        at -= 1
    return unicodedata.normalize("NFC", line[first:end]) if marked else line[first:end]


def _preceding_word(line: str, end: int) -> str:
    """The word before ``end`` and the gap before it, in lower case; '' if it is longer than any in question."""
    at = end
    while at > 0 and not (line[at - 1].isalnum() or line[at - 1] == "_"):
        at -= 1
    first = at
    while first > 0 and at - first <= _LONGEST and (line[first - 1].isalnum() or line[first - 1] == "_"):
        first -= 1
    return line[first:at].lower() if first < at < end else ""


_LONGEST = max(map(len, _BEFORE_ORDINAL))


class _Line:
    """One line, with what is kept between its terminators so that none is looked at from the start."""

    def __init__(self, line: str, abbreviations: frozenset) -> None:
        self.line, self.abbreviations = line, abbreviations
        self.token_from = self.token_seen = 0
        self.address = False
        self.word_at, self.lead = -1, 0

    def in_address(self, start: int) -> bool:
        """Whether the stretch without blanks that ``start`` is in looks like an address up to there."""
        line = self.line
        blank = line.rfind(" ", self.token_seen, start)
        if blank >= 0:
            self.token_from, self.address = blank + 1, False
            self.token_seen = blank + 1
        if not self.address:
            # From a little before what was seen, as a mark may lie across.
            part = line[max(self.token_from, self.token_seen - 2) : start]
            self.address = "@" in part or "＠" in part or "://" in part or line.startswith("www", self.token_from, start)
        self.token_seen = start
        return self.address

    def begin(self, n: int) -> None:
        """A unit begins at ``n``: periods up to the end of its leading number end nothing."""
        if self.word_at < n:
            word = _WORDLIKE.search(self.line, n)
            self.word_at = word.start() if word else len(self.line)
            led = _LEAD.match(self.line, self.word_at)
            if led:
                self.lead = led.end()

    def period_ends(self, start: int, end: int, nxt: int) -> bool:
        """Whether the single period at ``start`` ends a unit, given the next visible character at ``nxt``."""
        line = self.line
        p, c, follows = _before(line, start), _kind(line[nxt]), line[nxt]
        if nxt == end:  # nothing between the period and what follows
            if c not in ("upper", "hangul", "arabic") and follows not in "“„«¿¡":
                return False
            if self.in_address(start):
                return False
            if c in ("hangul", "arabic"):
                return p == c or p == "other"
            if c == "upper":
                after = _kind(line[nxt + 1]) if nxt + 1 < len(line) else "other"
                shouted = p == "upper" and _TWO_LETTERS.search(line[max(0, start - 2) : start])
                if (p not in ("lower", "digit", "other") and not shouted) or not (after in ("lower", "mark") or line[nxt + 1 : nxt + 2] in (" ", "'", "’")):
                    return False
            elif p not in ("lower", "digit", "other", "hangul", "arabic"):
                return False
        if start < self.lead:
            return False
        if p == "hangul":
            return True
        if p in ("danda", "thai"):
            return False
        word = _word_before(line, start)
        if p in ("arabic", "letter"):
            return len(word) > 1
        if p in ("han", "kana"):
            return True
        if c in ("digit", "lower") or follows in "+$(":
            return False
        if not (c in ("upper", "other") or c in _UNCASED):
            return False
        if follows == "-":
            return line[nxt + 1 : nxt + 2] == " "
        if _AFTER.match(follows) or follows in "/%&*=":
            return False
        if c == "other" and not _OPENING.match(follows) and p not in ("lower", "upper"):
            return False
        if p == "digit":
            if c in _UNCASED and c != "arabic":
                return False
            if word.isdigit() and len(word) <= 2 and c == "upper":
                following = _WORD.match(line, nxt)
                if following and following.group().lower() in _MONTHS:
                    return False
                if line[start - len(word) - 1 : start - len(word)] == " " and _preceding_word(line, start - len(word)) in _BEFORE_ORDINAL:
                    return False
            return True
        if p in ("lower", "upper"):
            low = word.lower()
            if len(low) == 1:
                if low in "дп" and re.search(r"т\.\s?$", line[max(0, start - 4) : start - 1]):
                    return True
                return not (word.isupper() or low in self.abbreviations)
            if low in ("a.m", "p.m"):
                return True
            if len(low) > 2 and low[-2] == "." and word[-1].isupper():
                return False
            return low not in self.abbreviations and not low.endswith("nr")
        return True


def _cuts(line: str, abbreviations: frozenset, quoted: re.Pattern) -> list[int]:
    """Offsets in the line at which units begin."""
    first = _VISIBLE.search(line)
    if not first:
        return []
    unit = first.start()
    known = _Line(line, abbreviations)
    known.begin(unit)
    quotes = [q.span() for q in quoted.finditer(line)] if _QUOTE_MARKS.search(line) else []
    cuts = [unit]
    at_quote = 0
    for t in _CANDIDATE.finditer(line):
        start, end = t.span()
        run = t.group()
        while at_quote < len(quotes) and quotes[at_quote][1] <= start:
            at_quote += 1
        if at_quote < len(quotes) and quotes[at_quote][0] < start:
            a, b = quotes[at_quote]
            if _VISIBLE.search(line, end, b - 1):
                continue  # inside the quotation
            nxt = _VISIBLE.search(line, b)
            if not nxt:
                break
            n = nxt.start()
            c = _kind(line[n])
            opened_first = not _VISIBLE.search(line, cuts[-1], a)
            if c in ("lower", "digit", "mark") or _AFTER.match(line[n]):
                continue
            if c in ("han", "kana", "hangul") and n == b:
                if c != "han" or opened_first or line[a] in "「『":
                    continue
            elif c == "upper":
                if n == b:
                    continue
            elif c in _UNCASED and opened_first:
                continue
            cuts.append(n)
            continue
        end = _CLOSERS.match(line, end).end()
        nxt = _VISIBLE.search(line, end)
        if not nxt:
            break
        n = nxt.start()
        if start < unit + 1:
            continue
        if _FULL.search(run):
            if not (run[0] in _WIDE and n == end and _kind(line[n]) == "digit") and not _AFTER.match(line[n]):
                cuts.append(n)
        elif len(run) == 1 and run != "…" and run not in "!?":
            if known.period_ends(start, end, n):
                cuts.append(n)
                known.begin(n)
        else:
            p, c = _before(line, start), _kind(line[n])
            if (_AFTER.match(line[n]) and line[n : n + 2] != "- ") or line[n] in "/&=":
                continue
            if p in _UNCASED or c in _UNCASED:
                if n > end or c in _UNCASED - {"thai", "letter"} or p in ("han", "kana"):
                    cuts.append(n)
            elif c == "lower":
                continue
            elif n > end:
                cuts.append(n)
            elif c == "upper" and p in ("lower", "digit", "other", "mark") and n + 1 < len(line) and _kind(line[n + 1]) in ("lower", "mark"):
                cuts.append(n)
            elif line[n] in "“„«¿¡" and p in ("lower", "other"):
                cuts.append(n)
    return _with_thai_gaps(line, cuts, quotes) if "฀" <= max(line) else cuts


def _with_thai_gaps(line: str, cuts: list[int], quotes: list[tuple[int, int]]) -> list[int]:
    """The cuts and those at spaces between Thai or Lao letters outside quotations and brackets."""
    opened = [q[0] for q in quotes]
    depth = seen = 0
    more = []
    for g in _THAI_GAP.finditer(line):
        a, n = g.span()
        depth += line.count("(", seen, a) - line.count(")", seen, a)
        seen = a
        at = bisect.bisect_left(opened, a) - 1
        if at >= 0 and a < quotes[at][1]:
            continue  # inside a quotation
        if line[a - 1] in "”’»":
            said = line[max(0, opened[at] - 20) : opened[at]].rstrip() if at >= 0 and quotes[at][1] == a else ""
            if not said.endswith(("ว่า", ":")):
                continue
        if line[n] in "“«" or depth > 0 or _QUANTITY.match(line, n):
            continue
        more.append(n)
    return sorted({*cuts, *more}) if more else cuts


def _rules(lang: str | None) -> tuple[frozenset, re.Pattern]:
    code = (lang or "").lower()[:2]
    return _TABLES.get(code, _ALL), _QUOTED_INWARD if code == "de" else _QUOTED


def unit_starts(text: str, lang: str | None = None, segments: list[tuple[str | None, int]] | None = None) -> list[int]:
    """Offsets of the first character of each sentence unit.

    segments: language and length of the parts that, joined by a line break, are
    the text; if they don't add up to it, or none are given, ``lang`` holds for all.
    """
    if not segments or sum(n for _, n in segments) + len(segments) - 1 != len(text):
        segments = [(lang, len(text))]
    out: list[int] = []
    at = 0
    for code, length in segments:
        abbreviations, quoted = _rules(code)
        for m in _LINE.finditer(text, at, at + length):
            base = m.start()
            out.extend(base + n for n in _cuts(m.group(), abbreviations, quoted))
        at += length + 1
    return out


_UNITS = "doc_id long, unit int, start_pos int, end_pos int, unit_text string"


def sentence_units(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", segments: str | None = "segments") -> DataFrame:
    """One row per unit: number, offsets (end exclusive, trailing space left out) and text.

    The language of a document chooses the abbreviations, in a mixed document that
    of each segment; where none is known, or it has no list, those of all count.
    ``segments`` is an array of structs with ``lang`` and ``text``; any other type
    is left aside.
    """
    kind = docs.schema[segments].dataType if segments and segments in docs.columns else None
    parts = F.lit(None).cast("array<struct<lang:string,n:int>>")
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and {"lang", "text"} <= set(kind.elementType.names):
        parts = F.transform(segments, lambda s: F.struct(s["lang"].cast("string").alias("lang"), F.coalesce(F.length(s["text"]), F.lit(0)).alias("n")))
    one = F.when(parts.isNull(), F.col(lang).cast("string"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), one.alias("lang"), parts.alias("parts")).where("text is not null")

    def split(batches):
        for batch in batches:
            ids, texts, langs, parted = (batch.column(i).to_pylist() for i in range(4))
            for at in range(0, len(ids), 500):
                cols: tuple[list, ...] = ([], [], [], [], [])
                for d, t, known, segs in zip(ids[at : at + 500], texts[at : at + 500], langs[at : at + 500], parted[at : at + 500]):
                    starts = unit_starts(t, known, [(x["lang"], x["n"]) for x in segs if x] if segs else None)
                    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(t)])):
                        body = t[a:b].rstrip()
                        for c, v in zip(cols, (d, i, a, a + len(body), body)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "unit", "start_pos", "end_pos", "unit_text"])

    return rows.mapInArrow(split, _UNITS)


def p4_found(spark, sf_dir) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents")).select("doc_id", "start_pos")


def p4_units(spark, sf_dir) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"))
