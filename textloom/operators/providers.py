"""Transcription providers: rules as data, places, options, back-translation, routing, isolation.

A provider turns (table, text) into cells and says for each cell which character
it came from.  Rules are read from lines of a small table language, so a table is
data; engines outside Python plug in by the same protocol, and are run in a child
process that a time limit can end.
"""

from __future__ import annotations

import multiprocessing as mp
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as t

# Letters, digits and marks of the six-dot alphabet by their dots, and five whole-letter groups.
BASIC_RULES = """
letter a 1
letter b 12
letter c 14
letter d 145
letter e 15
letter f 124
letter g 1245
letter h 125
letter i 24
letter j 245
letter k 13
letter l 123
letter m 134
letter n 1345
letter o 135
letter p 1234
letter q 12345
letter r 1235
letter s 234
letter t 2345
letter u 136
letter v 1236
letter w 2456
letter x 1346
letter y 13456
letter z 1356
digit 1 1
digit 2 12
digit 3 14
digit 4 145
digit 5 15
digit 6 124
digit 7 1245
digit 8 125
digit 9 24
digit 0 245
numsign 3456
lettersign 56
space \\s 0
punctuation , 2
punctuation ; 23
punctuation : 25
punctuation . 256
punctuation ! 235
punctuation ? 236
punctuation - 36
punctuation ' 3
always and 12346
always for 123456
always of 12356
always the 2346
always with 23456
"""


def cell(dots: str) -> str:
    return chr(0x2800 + sum(1 << (int(d) - 1) for d in dots if d != "0"))


@dataclass
class Rules:
    """A table: cells of characters, of groups of letters, and the signs before numbers and letters."""

    chars: dict[str, str] = field(default_factory=dict)
    digits: dict[str, str] = field(default_factory=dict)
    groups: dict[str, str] = field(default_factory=dict)
    number: str = ""
    letter: str = ""

    @classmethod
    def read(cls, lines: Iterable[str], include: Callable[[str], Iterable[str]] | None = None) -> "Rules":
        """From lines ``opcode argument dots``; ``include name`` reads another table's lines by ``include``.  Other opcodes are errors, comments (#) and blank lines none."""
        rules = cls()
        rules._add(lines, include, ())
        return rules

    def _add(self, lines: Iterable[str], include, within: tuple[str, ...]) -> None:
        for line in lines:
            words = line.split("#")[0].split() if not line.lstrip().startswith("#") else []
            if not words:
                continue
            op, *rest = words
            if op == "include" and include:
                if rest[0] not in within:
                    self._add(include(rest[0]), include, (*within, rest[0]))
            elif op in ("letter", "punctuation", "sign", "space"):
                self.chars[" " if rest[0] == "\\s" else rest[0]] = "".join(map(cell, rest[1].split("-")))
            elif op == "digit":
                self.digits[rest[0]] = cell(rest[1])
            elif op == "always":
                self.groups[rest[0]] = "".join(map(cell, rest[1].split("-")))
            elif op == "numsign":
                self.number = cell(rest[0])
            elif op == "lettersign":
                self.letter = cell(rest[0])
            else:
                raise ValueError(f"unknown rule: {line.strip()}")

    def translate(self, text: str, no_contract: Iterable[tuple[int, int]] = ()) -> tuple[str | None, list[int]]:
        """(cells, places): the longest group at each place, unless a character of it is in a ``no_contract`` span; null cells if a character has none."""
        text = text.lower() if len(text.lower()) == len(text) else text
        whole = {i for a, b in no_contract for i in range(a, b)}
        longest = max(map(len, self.groups), default=0)
        out: list[str] = []
        places: list[int] = []
        at, number = 0, False
        while at < len(text):
            group = next((text[at : at + n] for n in range(min(longest, len(text) - at), 0, -1) if text[at : at + n] in self.groups and whole.isdisjoint(range(at, at + n))), None)
            c = text[at]
            if group:
                cells = self.groups[group]
            elif c in self.digits:
                cells = ("" if number else self.number) + self.digits[c]
            elif c in self.chars:
                cells = (self.letter if number and self.chars[c] in self.digits.values() else "") + self.chars[c]
            else:
                return None, []
            number = group is None and c in self.digits
            out.append(cells)
            places += [at] * len(cells)
            at += len(group or c)
        return "".join(out), places

    def back(self, cells: str) -> str | None:
        """The text of cells: the longest known piece at each place; null if one is unknown."""
        known = {v: k for k, v in self.chars.items()} | {v: k for k, v in self.groups.items()}
        digit, longest = {v: k for k, v in self.digits.items()}, max(map(len, known), default=0)
        out, at, number = [], 0, False
        while at < len(cells):
            c = cells[at]
            if c in (self.number, self.letter) and c and at + 1 < len(cells):
                number, at = c == self.number, at + 1
            elif number and c in digit:
                out.append(digit[c])
                at += 1
            else:
                piece = next((cells[at : at + n] for n in range(min(longest, len(cells) - at), 0, -1) if cells[at : at + n] in known), None)
                if piece is None:
                    return None
                out.append(known[piece])
                at, number = at + len(piece), False
        return "".join(out)


class Isolated:
    """A function run in a child process: one that outlives the limit is ended and gives ``timeout``, one that dies ``crashed``; the next call starts anew."""

    def __init__(self, run: Callable, seconds: float = 20.0) -> None:
        self.run, self.seconds, self.child = run, seconds, None

    @staticmethod
    def _serve(run: Callable, pipe) -> None:
        while True:
            try:
                args = pipe.recv()
            except EOFError:
                return
            try:
                pipe.send(("ok", run(*args)))
            except Exception as e:  # noqa: BLE001
                pipe.send(("exception", type(e).__name__))

    def __call__(self, *args) -> tuple[str, object]:
        """("ok", result), ("exception", its name), ("timeout", None) or ("crashed", None)."""
        if self.child is None:
            context = mp.get_context("fork")
            self.pipe, theirs = context.Pipe()
            self.child = context.Process(target=self._serve, args=(self.run, theirs), daemon=True)
            self.child.start()
            theirs.close()
        try:
            self.pipe.send(args)
            if self.pipe.poll(self.seconds):
                return self.pipe.recv()
            said = "timeout"
        except (EOFError, OSError):
            said = "crashed"
        self.close()
        return said, None

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None

    def __reduce__(self):
        return Isolated, (self.run, self.seconds)


@dataclass(frozen=True)
class Engine:
    """A provider bound to a version: text to (cells, places), and cells to text."""

    name: str
    version: str
    forward: Callable[[str, str], "tuple[str | None, list[int]]"]
    backward: Callable[[str, str], "str | None"] | None = None


def rule_engine(name: str, tables: dict[str, list[str]], version: str = "1") -> Engine:
    """An engine over tables given as lines; ``*`` serves the tables that aren't named."""
    read = {k: Rules.read(v, lambda other: tables[other]) for k, v in tables.items()}
    of = lambda table: read.get(table) or read.get("*")
    return Engine(name, version, lambda table, text: of(table).translate(text) if of(table) else (None, []), lambda table, cells: of(table).back(cells) if of(table) else None)


ENGINES: dict[str, Callable[[], Engine]] = {"basic": lambda: rule_engine("basic", {"*": BASIC_RULES.splitlines()})}
_LOADED: dict[str, Engine] = {}


def engine(name: str, version: str | None = None) -> Engine:
    """The engine of a name, made once per process; an error if it is not of the version."""
    if name not in _LOADED:
        _LOADED[name] = ENGINES[name]()
    if version is not None and _LOADED[name].version != version:
        raise RuntimeError(f"{name} is of version {_LOADED[name].version}, not {version}")
    return _LOADED[name]


_RESULT = t.StructType([t.StructField("braille", t.StringType()), t.StructField("places", t.ArrayType(t.IntegerType())), t.StructField("reason", t.StringType())])


def transcribe_routed(rows: DataFrame, routes: DataFrame, table: str = "table_id", text: str = "text", version: str | None = None, seconds: float | None = None) -> DataFrame:
    """The rows with ``braille``, ``places`` (the character each cell came from) and ``reason``.

    ``routes`` says the engine of each table (table_id, engine); tables without
    one, or whose engine isn't there, are ``pending`` - no stand-in is used.  Each
    distinct (table, text) is transcribed once.  With ``seconds`` every call runs
    in a child process under that limit.  Reasons: missing, undefined, pending,
    exception, timeout, crashed.
    """
    rows = rows.drop(*[c for c in ("braille", "places", "reason") if c not in (table, text)])

    @F.pandas_udf(_RESULT)
    def call(engines: pd.Series, tables: pd.Series, texts: pd.Series) -> pd.DataFrame:
        held: dict[str, Isolated] = {}
        out = []
        for e, a, b in zip(engines, tables, texts):
            if a is None or b is None:
                out.append((None, None, "missing"))
            elif e is None or e not in ENGINES:
                out.append((None, None, "pending"))
            else:
                run = engine(e, version).forward
                if seconds is None:
                    try:
                        said, got = "ok", run(a, b)
                    except Exception:  # noqa: BLE001
                        said, got = "exception", None
                else:
                    said, got = held.setdefault(e, Isolated(run, seconds))(a, b)
                out.append((*got, None if got[0] is not None else "undefined") if said == "ok" else (None, None, said))
        for h in held.values():
            h.close()
        return pd.DataFrame([(b, p if b is not None else None, r) for b, p, r in out], columns=["braille", "places", "reason"])

    known = routes.select(F.col("table_id").alias("_t"), F.col("engine").alias("_e")).dropDuplicates(["_t"])
    distinct = rows.select(F.col(table).alias("_t"), F.col(text).alias("_x")).distinct().join(known, "_t", "left")
    done = distinct.select("_t", "_x", call("_e", "_t", "_x").alias("_r"))
    joined = rows.join(done, F.col(table).eqNullSafe(F.col("_t")) & F.col(text).eqNullSafe(F.col("_x")), "left")
    return joined.select(*[rows[c] for c in rows.columns], "_r.braille", "_r.places", "_r.reason")


def back_translated(rows: DataFrame, name: str, table: str = "table_id", braille: str = "braille", out: str = "back") -> DataFrame:
    """The rows with the text that the engine reads from their cells; null where it can't."""

    @F.pandas_udf(t.StringType())
    def call(tables: pd.Series, cells: pd.Series) -> pd.Series:
        read = engine(name).backward
        return pd.Series([None if a is None or b is None or read is None else read(a, b) for a, b in zip(tables, cells)], dtype=object)

    return rows.withColumn(out, call(F.col(table), F.col(braille)))


def homophones(pairs: DataFrame, name: str) -> DataFrame:
    """(pairs of ``table_id``, ``a``, ``b``) with ``homophone``: whether the engine writes both characters with the same cells; each is asked once."""

    @F.pandas_udf(t.StringType())
    def call(tables: pd.Series, texts: pd.Series) -> pd.Series:
        write = engine(name).forward
        return pd.Series([None if a is None or b is None else write(a, b)[0] for a, b in zip(tables, texts)], dtype=object)

    asked = pairs.select("table_id", F.explode(F.array("a", "b")).alias("c")).distinct().where("c is not null")
    cells = asked.withColumn("cells", call("table_id", "c"))
    one, two = (cells.select("table_id", F.col("c").alias(x), F.col("cells").alias(f"_{x}")) for x in ("a", "b"))
    joined = pairs.join(one, ["table_id", "a"], "left").join(two, ["table_id", "b"], "left")
    return joined.withColumn("homophone", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).drop("_a", "_b")


def bisected(run: Callable[[list], list], items: list) -> list:
    """Results of an engine that takes whole batches: one whose results don't match its items in number is halved until each item that spoils it stands alone (null)."""
    if not items:
        return []
    try:
        got = list(run(items))
    except Exception:  # noqa: BLE001
        got = []
    if len(got) == len(items):
        return got
    if len(items) == 1:
        return [None]
    half = len(items) // 2
    return bisected(run, items[:half]) + bisected(run, items[half:])
