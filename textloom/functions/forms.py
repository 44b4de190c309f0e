"""Normal forms of text and the hashing of their character runs.

The bare form follows Unicode: NFKC, case folding, then only letters, marks and
digits.  Runs of k characters are hashed for a whole batch of texts at once.
"""

from __future__ import annotations

import unicodedata

import numpy as np

_PRIME = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class _Keep(dict):
    """Translation table that learns each code point once: kept if letter, mark or decimal digit."""

    def __missing__(self, code: int):
        kind = unicodedata.category(chr(code))
        self[code] = keep = code if kind[0] in "LM" or kind == "Nd" else None
        return keep


_KEEP = _Keep()


def bare(text: str) -> str:
    """Letters, marks and digits of the case-folded NFKC form."""
    return unicodedata.normalize("NFKC", text).casefold().translate(_KEEP)


class _Loose(dict):
    """Translation table that drops punctuation, symbols, separators, control and format characters."""

    def __missing__(self, code: int):
        kind = unicodedata.category(chr(code))
        self[code] = keep = None if kind[0] in "PSZ" or kind in ("Cc", "Cf") else code
        return keep


_LOOSE = _Loose()


def loose(text: str) -> str:
    """The case-folded NFKC form without punctuation, symbols, separators, control and format characters."""
    return unicodedata.normalize("NFKC", text).casefold().translate(_LOOSE)


def squeezed(text: str) -> str:
    """Lower case, each stretch of white space one space, ends trimmed."""
    return " ".join(text.lower().split())


def bare_with_offsets(text: str) -> tuple[str, list[int], list[int]]:
    """The bare form and, for each of its characters, where the cluster of ``text`` it came from starts and ends.

    Works cluster by cluster (a base character with its marks or conjoining
    letters), as normalisation acts within those.
    """
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    start = 0

    def flush(end: int) -> None:
        piece = bare(text[start:end])
        out.append(piece)
        starts.extend([start] * len(piece))
        ends.extend([end] * len(piece))

    for i, c in enumerate(text):
        joins = "ᅠ" <= c <= "ᇿ" or "ﾞ" <= c <= "ﾟ" or unicodedata.category(c)[0] == "M"
        if i > start and not joins:
            flush(i)
            start = i
    flush(len(text))
    return "".join(out), starts, ends


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes in place so that every bit depends on every input bit."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def run_hashes(text: str, k: int) -> np.ndarray:
    """Hash of each run of ``k`` characters, in order of position.

    Runs over the joined texts of a batch are the same numbers as over each text
    alone, so callers may hash a batch at once and cut at the text ends.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < k:
        return np.empty(0, np.uint64)
    h, have = points, 1
    result, done = None, 0
    rest = k
    while rest:  # binary method: blocks of 1, 2, 4 ... characters
        if rest & 1:
            if result is None:
                result, done = h, have
            else:
                n = min(len(result), len(h) - done)
                result = result[:n] * np.uint64(pow(_PRIME, have, 1 << 64)) + h[done : done + n]
                done += have
        rest >>= 1
        if rest:
            h = h[: len(h) - have] * np.uint64(pow(_PRIME, have, 1 << 64)) + h[have:]
            have *= 2
    return mix(result[: len(points) - k + 1].copy())


def batches_by_size(texts: list, most: int = 1_000_000):
    """Yield (first, last) index ranges whose joined length stays near ``most`` characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def runs_by_text(texts: list[str], k: int) -> list[np.ndarray]:
    """Run hashes of each text, computed over the joined texts."""
    joined = run_hashes("".join(texts), k)
    out, at = [], 0
    for t in texts:
        out.append(joined[at : at + max(0, len(t) - k + 1)])
        at += len(t)
    return out
