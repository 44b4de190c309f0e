"""Functions against plain counterparts and known values."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from textloom.functions import edits as E
from textloom.functions.forms import bare, bare_with_offsets, batches_by_size, run_hashes, runs_by_text, squeezed
from textloom.functions.sketches import OnePermutation, distinct_sorted, winnowed

TEXT = st.text(alphabet="ab cÄé한글ｶﾞ①.́​", max_size=40)


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_bare_form_by_definition(t):
    folded = unicodedata.normalize("NFKC", t).casefold()
    assert bare(t) == "".join(c for c in folded if unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd")


def test_bare_offsets():
    t = "Ａb ①한́x!"
    plain, starts, ends = bare_with_offsets(t)
    assert plain == bare(t) and [t[a:b] for a, b in zip(starts, ends)][:3] == ["Ａ", "b", "①"]


@given(st.text(alphabet="ab한", max_size=60), st.integers(1, 13))
@settings(max_examples=200, deadline=None)
def test_run_hashes_tell_runs_apart(t, k):
    h = run_hashes(t, k)
    assert len(h) == max(0, len(t) - k + 1)
    runs = [t[i : i + k] for i in range(len(h))]
    assert len(set(h.tolist())) == len(set(runs))
    assert all((h[i] == h[j]) == (runs[i] == runs[j]) for i in range(len(h)) for j in range(i))


def test_runs_of_a_batch_are_those_of_each_text():
    texts = ["abcdef", "", "ab", "한글한글한글"]
    for k in (2, 3, 5):
        for t, h in zip(texts, runs_by_text(texts, k)):
            assert (h == run_hashes(t, k)).all()
    assert list(batches_by_size(["aaaa", "bbbb", "c"], 5)) == [(0, 1), (1, 3)]
    assert list(batches_by_size([], 5)) == []


def test_squeezed():
    assert squeezed(" A 　b\n\nC ") == "a b c"


def test_winnowing_guarantee():
    rng = random.Random(1)
    for _ in range(50):
        shared = "".join(rng.choice("abcd") for _ in range(30))
        a = run_hashes("".join(rng.choice("xyz") for _ in range(20)) + shared, 9)
        b = run_hashes(shared + "".join(rng.choice("uvw") for _ in range(20)), 9)
        assert set(a[winnowed(a, 12)].tolist()) & set(b[winnowed(b, 12)].tolist())


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    sketch = OnePermutation(256)
    both = rng.integers(0, 2**63, 700).astype(np.uint64) * np.uint64(2)
    a, b = (distinct_sorted(np.concatenate([both, rng.integers(0, 2**63, 150).astype(np.uint64) * np.uint64(2)])) for _ in range(2))
    least = sketch.least([a, b])
    assert abs((least[0] == least[1]).mean() - 0.7) < 0.12
    assert (sketch.least([a])[0] == least[0]).all()


@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
@settings(max_examples=300, deadline=None)
def test_edit_script_is_a_shortest_one(a, b):
    ops = E.edit_script(a, b)
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    assert len(ops) == d[len(a)][len(b)]
    out, shift = list(a), 0
    for op, i, j in ops:
        if op == "replace":
            out[i + shift] = b[j]
        elif op == "delete":
            del out[i + shift]
            shift -= 1
        else:
            out.insert(i + shift, b[j])
            shift += 1
    assert "".join(out) == b


def test_cell_errors():
    assert E.cell_errors("Hello world", "⠓⠑⠇⠇⠕⠀⠺⠕⠗⠇⠙", "Hello world") == (0, 11)
    few, many = E.cell_errors("Hello world", "⠓⠑⠇⠇⠕⠀⠺⠕⠗⠇⠙", "Hallo world"), E.cell_errors("Hello world", "⠓⠑⠇⠇⠕⠀⠺⠕⠗⠇⠙", "Hxxxx world")
    assert 0 < few[0] < many[0] <= 11
    assert E.cell_errors("", "", "abc") == (0, 0)


@pytest.mark.parametrize("raw, canonical", [(r"{1 \over 2}", r"\frac{1}{2}"), (r"x^2", r"x^{2}"), (r"\dfrac{a}{b}", r"\frac{a}{b}"), (r"a \le b % c", r"a\leq b")])
def test_latex(raw, canonical):
    assert E.canonical_latex(raw) == canonical
    assert E.canonical_latex(canonical) == canonical


def test_codecs_and_wrapping():
    for s in ("", "abc", "한글 é"):
        assert E.from_byte_ids(E.byte_ids(s)) == s
    assert E.from_byte_ids([3 + 0xED, 1, 400]) == ""
    assert E.wrapped("aa bb cc", 5) == ["aa⠀bb", "cc"] and E.wrapped("abcdefg", 3) == ["abc", "def", "g"] and E.wrapped("", 3) == []
    assert E.chrf("abc", "abc") == 1.0 and E.chrf("abc", "xyz") == 0.0
    assert E.word_distance("a b c", "a x c d") == 2
