import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from metricloom.llm.kernel import Words, shingle_sets, sliding_min

TEXT = st.text(alphabet="ab \n\t\x0b\x0c\r\x1c\u00a0éA.,|", max_size=60)


def split(t, lower=False):
    t = t or ""
    if lower:
        t = re.sub("[A-Z]", lambda m: m.group().lower(), t)
    return re.findall(r"[^\x20\x09-\x0D]+", t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.booleans())
def test_words_are_those_of_the_pattern(texts, lower):
    w = Words(pa.array(texts, pa.string()), lower=lower)
    for i, t in enumerate(texts):
        got = [w.buf[s:e].tobytes().decode() for s, e in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
        assert got == split(t, lower)
    seen = {}
    for s, e, h in zip(w.start, w.end, w.hash, strict=True):
        assert seen.setdefault(w.buf[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_sliced_arrays_and_words_longer_than_a_block():
    long = "x" * 300_000
    a = pa.array(["skip", "one two", long + " " + long + "y", None])
    w = Words(a.slice(1))
    assert np.diff(w.first).tolist() == [2, 2, 0]
    assert w.hash[2] == Words(pa.array([long])).hash[0] != w.hash[3]


def test_shingle_sets():
    texts = ["a b c d e f", "a b c d e f a b c d e f", "a b", None, "", "b a"]
    s = shingle_sets(Words(pa.array(texts)))
    assert [len(x) for x in s] == [2, 6, 1, 0, 0, 1]
    assert set(s[0]) < set(s[1]) and s[2][0] != s[5][0]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 100, 50)
    for k in (1, 2, 3, 7, 16, 50):
        assert sliding_min(x, k).tolist() == [min(x[i : i + k]) for i in range(50 - k + 1)]
    assert len(sliding_min(x, 51)) == 0
