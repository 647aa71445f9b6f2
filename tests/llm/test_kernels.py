"""Byte kernels and suffix sorting against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sleuthframe.llm import bytesops as B
from sleuthframe.llm.suffixsort import common_prefixes, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nabABé ", max_size=12)), max_size=8))
def test_words_of_a_batch(texts):
    got, seen = [], {}
    for _, _, data, off in B.chunks(pa.array(texts, pa.string()), 16):
        starts, ends, first = B.words(data, off)
        hashes = B.span_hash(B.prefix_hash(data), starts, ends)
        for a, b in zip(first[:-1], first[1:], strict=True):
            got.append([data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)])
            for w, h in zip(got[-1], hashes[a:b].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert got == [WORD.findall(t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets_fold_ascii_only():
    def sets(*texts):
        return [s for _, _, d, o in B.chunks(pa.array(texts, pa.string())) for s in B.shingle_sets(d, o)]

    a, b, c, d, e = sets("A b C d E", "a B c D e", "a b c d é", "a b c d É", "a b")
    assert np.array_equal(a, b) and not np.array_equal(c, d) and len(e) == 1
    assert len(sets("x " * 50)[0]) == 1 and len(sets("")[0]) == 0


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(400):
        x = [rng.randint(1, rng.choice([1, 2, 6])) for _ in range(rng.randint(0, 30))] * rng.choice([1, 2, 3]) + [0]
        order = suffix_array(x)
        assert order == sorted(range(len(x)), key=lambda i: x[i:])
        for r, n in enumerate(common_prefixes(x, order)):
            if r:
                p, q = x[order[r - 1] :], x[order[r] :]
                assert p[:n] == q[:n] and (p[n : n + 1] != q[n : n + 1])
