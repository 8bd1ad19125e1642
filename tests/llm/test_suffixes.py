import random

import numpy as np
import pytest

from barwright.llm.repeats import Windows, longest_previous, merged, suffix_order


def in_common(x, y):
    k = 0
    while k < len(x) and x[k] == y[k]:
        k += 1
    return k


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 9, 13, 20, 50])
@pytest.mark.parametrize("collide", [False, True])
def test_suffix_order_and_longest_previous_factors(width, collide):
    rng = random.Random(width)
    for _ in range(30):
        n, letters = rng.randrange(width, 120), rng.choice(["a", "ab", "abcd"])
        body = "".join(rng.choice(letters) for _ in range(n)).encode()
        starts = np.array(sorted(rng.sample(range(n - width + 1), rng.randrange(1, n - width + 2))))
        windows = Windows(np.frombuffer(body, np.uint8), width)
        own = windows.hashes(starts)
        order, common = suffix_order(windows, starts, own % np.uint64(3) if collide else own)
        found = [body[s : s + width] for s in starts[order]]
        assert sorted(order.tolist()) == list(range(len(starts))) and found == sorted(found)
        assert common.tolist() == [in_common(x, y) for x, y in zip(found, found[1:], strict=False)]
        documents = np.array([rng.randrange(5) for _ in starts])
        for least in (1, 3, width):
            want = [max([in_common(x, y) for y, e in zip(found, documents, strict=True) if e < d], default=0) for x, d in zip(found, documents, strict=True)]
            assert longest_previous(documents, common, least).tolist() == [v if v >= least else 0 for v in want]


def test_merged_spans():
    rng = random.Random(5)
    spans = [(rng.randrange(3), rng.randrange(2), s := rng.randrange(60), s + rng.randrange(1, 9)) for _ in range(80)]
    got = list(zip(*(x.tolist() for x in merged(*(np.array(c) for c in zip(*spans, strict=True)))), strict=True))
    covered = lambda rows: {(d, k, i) for d, k, a, b in rows for i in range(a, b)}
    assert covered(got) == covered(spans) and len(covered(got)) == sum(b - a for *_, a, b in got)
    assert not {(d, k, b) for d, k, _, b in got} & {(d, k, a) for d, k, a, _ in got}
