"""Hard negatives against all scores."""

import math
import random

import pytest

from lectern.llm import hard_negatives as hn


def expected(rows, every=50):
    own = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        own[i] = min(own.get(i, one), one)
    score = lambda a, b: max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for a in sorted(own):
        if a % every:
            continue
        label, q = own[a]
        same = sorted((-score(q, v), i) for i, (k, v) in own.items() if k == label and i != a)[:5]
        for s, p in same:
            found = sorted((-score(q, v), i) for i, (k, v) in own.items() if k != label and -50 * s <= 100 * score(q, v) <= -95 * s)[:3]
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(found, 1)]
    return sorted(out)


def vectors(n, dims, seed, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [(i, [c + r.gauss(0, spread) for c in r.choice(centres)], r.randrange(10)) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label int, kind string, block string"


@pytest.mark.parametrize(("rows", "sizes"), [(vectors(900, 24, 1), (64, 128)), (vectors(300, 7, 2, 0.1), (1024, 16384)), (vectors(260, 1, 3), (16, 32))])
def test_as_all_scores(spark, monkeypatch, rows, sizes):
    rows += [(1000 + i, rows[3][1], 4) for i in range(120)]  # one vector very often
    rows += [(2000, None, 1), (2050, [1.0, None], 1), (2100, [float("nan")] * 3, 1), (2150, [float("inf")], 2), (2200, [1.0, 1.0], None), (None, [1.0], 1), (2250, [], 3), (2300, [0.5], 3), (2350, [3e30, 1.0], 3), (2351, [2e30, 5.0], 3), (2352, [1.9e30, -5.0], 5)]
    rows += [rows[0], (rows[50][0], [-1.0] * 5, 0)]
    monkeypatch.setattr(hn, "ROWS", sizes)
    monkeypatch.setattr(hn, "ANCHORS", 7)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert sorted(map(tuple, hn.hard_negatives(df).collect())) == expected(rows)


def test_empty(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hn.hard_negatives(spark.createDataFrame([(50, [1.0], 1, None, None)], SCHEMA)).collect() == []
