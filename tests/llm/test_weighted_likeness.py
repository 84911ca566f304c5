"""Likeness of long texts against the exact weighted Jaccard similarity."""

import collections
import math
import random

from lectern.llm import weighted_samples


def similarity(a, b):
    x, y = ({w: 1 + math.log(n) for w, n in collections.Counter(t.split()).items()} for t in (a, b))
    return sum(min(x.get(w, 0), y.get(w, 0)) for w in x.keys() | y.keys()) / sum(max(x.get(w, 0), y.get(w, 0)) for w in x.keys() | y.keys())


def test_long_texts(spark):
    r = random.Random(6)
    texts = {i: " ".join(f"{i if i % 2 else 0}w{min(r.randrange(9000), r.randrange(9000))}" for _ in range(12000)) for i in range(12)}
    got = weighted_samples.weighted_fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(got) == 12
    errors = []
    for x in got:
        t, below = texts[x.doc_id], texts[(x.doc_id - 1) % 12]
        m = len(t) // 3
        errors += [x.near_edited - similarity(t, t[: len(t) - m] + below[:m]), x.near_next - similarity(t, below)]
    assert max(map(abs, errors)) < 0.25  # four deviations of 64 samples
    assert abs(sum(errors[1::2])) / 12 < 0.03
    assert abs(sum(errors[::2])) / 12 < 0.06
