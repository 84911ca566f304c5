"""Matching blocks of a batch against the plain search, with every way that bounds memory; no exchange before them."""

import random

import pyarrow as pa

from lectern.operators import alignment, blocks
from lectern.plans import registry
from tests.test_alignment import blocks as plain


def of(pairs):
    sides = [pa.array([p[n] for p in pairs], pa.list_(pa.string())) for n in (0, 1)]
    at, i, j, n = blocks.blocks_of(*sides)
    return [list(zip(*(x[at[k] : at[k + 1]].tolist() for x in (i, j, n)))) for k in range(len(pairs))]


def test_blocks_of_a_batch(monkeypatch):
    r = random.Random(5)
    pairs = [(None, None), ([], ["a"]), (["a"], None), ([None, "a", "b"], ["a", None, "b"])]
    for _ in range(400):
        letters = "abcdefghij"[: r.randrange(1, 11)]
        a = [r.choice(letters) for _ in range(r.randrange(60))]
        pairs.append((a, [x for x in a if r.random() < 0.85] if r.random() < 0.6 else [r.choice(letters) for _ in range(r.randrange(60))]))
    pairs += pairs[:100]
    want = [[*plain(a or [], b or []), (len(a or []), len(b or []), 0)] for a, b in pairs]
    for most, size in ((1 << 22, 1 << 18), (1 << 22, 50), (40, 1 << 18), (40, 60), (0, 1 << 18)):
        monkeypatch.setattr(blocks, "MOST", most)
        monkeypatch.setattr(blocks, "SLICE", size)
        assert of(pairs) == want


def test_many_repeats():
    a = ["x"] * 12000
    assert of([(a, a[:-7])]) == [[(0, 0, 11993), (12000, 11993, 0)]]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_no_exchange_for_matching(spark):
    assert exchanges(registry.QUERIES["edit_regions"](spark, "/root/testdata/sf0.001")) == 0


def test_no_exchange_for_error_rates(spark):
    assert exchanges(registry.QUERIES["error_rate"](spark, "/root/testdata/sf0.001")) == 1  # of the sums


def test_listed_and_tables_agree(spark):
    chunks = spark.createDataFrame([(1, 0, "A b.", ["a", "b"]), (1, 1, "C d.", ["c", "d"]), (1, 2, "", None), (1, 3, "g h", ["g", "h"]), (2, 0, "x", ["x"]), (3, 0, "y", [])], "doc_id long, chunk_id int, text string, words array<string>")
    words = spark.createDataFrame([(1, 0, "A", 1.0, 1.5), (1, 1, "b,", 1.5, 2.0), (1, 2, "zzz", 2.0, 9.0), (1, 3, "D", None, 3.0), (1, 4, "h", 3.0, 2.5), (3, 0, "y", 1.0, 2.0)], "doc_id long, pos int, word string, start double, end double")
    got = sorted(tuple(x) for x in alignment.align_text_to_words(chunks, words).collect())
    assert got == [(1, 0, "A b.", 1.0, 2.0, 2), (1, 1, "C d.", None, None, 0), (1, 2, "", None, None, 0), (1, 3, "g h", 3.0, 3.0, 1), (2, 0, "x", None, None, 0), (3, 0, "y", None, None, 0)]


def test_times_of_whole_texts_cross_one_exchange(spark):
    assert exchanges(registry.QUERIES["align_text_to_words"](spark, "/root/testdata/sf0.001")) == 1  # of the chunks in order
