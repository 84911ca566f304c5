"""The set join behind near copies: pairs at the threshold, large groups, long sets."""

import random

from pyspark.sql import functions as F

from lectern.llm import near_copies, set_join


def test_pairs_at_the_threshold_that_share_no_minima(spark):
    """Similarity 80 / 100; the keys of minima and fingerprints of the earlier join met none of these pairs."""
    rows = []
    for k, seed in enumerate((5429, 6798, 10961)):
        r = random.Random(seed)
        words = [f"w{r.randrange(10**6)}" for _ in range(94)]
        other = list(words)
        other[20], other[60] = "one", "two"
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(other)), (10 * k + 5, " ".join(words[:60]))]
    got = near_copies.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in got.collect()) == [0, 5, 10, 15, 20, 25]


def test_exact_checks_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(90)]
    checked, linked, rows = [], set_join._linked, []

    def counted(pairs, sets, q):
        checked.append(pairs.count())
        return linked(pairs, sets, q)

    for k in range(160):  # 0.69 to 0.9 to each other
        words = list(base)
        for _ in range(2):
            words[r.randrange(90)] = f"x{r.random()}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(set_join, "_linked", counted)
    monkeypatch.setattr(near_copies, "GROUP", 16)
    near_copies.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert 0 < sum(checked) < 160 * 159 / 2 / 8


def test_sketches_tell_long_sets_apart(spark):
    r = random.Random(4)
    rows = [(k, " ".join(f"w{r.randrange(10**7)}" for _ in range(12000))) for k in range(2)]
    rows.append((2, rows[0][1] + " " + " ".join(f"y{k}" for k in range(900))))
    marks = set_join.set_marks(spark.createDataFrame(rows, "doc_id long, text string"), 3).where("name IS NULL")
    pairs = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "a long, b long")
    left = set_join._likely(pairs, marks.select(F.col("doc_id").alias("node"), "n", "sketch"), 19)
    assert [tuple(x) for x in left.collect()] == [(2, 0)]
