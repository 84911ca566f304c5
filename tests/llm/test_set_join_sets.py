"""Sets come only of what sketches leave, once each, and pivots' sketches go to those of their sets."""

import random

from lectern.llm import ngram_join, set_join


def joins_of(spark, run):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = run()
        return df._jdf.queryExecution().executedPlan().toString(), sorted(map(tuple, df.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_sets_only_of_what_sketches_leave(spark, monkeypatch):
    r = random.Random(5)
    own = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared = own(20)
    rows = [(k, " ".join(own(40) + shared)) for k in range(30)]  # long lists, no two sets alike
    seen, sets = [], set_join._sets

    def watched(texts, words):
        seen.append(texts.count())
        return sets(texts, words)

    monkeypatch.setattr(set_join, "_sets", watched)
    monkeypatch.setattr(set_join, "_known", lambda marks, counted: {})
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.component_id) for x in ngram_join.shingle_components(df, group=4).collect())
    assert got == [(k, k) for k in range(30)]
    assert sum(seen) == 0


def test_sets_come_once_whatever_asks_for_them(spark):
    rows = [(1, "a b c d"), (2, "a b c e"), (2, "a b c e"), (3, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = set_join.set_marks(docs, 3).where("node IS NOT NULL")
    reps = set_join._texts_of(own)
    nodes = {x.rep: x.node for x in reps.collect()}
    some = lambda *ids: spark.createDataFrame([(nodes[i],) for i in ids], "node long")
    first = set_join._with_sets(None, some(1, 2, 2), docs, reps, 3)
    both = set_join._with_sets(first, some(2, 3), docs, reps, 3)
    assert sorted(x.node for x in first.collect()) == sorted(nodes[i] for i in (1, 2))
    assert sorted((x.node, x.n, len(x.shingles)) for x in both.collect()) == sorted((nodes[i], n, n) for i, n in ((1, 2), (2, 2), (3, 1)))
    assert set_join._with_sets(both, some(1, 3), docs, reps, 3) is both


def test_sketches_of_pivots_go_to_their_sets(spark):
    sketches = spark.createDataFrame([(k, 40, [1] * 16) for k in range(8)], "node long, n long, sketch array<long>")
    pairs = spark.createDataFrame([(k, k % 2) for k in range(2, 8)], "node long, pivot long")
    plan, got = joins_of(spark, lambda: set_join._near_pivot(pairs, sketches, 19))
    assert "SortMergeJoin" not in plan
    assert got == [(k, k % 2) for k in range(2, 8)]
