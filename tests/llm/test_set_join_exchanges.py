"""What the set join sends through exchanges, and which lists reach the blocks."""

import random

from lectern.llm import ngram_join, set_join


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def with_joins_shuffled(spark, run):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_entries_cross_one_exchange(spark):
    rows = [(1, 10, 5, 0), (1, 11, 5, 1), (1, 11, 5, 1), (2, 10, 5, 1), (3, 12, 4, 0), (3, 12, 4, 0), (4, 10, 5, 2), (4, 12, 4, 1)]
    entries = spark.createDataFrame(rows, "key long, node long, n long, pos long").repartition(3)
    met = with_joins_shuffled(spark, lambda: set_join._sized(set_join._shared(entries)))
    assert plan_of(met).count("Exchange hashpartitioning(key") == 1 and "Join" not in plan_of(met)
    got = met.collect()
    assert sorted((r.key, r.node, r.n, r.pos, r.length) for r in got) == [(1, 10, 5, 0, 2), (1, 11, 5, 1, 2), (4, 10, 5, 2, 2), (4, 12, 4, 1, 2)]
    assert all(len({r.pivot for r in got if r.key == key}) == 1 for key in (1, 4))


def test_sketches_that_no_pair_wants_stay(spark):
    rows = [(k, 4, [k]) for k in range(6)]
    sketches = spark.createDataFrame(rows, "node long, n long, sketch array<long>")
    pairs = spark.createDataFrame([(2, 1), (5, 1)], "a long, b long")
    met = with_joins_shuffled(spark, lambda: set_join._sketched(pairs, sketches))
    assert "hashpartitioning(a#" not in plan_of(met) and "LeftSemi" in plan_of(met)
    assert sorted((r.a, r.b, r.x.sketch[0], r.y.sketch[0]) for r in met.collect()) == [(2, 1, 2, 1), (5, 1, 5, 1)]


def test_many_pairs_meet_the_same_sketches_and_sets(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{r.randrange(5000)}" for _ in range(80)]
    rows = [(k, " ".join(base[: 40 + k] + [f"x{k % 7}"] + base[41 + k :])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(map(tuple, ngram_join.shingle_components(df, group=4).collect()))
    monkeypatch.setattr(set_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(set_join, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, ngram_join.shingle_components(df, group=4).collect())) == few


def test_only_lists_in_which_groups_meet_reach_the_blocks(spark, monkeypatch):
    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(40):  # all link with each other: no list of differences holds a set apart from the pivot
        words = list(base)
        words[r.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(words)))
    for k in range(12):  # at about the threshold to each other
        words = list(base)
        for _ in range(3):
            words[r.randrange(200)] = f"y{r.random()}"
        rows.append((100 + k, " ".join(words)))
    seen, meet = [], set_join._met_in_blocks

    def watched(lists, *args, **kinds):
        seen.append(lists.collect())
        return meet(lists, *args, **kinds)

    monkeypatch.setattr(set_join, "_met_in_blocks", watched)
    ngram_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"), group=4, rounds=2).count()
    assert seen and any(seen)
    for lists in seen:
        for key in {x.key for x in lists}:
            own = [x for x in lists if x.key == key]
            roles = {x.role for x in own}
            assert len({x.group for x in own}) > 1 and (0 in roles or len(roles) > 1)
