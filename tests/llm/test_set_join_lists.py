"""Lists packed where their entries met, blocks by role, and only what no link connects checked again."""

import random

import pytest

from lectern.llm import ngram_join, set_join


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_are_packed_without_a_second_exchange(spark):
    rows = [(1, 10, 5, 0), (1, 11, 5, 1), (3, 12, 4, 0)] + [(4, k, 5, 2) for k in range(9)]
    entries = spark.createDataFrame(rows, "key long, node long, n long, pos long").repartition(3)
    lists = set_join._shared(entries).selectExpr("*", "0L AS role")
    packed = set_join._packed(set_join._sized(lists), 4)
    assert plan_of(packed).count("Exchange hashpartitioning") == 1
    got = packed.collect()
    assert [sorted(r.node) for r in got if r.key == 1] == [[10, 11]]
    assert {r.key for r in got} == {1, 4} and sum(r.key == 4 for r in got) > 1
    assert sorted((r.key, r.node, r.n, r.pos, r.length) for r in set_join._unpacked(packed).collect()) == [(1, 10, 5, 0, 2), (1, 11, 5, 1, 2)] + [(4, k, 5, 2, 9) for k in range(9)]


@pytest.mark.parametrize("ones, twos", [(40, 3), (3, 40), (30, 30), (0, 30)])
def test_blocks_of_each_role_meet_those_of_the_other(spark, ones, twos):
    lists = [(7, k, 40, 0, 1 if k < ones else 2, k % 11) for k in range(ones + twos)]
    if not ones:
        lists = [(key, k, n, pos, 0, g) for key, k, n, pos, _, g in lists]
    sketches = spark.createDataFrame([(k, 40, [k % 3 and -1] * 16) for k in range(ones + twos)], "node long, n long, sketch array<long>")
    df = set_join._where_kinds_meet(spark.createDataFrame(lists, "key long, node long, n long, pos long, role long, group long"))
    want = {(a, b) for a in range(ones + twos) for b in range(a) if (not ones or b < ones <= a) and a % 11 != b % 11 and (a % 3 > 0) == (b % 3 > 0)}
    assert {tuple(x) for x in set_join._met_in_blocks(df, sketches, 19, 8).collect()} == want
    first = set_join._met_in_blocks(df, sketches, 19, 8, all_pairs=False).collect()
    chosen, again = {(x.a, x.b) for x in first if x.b is not None}, {(x.list, x.a) for x in first if x.b is None}
    assert chosen <= want and {(7, x) for p in want - chosen for x in p} <= again


def texts(r, count, changed):
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    for _ in range(count):
        words = list(base)
        for _ in range(changed):
            words[r.randrange(200)] = f"x{r.random()}"
        yield " ".join(words)


def test_pairs_that_links_connect_are_not_checked(spark, monkeypatch):
    checked, linked = [], set_join._linked

    def counted(pairs, sets, q):
        checked.append(pairs.count())
        return linked(pairs, sets, q)

    monkeypatch.setattr(set_join, "_linked", counted)
    rows = list(enumerate(texts(random.Random(2), 12, 1)))
    got = ngram_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.component_id for x in got} == {0}
    assert sum(checked) == 11


def test_lists_without_likely_pairs_meet_once(spark, monkeypatch):
    calls, meet = [], set_join._met_in_blocks

    def watched(lists, *args, **kinds):
        calls.append(lists.count())
        return meet(lists, *args, **kinds)

    monkeypatch.setattr(set_join, "_met_in_blocks", watched)
    monkeypatch.setattr(set_join, "_known", lambda marks, counted: {})  # shared shingles are not last
    r = random.Random(9)
    own = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared = own(60)
    rows = [(k, " ".join(own(40) + shared)) for k in range(30)]
    got = ngram_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"), group=4, rounds=0).collect()
    assert all(x.component_id == x.doc_id for x in got)
    assert len(calls) == 1 and calls[0] > 30
