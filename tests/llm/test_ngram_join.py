"""The shingle-set join against all pairs."""

import random

import pytest

from lectern.llm import ngram_join


def shingles(t, words=3):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def expected(rows, words=3, q=19):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for j in range(len(rows)):
        for k in range(j):
            if sets[j] and sets[k] and len(sets[j] & sets[k]) * (q + 1) >= (q - 1) * len(sets[j] | sets[k]):
                parent[root(j)] = root(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(str((i, len(sets[k]), least.get(root(k)))) for k, (i, _) in enumerate(rows))


def corpus(n_base, copies, seed):
    """Texts, edited copies of them at about the threshold, and copies of the copies."""
    r = random.Random(seed)
    rows, i = [(1, None), (2, ""), (3, " \n"), (4, "Two words"), (5, "two\twORDS"), (None, "two words"), (None, None), (6, "Äh ähm ÄH"), (7, "äh ähm äh"), (7, "one more text of this id")], 10
    for b in range(n_base):
        chain = [[f"w{r.randrange(4000)}" for _ in range(r.choice((5, 60, 130, 200)))]]
        for _ in range(copies if b else 6 * copies):
            words = list(r.choice(chain[:3] if r.random() < 0.6 else chain))
            for _ in range(r.randrange(5)):
                k = r.randrange(len(words))
                words[k : k + 1] = r.choice(([], [f"n{r.randrange(10**6)}"], [words[k], words[k]], ["shared"]))
                words = words or ["x"]
            chain.append(words)
        for words in chain:
            rows.append((i, " ".join(words)))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("group", "rounds", "cell", "seed"), [(128, 3, 1024, 1), (4, 3, 8, 2), (3, 1, 1024, 3), (4, 0, 6, 4)])
def test_components_are_those_of_all_pairs(spark, group, rounds, cell, seed):
    rows = corpus(8, 8, seed)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, node string")
    got = ngram_join.shingle_components(df, group=group, rounds=rounds, cell=cell)
    assert sorted(str(tuple(x)) for x in got.collect()) == expected(rows)


def test_other_words_and_threshold(spark):
    rows = corpus(5, 10, 9)
    got = ngram_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"), words=5, q=9, group=4)
    assert sorted(str(tuple(x)) for x in got.collect()) == expected(rows, 5, 9)


def test_empty_table(spark):
    assert ngram_join.shingle_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
