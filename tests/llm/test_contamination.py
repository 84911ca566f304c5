"""Every diagonal of every document and item, compared token by token, against the seeded search."""

import random
import re

import numpy as np

from lectern.llm import decontaminate as dc

DATA = "/root/testdata/sf0.001"


def best_of(doc, item):
    """(best, n_equal) of the best diagonal, by comparing everywhere."""
    out = (0, 0)
    d, t = np.array(doc), np.array(item)
    for diagonal in range(1 - len(t), len(d)):
        low = max(0, -diagonal)
        n = min(len(t), len(d) - diagonal) - low
        eq = (t[low : low + n] == d[low + diagonal : low + diagonal + n]).astype(int)
        if eq.sum() < 1:
            continue
        total = np.concatenate([[0], np.cumsum(eq)])
        w = min(dc.WINDOW, n)
        out = max(out, (int((total[w:] - total[:-w]).max()), int(eq.sum())))
    return out


def held(doc, item):
    best, equal = best_of(doc, item)
    return best >= dc.EQUAL or len(item) < dc.WINDOW and equal == len(item)


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def coded(texts):
    known = {}
    return [[known.setdefault(w, len(known)) for w in words(t)] for t in texts]


def test_planted_with_substitutions(spark):
    r = random.Random(11)
    word = lambda: r.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(r.randint(0, 30))
    items = [" ".join(word() for _ in range(n)) for n in (3, 8, 12, 13, 20, 40)]
    docs = []
    for i in range(120):
        own = r.choice(items).split()
        a = r.randint(0, max(0, len(own) - 14))
        part = own[a:] if r.random() < 0.5 else own[: a + 14]
        for k in r.sample(range(len(part)), min(len(part), r.randint(0, 4))):
            part[k] = "zz"
        docs.append(" ".join([word() for _ in range(r.randint(0, 30))] + part + [word() for _ in range(r.randint(0, 30))]))
    codes = coded(docs + items)
    want = {(i, k) for i in range(len(docs)) for k in range(len(items)) if held(codes[i], codes[len(docs) + k])}
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = dc.contamination(d, b).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and 20 < len(want) < len(docs) * len(items) / 2
    for x in got:
        best, equal = best_of(codes[x.doc_id], codes[len(docs) + x.item_id])
        assert (x.best, x.n_equal, x.n_items) == (best, equal, 1)


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    codes = coded([x.text for x in docs] + [x.text for x in items])
    want = set()
    for i, x in enumerate(docs):
        own = set(codes[i])
        for k, y in enumerate(items):
            t = codes[len(docs) + k]
            if sum(w in own for w in t) >= min(dc.EQUAL, len(t)) and held(codes[i], t):
                want.add((x.doc_id, y.item_id))
    got = {(r.doc_id, r.item_id) for r in dc.op9_decontaminate(spark, DATA).collect()}
    assert got == want and want
    left = {r.doc_id for r in dc.without_contaminated(spark.createDataFrame(docs), spark.createDataFrame(items)).collect()}
    assert left == {x.doc_id for x in docs} - {i for i, _ in want}
