"""Nulls, empty and repeated rows in the comparison operators."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.operators import scoring


def test_missing_and_named_citations(spark):
    df = spark.createDataFrame([(1, "第五節,第五节,第十二章", "第5 第五节"), (2, None, "第五节"), (3, "第五节", None), (3, "第五节", "第五節")], "id long, spoken string, heard string")
    assert sorted(map(tuple, scoring.missing_citations(df).collect())) == [(1, "第五节", 1), (1, "第十二章", 1), (3, "第五节", 1)]
    named = df.select("id", scoring.names_a_citation(F.split("heard", ",")).alias("n"))
    assert sorted(map(tuple, named.collect())) == [(1, True), (2, True), (3, False), (3, True)]
    assert scoring.missing_citations(df.limit(0)).count() == 0


def test_notices_and_codes(spark):
    docs = spark.createDataFrame([(1, "ur", None), (2, "ur", "ur"), (3, None, None), (4, "en", None)], "doc_id long, detected string, language string")
    confusions = spark.createDataFrame([("ur", "hi"), ("ur", "hi")], "detected string, meant string")
    assert [tuple(r) for r in scoring.language_notices(docs, confusions).collect()] == [(1, "ur", "hi")]
    tokens = spark.createDataFrame([("<2de>",), ("<2zh_Hant>",), ("__en__",), (None,), ("<2de>",), ("de",)], "token string")
    assert [r.lang for r in scoring.supported_languages(tokens, "tagged").collect()] == ["de", "zh_Hant"]
    assert [r.lang for r in scoring.supported_languages(tokens, "marked").collect()] == ["en"]


def test_coverage(spark):
    books = spark.createDataFrame([("a",), ("b",)], "book string")
    labels = spark.createDataFrame([("a", "de", "A"), ("b", "de", "B"), ("b", "de", "B"), ("a", "fr", "A"), ("b", "fr", " "), ("x", "fr", "X"), ("a", "ru", None)], "book string, lang string, label string")
    assert [tuple(r) for r in scoring.gazetteer_coverage(labels, books).collect()] == [("fr", 1, False), ("de", 2, True)]


def test_chrf_against_counted_grams(spark):
    def score(h, r):
        h, r = "".join((h or "").split()), "".join((r or "").split())
        shares = []
        for n in range(1, 7):
            a, b = (Counter(s[k : k + n] for k in range(len(s) - n + 1)) for s in (h, r))
            if a and b:
                both = (a & b).total()
                shares.append((both / a.total(), both / b.total()))
        p, q = (sum(x) / len(shares) for x in zip(*shares)) if shares else (0, 0)
        return 100 * 5 * p * q / (4 * p + q) if p + q else 0.0

    r = random.Random(5)
    rows = [(0, None, "abc"), (1, "", ""), (2, "ab", "ab"), (3, "a b\tc", "abc"), (4, "xyz", "abc"), (5, "😀é中" * 30, "é中😀" * 20), (6, "a" * 5000, "a" * 3000), (6, "b", None)]
    rows += [(10 + k, "".join(r.choices("abc é中", k=r.randrange(60))), "".join(r.choices("abc é中", k=r.randrange(60)))) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, hyp string, ref string")
    got = sorted(map(tuple, scoring.chrf(df).collect()))
    assert [i for i, _ in got] == [i for i, *_ in sorted(rows, key=lambda x: x[0])]
    assert [s for _, s in got] == pytest.approx([s for _, s in sorted((i, score(h, f)) for i, h, f in rows)])
    assert scoring.chrf(df.limit(0)).count() == 0
