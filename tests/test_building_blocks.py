import re

from lectern.plans import building_blocks


def cut(t):
    """Clauses by one scan: the mark stays left, white space after it goes."""
    out, last = [], 0
    for m in re.finditer(r"(?:(?<![0-9])[,;:](?![0-9])|[,;:](?=\s)|[،؛，；：、]|\s[-–—](?=\s))\s*", t):
        out.append(t[last : m.end()].strip())
        last = m.end()
    return [c for c in [*out, t[last:].strip()] if c]


def test_reading_clauses(spark):
    rows = building_blocks.QUERIES["reading_clauses"](spark, "/root/testdata/sf0.001").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.clause)):
        got.setdefault(r.doc_id, []).append(r.text.strip())
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: cut(r.text) for r in texts if cut(r.text)}


def test_null_and_empty_texts(spark):
    from lectern.operators import segmenting

    df = spark.createDataFrame([(1, None), (2, ""), (3, " , "), (None, "Mr. A went. Then B.")], "doc_id long, text string")
    assert [tuple(r) for r in segmenting.split_sentences(df).collect()] == [(3, 0, 0, ","), (None, 0, 0, "Mr. A went."), (None, 0, 1, "Then B.")]
    assert {r.doc_id for r in segmenting.source_clauses(df).collect()} >= {None}
    assert segmenting.tokenize(df.limit(0)).count() == 0
