"""One long labelled text leaves the others their say; the query's columns against a plain recomputation."""

import zlib

import pytest

from lectern.llm import quality


def corpus(spark, n=120):
    good, bad = "The river bends slowly. Old boats lie along the quiet bank, and people talk. ", "BUY!!! cl1ck $$$ now >>> http://x.y/?q=1 ### free free free "
    docs = [(i, (good if i % 2 else bad) * (2 + i % 5), "en", "s") for i in range(n)]
    return docs, [(i, i % 2, 0) for i in range(n)]


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_a_long_text_is_left_out_alone(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_BYTES", 100_000)
    monkeypatch.setattr(quality, "FIT_TEXT", 6_000)
    docs, labels = corpus(spark)
    long = [(1000 + i, "x " * 70_000, "en", "s") for i in range(6)]
    d, lab = frames(spark, docs + long, labels + [(1000 + i, 1, 0) for i in range(6)])
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(d, quality.fit_quality(d, lab)).collect()}
    assert all((scores[i] > 0.5) == (i % 2 == 1) for i in range(len(docs)))
    with pytest.raises(ValueError, match="longer than"):
        quality.fit_quality(*frames(spark, long, [(1000 + i, 1, 0) for i in range(6)]))


def test_query_columns(spark, tmp_path):
    docs, labels = corpus(spark)
    d, lab = frames(spark, [*docs, (500, None, None, None), (501, "", "en", "s")], labels)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    rows = quality.op8_quality(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) + 2
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows if r["held_out"] and r["doc_id"] < 500)
