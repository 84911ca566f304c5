"""Sentences keep the digits at their ends; a line end is no stop."""

from lectern.functions import text
from lectern.operators import segmenting
from lectern.plans import registry
from tests.oracle import duck, sparked

TEXTS = ["Reouti anatha. 19.37.233.111", "0 a 0. 1 b 1. 2 c 2. 3 d 3.", "One. Two.\r", "No stop  It is. ", "10"]


def test_sentences_keep_their_digits(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", text.sentences(df["text"]).alias("s")).collect()}
    assert got[0] == ["Reouti anatha.", "19.37.233.111"]
    assert got[1] == ["0 a 0.", "1 b 1.", "2 c 2.", "3 d 3."]
    assert got[4] == ["10"]


def test_clauses_keep_their_digits(spark):
    df = spark.createDataFrame([(1, "0 is 0, 1 is 1, 2 is 2")], "doc_id long, text string")
    assert [r.text for r in segmenting.reading_clauses(df).orderBy("clause").collect()] == ["0 is 0,", "1 is 1,", "2 is 2"]


def test_sentence_report(spark, tmp_path):
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    assert sparked(registry.QUERIES["sentence_report"](spark, str(tmp_path))) == duck(registry.ORACLES["sentence_report"], str(tmp_path))
