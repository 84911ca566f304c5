"""Citations put back into translations, snapshots and broken rows of the ledger, gazetteers, on small rows."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lectern.operators import labels, ledger, restoring


def one(spark, expression, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(expression(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("source", "translated", "lang", "out"),
    [
        ("Compare @0@ with @1@.", "Сравнить @0@ с @1@", "ru", "Сравнить @0@ с @1@."),
        ("See @0@?\"", "比较 @0@ ", "zh", "比较 @0@？"),
        ("See @0@.", "देखें ＠ 0＠", "hi", "देखें ＠ 0＠।"),
        ("See @0@.", "See @0@ again", "es", "See @0@ again"),
        ("See @0@ now.", "See @0@", "es", "See @0@"),
        (None, "See @0@", "es", "See @0@"),
    ],
)
def test_keep_final_stop(spark, source, translated, lang, out):
    assert one(spark, lambda s, t: restoring.keep_final_stop(s, t, lang), source, translated) == out


@pytest.mark.parametrize(
    ("before", "name", "out"),
    [
        ("в ", "Псалтирь", "Псалтири"),
        ("Сравнить ", "Книга Иова 1:2", "Книгу Иова 1:2"),
        ("изучение ", "Книга Иова", "Книга Иова"),
        ("сравнивается ", "Книга Иова", "Книга Иова"),
        ("о ", "1-я Паралипоменон", "1-й Паралипоменон"),
        ("к ", "Первая книга Царств", "Первой книге Царств"),
        ("указывает на ", "Книга Иова", "Книгу Иова"),
        ("Основано: основан на ", "Книга Иова", "Книге Иова"),
        ("следует за ", "Книга Иова", "Книгой Иова"),
        ("вот под ", "Книга Иова", "Книга Иова"),
        ("Это ", "Книга Иова", "Книга Иова"),
        ("", "Книга Иова", "Книга Иова"),
        ("в ", "Job 3", "Job 3"),
    ],
)
def test_inflect_by_context(spark, before, name, out):
    assert one(spark, restoring.inflect_by_context, before, name) == out


def test_lost_and_unknown_citations(spark):
    refs = F.array(F.lit("A 1:1"), F.lit("B 2:2"))
    assert one(spark, lambda c: restoring.unprotect(c, c, refs, "es"), "x @1@ y @9@ ") == "x B 2:2 y @9@ A 1:1"
    assert one(spark, lambda c: restoring.unprotect(c, c, F.expr("cast(array() as array<string>)"), "es"), "plain @0@") == "plain @0@"


def test_only_model_rows_reach_the_model(spark, tmp_path):
    def fn(texts):
        with open(tmp_path / "seen", "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [f"<{t}>" for t in texts]

    df = spark.createDataFrame([(1, "a @0@", "a @0@", ["R"]), (2, " ", " ", []), (3, None, "", []), (4, "R.", "@0@.", ["R"]), (5, "b", "b", [])], "id long, text string, masked string, refs array<string>")
    got = {r["id"]: (r["route"], r["translated"]) for r in restoring.translate_segments(df, fn, "es").collect()}
    assert got == {1: ("model", "<a R>"), 2: ("blank", " "), 3: ("blank", None), 4: ("citation", "R."), 5: ("model", "<b>")}
    assert set((tmp_path / "seen").read_text().split("\n")[:-1]) == {"a @0@", "b"}
    assert restoring.translate_sentences(df, fn, "es").count() == 3


def test_snapshots_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([("/a/x.mp3", "undecided"), ("/a/y.mp3", "align")], "path string, mode string")
    ledger.write_snapshot(ledger.ledger_snapshot(rows), str(tmp_path / "s"), 1)
    ledger.write_snapshot(ledger.ledger_snapshot(rows.where("mode = 'align'")), str(tmp_path / "s"), 2)
    assert ledger.read_snapshot(spark, str(tmp_path / "s")).count() == 1
    assert sorted((r["path"], r["searched"]) for r in ledger.read_snapshot(spark, str(tmp_path / "s"), 1).collect()) == [("/a/x.mp3", ["/a"]), ("/a/y.mp3", None)]
    with pytest.raises(AnalysisException):
        ledger.write_snapshot(rows, str(tmp_path / "s"), 2)


def test_broken_rows_are_set_aside(spark):
    raw = spark.createDataFrame([(1, '{"path": "a", "n": 1}'), (2, '{"path": "b"'), (3, ""), (4, None), (5, '{"n": 2}'), (6, '{"path": "c", "n": "x"}')], "line long, value string")
    rows, broken = ledger.ledger_quarantine(raw, "path STRING, n INT")
    assert sorted((r["line"], r["path"], r["n"]) for r in rows.collect()) == [(1, "a", 1)]
    assert sorted(r["line"] for r in broken.collect()) == [2, 3, 4, 5, 6]


def test_books_without_english_stop_the_load(spark):
    own = spark.createDataFrame([("Job", "en", "Job"), ("Ruth", "de", "Rut")], "book string, code string, label string")
    aliases = spark.createDataFrame([], "code string, lang string, rank int")
    with pytest.raises(ValueError, match="Ruth"):
        labels.load_gazetteer(own, aliases)
    assert labels.load_gazetteer(own, aliases, strict=False).count() == 2
