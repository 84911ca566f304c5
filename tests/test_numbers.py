import duckdb
from lectern.operators import numbers
from lectern.plans import number_queries


def test_whole_lexicon(spark):
    want = duckdb.connect().execute(f"WITH {number_queries._LEX} SELECT lang, value, words FROM lex").fetchall()
    got = numbers.number_lexicon(spark, "zh").unionByName(numbers.number_lexicon(spark, "hi")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    words = {(r.lang, r.value): r.words for r in got}
    assert [words["zh", v] for v in (0, 10, 19, 20, 105, 110, 1010, 1001, 9999)] == ["零", "十", "十九", "二十", "一百零五", "一百一十", "一千零一十", "一千零一", "九千九百九十九"]


def test_large_and_null(spark):
    df = spark.createDataFrame([(1, "a 10000 b 12", "zh"), (2, None, "zh"), (3, "", "hi"), (4, "99999999999999999999", "zh"), (5, "7", None)], "id long, text string, lang string")
    got = {r.id: (r.text, r.changed) for r in numbers.spell_numbers(df, numbers.number_lexicon(spark, "zh")).collect()}
    assert got == {1: ("a 10000 b 十二", True), 2: (None, False), 3: ("", False), 4: ("99999999999999999999", False), 5: ("7", False)}
