"""Labels by likeness, citations as they are said, tagged scripts, punctuation and replaced segments, on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import chinese_citations, labels, punctuation, repair, spoken_citations, tagged


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("least", [0.55, 0.65, 0.85])
def test_similar_labels_are_all_pairs(spark, least):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcאב") for _ in range(n))
    names = [word(r.randrange(1, 14)) for _ in range(60)]
    heard = [n[: r.randrange(len(n))] + word(r.randrange(3)) + n[r.randrange(len(n)) :] for n in names for _ in range(3)] + ["", None, "a"]
    got = labels.similar_labels(spark.createDataFrame([(h,) for h in heard], "phrase string"), spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "book string, label string"), least)
    expected = {(h, str(i)) for h in heard if h for i, n in enumerate(names) if 1 - distance(h, n) / max(len(h), len(n)) >= least - 1e-9}
    assert {(x["phrase"], x["book"]) for x in got.collect()} == expected


def test_number_words(spark):
    def read(lang, texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spoken_citations.read_number(F.split("t", " "), lang).alias("n"))
        return {r["t"]: tuple(r["n"]) if r["n"] else None for r in df.collect()}

    assert read("he", ["עשרים ושלושה", "שלוש עשרה פסוק", "3 עשר", "23, פסוק", "חמישה, ועשרים", "מאה", "מילה"]) == {"עשרים ושלושה": (23, 2), "שלוש עשרה פסוק": (13, 2), "3 עשר": (13, 2), "23, פסוק": (23, 1), "חמישה, ועשרים": (5, 1), "מאה": (100, 1), "מילה": None}
    assert read("ar", ["ثلاثة وعشرون", "خمسة عشر", "مئة و خمسون", "الثالثة", "12،", "عشرون ثلاثة"]) == {"ثلاثة وعشرون": (23, 2), "خمسة عشر": (15, 2), "مئة و خمسون": (150, 3), "الثالثة": None, "12،": (12, 1), "عشرون ثلاثة": (20, 1)}


NAMES = {
    "he": [("Genesis", "בראשית"), ("Psalms", "תהילים"), ("Romans", "האיגרת אל הרומאים"), ("Hebrews", "האיגרת אל העברים"), ("James", "איגרת יעקב")],
    "ar": [("Genesis", "سفر التكوين"), ("Psalms", "سفر المزامير"), ("Hebrews", "العبرانيين"), ("1 Peter", "بطرس الأولى")],
    "hi": [("1 Samuel", "1 शमूएल"), ("2 Samuel", "2 शमूएल"), ("Hebrews", "इब्रानियों"), ("Psalms", "भजन संहिता")],
}


@pytest.mark.parametrize(
    ("lang", "text", "found"),
    [
        ("he", "קראנו בראשית, פרק 3, פסוק 4. היום", [("בראשית, פרק 3, פסוק 4", "Genesis 3:4")]),
        ("he", " ההיגרת אל הרומאים פרק שנים עשר פסוקים שמונה ותשעה אמן", [("ההיגרת אל הרומאים פרק שנים עשר פסוקים שמונה ותשעה", "Romans 12:8,9")]),
        ("he", "תהילים ברק 23 פסוג אחת ואז איגרת יעקב פרק 1 פסוק 2", [("תהילים ברק 23 פסוג אחת", "Psalm 23:1"), ("איגרת יעקב פרק 1 פסוק 2", "James 1:2")]),
        ("he", "פרק 3, פסוק 4", []),
        ("ar", "قال العبرانيين الإصحاح الثاني", []),
        ("ar", "قال الأبرانيين الإسحاح 12 الآية ثلاثة وعشرون، ثم", [("الأبرانيين الإسحاح 12 الآية ثلاثة وعشرون", "Hebrews 12:23")]),
        ("ar", "صفر المزامير الإصحاح مئة و ثلاثة آية 5", [("صفر المزامير الإصحاح مئة و ثلاثة آية 5", "Psalm 103:5")]),
        ("hi", "पढ़ो इब्रानियों अध्याय 12, वचन 3।", [("इब्रानियों अध्याय 12, वचन 3", "Hebrews 12:3")]),
        ("hi", "एक शमूएल अध्याई बारा बचन साथ", [("एक शमूएल अध्याई बारा बचन साथ", "1 Samuel 12:7")]),
        ("hi", "शमूएल अध्याय 2 वचन 3", []),
    ],
)
def test_spoken_citations(spark, lang, text, found):
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    got = spoken_citations.spoken_citations(df, spark.createDataFrame(NAMES[lang], "book string, label string"), lang)
    assert [(text[r["begin"] : r["end"]], r["reference"]) for r in got.orderBy("begin").collect()] == found


def test_all_citations_keep_the_first_finder(spark):
    schema = "id long, begin int, end int, reference string"
    one, two = spark.createDataFrame([(1, 5, 10, "a"), (1, 20, 30, "b")], schema), spark.createDataFrame([(1, 0, 5, "c"), (1, 9, 12, "d"), (1, 10, 20, "e"), (1, 15, 40, "f"), (2, 5, 10, "g"), (1, 22, 24, "h")], schema)
    assert sorted(r["reference"] for r in spoken_citations.all_citations([one, two]).collect()) == ["a", "b", "c", "e", "g"]


def script(spark, text, **options):
    df = spark.createDataFrame([(1, text), (2, None), (3, "  ")], "doc_id long, text string")
    tags = tagged.style_tags(spark)
    chunks = [(r["text"], r["style"], r["starts_paragraph"]) for r in tagged.parse_tagged_script(df, tags, **options).orderBy("chunk_id").collect()]
    return chunks, sorted((r["token"], r["notice"]) for r in tagged.script_notices(df, tags, options.get("acts_on_sounds", False)).collect())


def test_tagged_script(spark):
    text = "One. [Calm] Two [laugh] more. [inaudible]\n\n[angry]Three.\n \nFour. [name of the speaker] [solemn]"
    assert script(spark, text) == ([("One.", "neutral", True), ("Two  more. [inaudible]", "calm", False), ("Three.", "emphatic", True), ("Four. [name of the speaker]", "emphatic", True)], [("angry", "alias"), ("inaudible", "unknown"), ("laugh", "removed"), ("solemn", "merged")])
    assert script(spark, "a [laugh] b", acts_on_sounds=True) == ([("a [laugh] b", "neutral", True)], [])
    assert script(spark, "\n\n[calm]\n\n", default="neutral") == ([], [])


def test_packed_script(spark):
    chunks, _ = script(spark, "[calm]First one here. Second one here. Third one here.\n\nNext.", budget=36)
    assert chunks == [("First one here. Second one here.", "calm", True), ("Third one here.", "calm", False), ("Next.", "calm", True)]


def words_of(spark, text):
    return spark.createDataFrame([(1, i, w, i // 3) for i, w in enumerate(text.split())], "doc_id long, pos long, word string, owner long")


def test_punctuation_labels(spark):
    w = words_of(spark, "so it was amiss james chapter four, verse three and then he went home! outside run")
    rng = "doc_id long, first long, last long"
    marks = spark.createDataFrame([(1, 2, ","), (1, 5, "."), (1, 9, "0"), (1, 11, "?"), (1, 13, ",")], "doc_id long, pos long, label string")
    got = punctuation.by_owner(punctuation.apply_punctuation_labels(w, marks, spark.createDataFrame([(1, 0, 13)], rng), spark.createDataFrame([(1, 4, 8)], rng)))
    assert " ".join(r["text"] for r in got.orderBy("owner").collect()) == "So it was, amiss. James chapter four verse three. And then he? Went home! outside run"
    broken = punctuation.apply_sentence_breaks(w, spark.createDataFrame([(1, 2), (1, 5), (1, 13)], "doc_id long, pos long"), spark.createDataFrame([(1, 0, 13)], rng), spark.createDataFrame([(1, 4, 8)], rng))
    assert " ".join(r["word"] for r in broken.orderBy("pos").collect()) == "so it was. amiss james chapter four, verse three and then he went home! outside run"


def test_spans_cover_words(spark):
    w = words_of(spark, "ab cde f ghij")
    spans = spark.createDataFrame([(1, 3, 8), (1, 1, 3), (1, 0, 1), (1, 7, 99), (2, 0, 5)], "doc_id long, begin long, end long")
    assert sorted(tuple(r)[1:] for r in punctuation.spans_cover_words(w, spans).collect()) == [(0, 1, 0, 0), (3, 8, 1, 2), (7, 99, 2, 3)]


def test_replaced_segments(spark):
    segments = spark.createDataFrame([(1, 1, 0.0, 20.0, "the text again"), (1, 2, 20.0, 40.0, "slow but right"), (1, 3, 41.0, 43.0, "fine here")], "doc_id long, seg_id long, start double, end double, text string")
    words = spark.createDataFrame([(1, 0.0, 1.0, "the"), (1, 19.9, 20.1, "again"), (1, 20.0, 21.0, "slow"), (1, 41.0, 42.0, "fine")], "doc_id long, start double, end double, word string")
    slow = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, seg_id long")
    c = [(1, 1, 1, 0, 0.0, 20.0, "the text"), (1, 1, 3, 0, 1.2, 5.0, "the text again"), (1, 1, 3, 1, 5.0, 20.0, "one two three four"), (1, 1, 2, 0, 0.0, 9.0, "five six seven eight"), (1, 2, 1, 0, 20.0, 40.0, "only two more words here")]
    out, left = repair.replace_slow_segments(segments, words, slow, spark.createDataFrame(c, "doc_id long, seg_id long, option int, piece long, start double, end double, text string"))
    got = [(r["seg_id"], round(r["start"], 1), round(r["end"], 1), r["text"]) for r in out.orderBy("at").collect()]
    assert got == [(1, 0.0, 9.0, "five six seven eight"), (1, 18.8, 20.0, "the text again"), (2, 20.0, 40.0, "slow but right"), (3, 41.0, 43.0, "fine here")]
    assert sorted(r["word"] for r in left.collect()) == ["fine", "slow"]
    none = repair.replace_slow_segments(segments, words, slow, spark.createDataFrame([], "doc_id long, seg_id long, option int, piece long, start double, end double, text string"))
    assert none[0].count() == 3 and none[1].count() == 4


def test_chinese_numbers(spark):
    words = {"十二": 12, "一百五十": 150, "23": 23, "二三": None, "二十三": 23, "〇": 0, "百": 100, "两百零一": None}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", chinese_citations.read_number(F.col("w")).alias("n"))
    assert {r["w"]: r["n"] for r in df.collect()} == words
    verses = {"第八和第九": "8,9", "十至十二": "10-12", "3节、5": "3,5", "二三": None}
    df = spark.createDataFrame([(w,) for w in verses], "w string").select("w", chinese_citations.read_verses(F.col("w")).alias("n"))
    assert {r["w"]: r["n"] for r in df.collect()} == verses


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("我们读《罗马书》第13章第12节。", [("《罗马书》第13章第12节", "Romans 13:12")]),
        ("满了,十篇第二十三篇", []),
        ("他说诗篇二十三篇第一节和希伯来书第十二章第三节", [("诗篇二十三篇第一节", "Psalm 23:1"), ("希伯来书第十二章第三节", "Hebrews 12:3")]),
        ("听摩太前书第2章5节", [("摩太前书第2章5节", "1 Timothy 2:5")]),
        ("无此书第2章第5节", []),
    ],
)
def test_chinese_citations(spark, text, found):
    names = [("Romans", "罗马书"), ("Psalms", "诗篇"), ("Hebrews", "希伯来书"), ("1 Timothy", "提摩太前书"), ("2 Timothy", "提摩太后书")]
    sounds = [(c, c) for _, n in names for c in n]
    df = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    got = chinese_citations.chinese_citations(df, spark.createDataFrame(names, "book string, label string"), spark.createDataFrame(sounds, "char string, sound string"))
    assert [(text[r["begin"] : r["end"]], r["reference"]) for r in got.orderBy("begin").collect()] == found
