"""Lines in fixed words, spoken citations, scoring forms, chunks of prose and languages of files, on small rows."""

import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import forms, numbers, opening_lines, reading, segmenting
from lectern.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("source", "target", "said", "rendered", "rest"),
    [
        ("en", "zh", "Manna for January 20th.", "1月20日的吗哪。", ""),
        (None, "he", "manna for may 3, no", "מן ל-3 במאי: ", "no"),
        ("en", "he", "Manna for June 32", None, None),
        ("en", "he", "Manna for Juney 2", None, None),
        ("en", "ar", "Daily Heavenly Manna. Daily heavenly manna", "المنّ السماوي اليومي. المنّ السماوي اليومي.", ""),
        ("en", "ar", "Daily Heavenly Manna: The text again. x", "المنّ السماوي اليومي. النص مجددًا: ", "x"),
        ("en", "ar", "Daily Heavenly Manna, y", "المنّ السماوي اليومي. ", "y"),
        ("en", "ar", "Daily Heavenly Mannas", None, None),
        ("en", "he", "Daily Heavenly Manna.", None, None),
        ("en", "zh", "The text again", "再读一遍经文：", ""),
        ("en", "zh", "The text again shows", None, None),
        ("en", "es", "The text again.", None, None),
        ("zh", "en", "十二月三十一日的玛娜。你们", "Manna for December 31. ", "你们"),
        ("zh", "en", "二十月五日吗哪", None, None),
        ("zh", "he", "再读一遍经文", None, None),
        ("ar", "en", "المنو ليومي تسعة وعشرون يناير قال", "Manna for January 29. ", "قال"),
        ("ar", "en", "المن اليوم الخامسة يناير", None, None),
        ("ar", "en", "المن ليوم الستة والعشرون مايو", "Manna for May 26.", ""),
        ("ar", "en", "ألمن ليوم ٥ مايو", "Manna for May 5.", ""),
        ("ar", "en", "المن ليوم", None, None),
        ("en", "zh", None, None, None),
        ("en", None, "The text again", None, None),
        ("en", "zh", "", None, None),
    ],
)
def test_fixed_lines(spark, source, target, said, rendered, rest):
    df = spark.createDataFrame([(source, target, said)], "source string, target string, text string")
    assert tuple(opening_lines.fixed_lines(df).first()[-2:]) == (rendered, rest)


@pytest.mark.parametrize(
    ("lang", "books", "said", "out"),
    [
        ("zh", ["詩篇"], "詩篇 66:8,9-12 10:30", "詩篇 第66篇第8和第9至12节 10:30"),
        ("zh", ["雅各书"], "雅各书4.3。", "雅各书第4章第3节。"),
        ("ar", ["المزامير"], "المزامير 1:2,3,4", "المزامير، الإصحاح 1، الآيات 2 و3 و4"),
        ("he", ["תהילים"], "ל-1 בינואר, תהילים 1:2,3,4; ל-9 ביוני", "לראשון בינואר, תהילים, פרק א, פסוקים ב ג וד; ל-9 ביוני"),
        ("he", ["תהילים"], "תהילים 9:2", "תהילים 9:2"),
        ("hi", ["लूका"], "10:30 बजे लूका 4.3 5.6", "10:30 बजे लूका अध्याय 4, वचन 3 5.6"),
        ("es", ["Job"], "Job 1:2", "Job 1:2"),
        ("zh", [], "詩篇 66:8", "詩篇 66:8"),
        ("zh", ["詩篇"], None, None),
    ],
)
def test_speak_citations(spark, lang, books, said, out):
    df = spark.createDataFrame([(said,)], "text string")
    assert numbers.speak_citations(df, lang, books, dict(enumerate("אבגד", 1))).first()["said"] == out


def test_score_forms(spark):
    one = lambda t, lang, **k: forms.score_forms(spark.createDataFrame([(t,)], "text string"), lang, **k).first().asDict()
    assert one("祂读玛纳, a_1：她", "zh")["chars"] == "他读吗哪1他"
    assert one("祂读玛纳", "zh", raw=True)["chars"] == "他读玛纳"
    got = one("אֶל־שלום תודה רבה", "he", heard=True)
    assert got["words"] == ["אל", "שלומ"] and got["skeleton"] == "אלשלמ"
    assert one("תודה רבה", "he", heard=True)["words"] == [] and one("תודה רבה", "he")["words"] == ["תודה", "רבה"]
    assert one("ﻻ إِلٰهَ مدرسة", "ar")["words"] == ["لا", "اله", "مدرسه"]
    assert one(None, "ar")["letters"] == ""
    with pytest.raises(ValueError):
        one("x", "en")


def test_score_takes(spark):
    refs = spark.createDataFrame([(1, "天地人日月星火"), (2, "天地"), (3, None), (4, "不")], "doc_id long, text string")
    takes = spark.createDataFrame([(1, "a", "天"), (1, "b", "天地人日月星火谢谢"), (2, "a", "天他"), (3, "a", "多")], "doc_id long, take string, text string")
    got = {(r.take, r.doc_id): (r.edits, r.n, r.lost) for r in forms.score_takes(refs, takes, "zh", ["谢谢"]).collect()}
    assert got == {("a", 1): (6, 7, 6), ("b", 1): (0, 7, 0), ("a", 2): (1, 2, 0), ("a", 3): (1, 0, 0), ("a", None): (8, 9, 6), ("b", None): (0, 7, 0), (None, None): (8, 16, 6)}


def packed(units, length, budget, openers=()):
    """The packing, a unit at a time."""
    kept = []
    for u in units:
        if kept and re.search(r"[:：]\s*$", kept[-1]) and length[kept[-1]] + 1 + length[u] <= budget:
            both = f"{kept[-1]} {u}"
            length[both] = length[kept[-1]] + 1 + length[u]
            kept[-1] = both
        else:
            kept.append(u)
    out, size = [], 0
    for u in kept:
        if out and not u.startswith(tuple(openers)) and size + 1 + length[u] <= budget:
            out[-1], size = f"{out[-1]} {u}", size + 1 + length[u]
        else:
            out.append(u)
            size = length[u]
    return out


def test_chunks_from_prose_on_whole_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    split = docs.select("doc_id", text.sentences(docs.text).alias("s")).collect()
    spoken, units = {}, {}
    for r in docs.join(spark.createDataFrame(split), "doc_id").collect():
        lines = [x.strip() for x in (r.text or "").splitlines() if x.strip()]
        units[r.doc_id] = [re.sub(r"[ \t]+", " ", s) for s in (lines if len(lines) > 1 else r.s or [])]
    every = [(i, k, u) for i, us in units.items() for k, u in enumerate(us)]
    cut = segmenting.reading_clauses(spark.createDataFrame(every, "doc_id long, k long, text string").selectExpr("struct(doc_id, k) AS id", "text"), "id")
    clauses = {}
    for r in cut.orderBy("id", "clause").collect():
        clauses.setdefault((r.id.doc_id, r.id.k), []).append(r.text)
    texts = {u for _, _, u in every} | {c for cs in clauses.values() for c in cs}
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.spoken_length(F.col("t")).alias("n")).collect():
        spoken[r.t] = r.n
    got = {}
    for r in registry.QUERIES["chunks_from_prose"](spark, DATA).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.starts_paragraph == (r.chunk_id == 0)
    for i, us in units.items():
        parts = [c for k, u in enumerate(us) for c in ([u] if spoken[u] <= 300 else clauses[i, k])]
        assert got.get(i, []) == packed(parts, spoken, 300)


def test_pack_for_speech(spark):
    rows = [(1, 0, "Aa,  bb, cc."), (1, 1, "So:"), (1, 2, "dd."), (1, 3, "Again: x"), (1, 4, " "), (1, 5, "e" * 30), (2, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, sent int, text string")
    got = [r.text for r in segmenting.pack_for_speech(df, 10, ("Again",)).orderBy("chunk_id").collect()]
    assert got == ["Aa, bb,", "cc.", "So: dd.", "Again: x", "e" * 30]
    assert [r.text for r in segmenting.pack_for_speech(df.where("sent IN (1, 2, 3)"), 300, ("Again",)).orderBy("chunk_id").collect()] == ["So: dd.", "Again: x"]


def test_languages(spark):
    d = spark.createDataFrame([(1, "xx"), (2, None), (3, "de")], "id long, detected string")
    listed, none = spark.createDataFrame([("de",)], "lang string"), spark.createDataFrame([], "lang string")
    codes = lambda s: [r.source_code for r in reading.source_code(d, s).orderBy("id").collect()]
    assert codes(listed) == ["en", "en", "de"] and codes(none) == ["xx", "en", "de"]
    f = spark.createDataFrame([("a", "es fr", "fr,de"), ("b", None, None)], "path string, targets string, readings string")
    got = [tuple(r) for r in reading.fan_out_languages(f, none).orderBy("at").collect()]
    assert got == [("a", "es", 0, False, None), ("a", "fr", 1, True, None), ("a", "de", 2, False, "untranslated")]


def test_prose(spark):
    s = spark.createDataFrame([(1, 2, "three. Four"), (1, 1, " One. Two "), (1, 3, " "), (2, 1, None)], "doc_id long, seg_id long, text string")
    got = reading.prose_sentences(s)
    assert [(r.sent, r.text) for r in got.orderBy("sent").collect()] == [(0, "One."), (1, "Two three."), (2, "Four")]
    blank = reading.translate_prose(got, lambda ts: ["" for _ in ts])
    assert [r.body for r in blank.collect()] == [""]
