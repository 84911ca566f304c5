"""Queries of citations as they are said. Their SQL builds the answer from how the sentences were made."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chinese_citations, citations, spoken_citations
from ..sources import fixtures as fx
from .building_blocks import collector

QUERIES, ORACLES = {}, {}
query = collector(QUERIES, ORACLES)

# Names of books, marker words, and the numbers from one to seven in words.
BOOKS = ["Genesis", "Exodus", "Numbers", "Joshua", "Job", "Psalms"]
NAMES = {
    "he": ["בראשית", "שמות", "במדבר", "יהושע", "איוב", "תהילים"],
    "ar": ["سفر التكوين", "سفر الخروج", "سفر العدد", "سفر يشوع", "سفر أيوب", "سفر المزامير"],
    "hi": ["उत्पत्ति", "निर्गमन", "गिनती", "यहोशू", "अय्यूब", "भजन संहिता"],
}
MARKERS = {"he": ("פרק", "פסוק"), "ar": ("الإصحاح", "الآية"), "hi": ("अध्याय", "वचन")}
NUMBERS = {
    "he": ["אחת", "שתיים", "שלוש", "ארבע", "חמש", "שש", "שבע"],
    "ar": ["واحد", "اثنان", "ثلاثة", "أربعة", "خمسة", "ستة", "سبعة"],
    "hi": ["एक", "दो", "तीन", "चार", "पाँच", "छह", "सात"],
}
BEFORE = {"he": "קראנו", "ar": "قال", "hi": "सुनो"}
_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def _made(lang: str) -> str:
    chapter, verse = MARKERS[lang]
    return f"""
li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
s AS (SELECT {_ID} AS id, ({BOOKS!r})[l_partkey % 6 + 1] AS book, ({NAMES[lang]!r})[l_partkey % 6 + 1] || ', {chapter} ' || (1 + l_suppkey % 150) || ', {verse} ' || CASE WHEN l_orderkey % 2 = 0 THEN ({NUMBERS[lang]!r})[l_linenumber] ELSE l_linenumber::VARCHAR END AS cite, 1 + l_suppkey % 150 AS c, l_linenumber AS v, l_orderkey % 5 AS form FROM li)"""


def _text(spark, sf_dir, lang):
    """id, text: sentences with a citation, the name missing in every fifth."""
    li = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    pick = lambda values, at: F.element_at(F.array(*[F.lit(x) for x in values]), at.cast("int"))
    name = F.when(F.col("l_orderkey") % 5 == 4, "qq").otherwise(pick(NAMES[lang], F.col("l_partkey") % 6 + 1))
    verse = F.when(F.col("l_orderkey") % 2 == 0, pick(NUMBERS[lang], F.col("l_linenumber"))).otherwise(F.col("l_linenumber").cast("string"))
    chapter, marker = MARKERS[lang]
    cite = F.concat(name, F.lit(f", {chapter} "), (1 + F.col("l_suppkey") % 150).cast("string"), F.lit(f", {marker} "), verse)
    key = F.concat_ws("-", *[F.col(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return li.select(key.alias("id"), F.concat(F.lit(BEFORE[lang] + " "), cite, F.lit(". cd")).alias("text"))


def _found(spark, sf_dir, lang):
    return spoken_citations.spoken_citations(_text(spark, sf_dir, lang), spark.createDataFrame(list(zip(BOOKS, NAMES[lang])), "book string, label string"), lang)


def _answer(lang: str) -> str:
    return f"""WITH {_made(lang)} SELECT id, {len(BEFORE[lang]) + 1} AS begin, {len(BEFORE[lang]) + 1} + length(cite) AS "end", replace(book, 'Psalms', 'Psalm') || ' ' || c || ':' || v AS reference FROM s WHERE form <> 4"""


@query(_answer("he"))
def citations_he(spark, sf_dir):
    return _found(spark, sf_dir, "he")


@query(_answer("ar"))
def citations_ar(spark, sf_dir):
    return _found(spark, sf_dir, "ar")


@query(_answer("hi"))
def citations_hi(spark, sf_dir):
    return _found(spark, sf_dir, "hi")


@query(f"""
WITH {_made("he")}, b AS (SELECT *, 'read ' || replace(book, 'Psalms', 'Psalm') || ' ' || c || ':' || v || ' {BEFORE["he"]} ' AS head FROM s)
SELECT id, 5 AS begin, length(head) - {len(BEFORE["he"]) + 2} AS "end", head[6:-{len(BEFORE["he"]) + 3}] AS reference FROM b
UNION ALL SELECT id, length(head), length(head) + length(cite), head[6:-{len(BEFORE["he"]) + 3}] FROM b WHERE form <> 4""")
def all_citations(spark, sf_dir):
    he = _text(spark, sf_dir, "he")
    li = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    key = F.concat_ws("-", *[F.col(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    book = F.replace(F.element_at(F.array(*[F.lit(b) for b in BOOKS]), (F.col("l_partkey") % 6 + 1).cast("int")), F.lit("Psalms"), F.lit("Psalm"))
    heads = li.select(key.alias("id"), F.concat(F.lit("read "), book, F.lit(" "), (1 + F.col("l_suppkey") % 150).cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"), F.lit(" ")).alias("head"))
    both = he.join(heads, "id").select("id", F.concat("head", "text").alias("text"))
    english = citations.find_citations(both, citations.book_tokens(spark)).withColumnRenamed("surface", "reference")
    hebrew = spoken_citations.spoken_citations(both, spark.createDataFrame(list(zip(BOOKS, NAMES["he"])), "book string, label string"), "he")
    return spoken_citations.all_citations([english, hebrew])


# Names, and the sounds of their characters and of some that are heard for them.
ZH_NAMES = ["创世记", "出埃及记", "民数记", "约书亚记", "约伯记", "诗篇"]
ZH_SOUNDS = "创chuang 世shi 记ji 计ji 出chu 埃ai 及ji 民min 数shu 约yue 书shu 亚ya 伯bo 博bo 诗shi 师shi 篇pian"


@query(f"""
WITH li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
s AS (SELECT {_ID} AS id, ({BOOKS!r})[l_partkey % 6 + 1] AS book, translate(({ZH_NAMES!r})[l_partkey % 6 + 1], '记伯诗', CASE WHEN l_orderkey % 2 = 0 THEN '计博师' ELSE '记伯诗' END) AS name, 1 + l_suppkey % 150 AS c, l_linenumber AS v, l_orderkey % 5 AS form FROM li),
x AS (SELECT *, name || '第' || c || '章第' || CASE form WHEN 0 THEN v || '节' WHEN 1 THEN v || '至' || (v + 2) || '节' ELSE ('一二三四五六七')[v] || '节' END AS cite FROM s)
SELECT id, 3 AS begin, 3 + length(cite) AS "end", replace(book, 'Psalms', 'Psalm') || ' ' || c || ':' || v || CASE form WHEN 1 THEN '-' || (v + 2) ELSE '' END AS reference FROM x WHERE form <> 4""")
def citations_zh(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    pick = lambda values, at: F.element_at(F.array(*[F.lit(x) for x in values]), at.cast("int"))
    form, v = F.col("l_orderkey") % 5, F.col("l_linenumber")
    name = pick(ZH_NAMES, F.col("l_partkey") % 6 + 1)
    name = F.when(form == 4, "无名").when(F.col("l_orderkey") % 2 == 0, F.translate(name, "记伯诗", "计博师")).otherwise(name)
    verse = F.when(form == 0, v.cast("string")).when(form == 1, F.concat(v.cast("string"), F.lit("至"), (v + 2).cast("string"))).otherwise(F.substr(F.lit("一二三四五六七"), v.cast("int"), F.lit(1)))
    key = F.concat_ws("-", *[F.col(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    df = li.select(key.alias("id"), F.concat(F.lit("我们读"), name, F.lit("第"), (1 + F.col("l_suppkey") % 150).cast("string"), F.lit("章第"), verse, F.lit("节。")).alias("text"))
    sounds = spark.createDataFrame([(x[0], x[1:]) for x in ZH_SOUNDS.split()], "char string, sound string")
    return chinese_citations.chinese_citations(df, spark.createDataFrame(list(zip(BOOKS, ZH_NAMES)), "book string, label string"), sounds)
