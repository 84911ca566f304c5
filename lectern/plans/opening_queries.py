"""Queries of lines in fixed words and of the way round the model that they take, with SQL made of the same parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations, opening_lines, restoring
from ..sources import fixtures as fx
from .building_blocks import collector

QUERIES, ORACLES = {}, {}
query = collector(QUERIES, ORACLES)

# how a line is said, by its form: {M} is the month's name, {m} its number, {d} the day
_EN = ["manna for {M} {d}th", "  MANNA for {M} {d}.\n Rejoice always ", "The text again: thou", "Text  again.", "The text again shows that", "Daily heavenly manna. Manna for {M} {d}, rest", "Daily Heavenly Manna!", "said {d}"]
_ZH = ["{m}月{d}日的玛纳。", "{m} 月 {d} 日妈哪，你们要喜乐", "再度一遍經文：神", "再读一遍经文", "再读一遍经文就是", "{d}"]
_AR = ["المن ليوم {d} {A}", "ألمنى، اليوم {d} {A}. افرحوا", "النص مجددًا: الرب", "النص {d}", "المن {A} {d}"]
_LI = "li AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS k FROM lineitem), x AS (SELECT concat_ws('-', o, k) AS id, o % 8 AS f, k % 5 AS p, o % 12 AS m, (o + 7 * k) % 34 AS d FROM li)"


def _made(spark, sf_dir):
    """id, source, target, text: a line in one of its forms, in one of five pairs of languages."""
    li = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k")).distinct()
    pick = lambda values, at: F.element_at(F.array(*[F.lit(x) for x in values]), (at + 1).cast("int"))
    f, p, m, d = F.col("o") % 8, F.col("k") % 5, F.col("o") % 12, (F.col("o") + 7 * F.col("k")) % 34
    t = F.when(p < 3, pick(_EN, f)).when(p == 3, pick(_ZH, f % len(_ZH))).otherwise(pick(_AR, f % len(_AR)))
    for name, value in (("{M}", pick(opening_lines.MONTHS["en"], m)), ("{A}", pick(opening_lines.MONTHS["ar"], m)), ("{m}", (m + 1).cast("string")), ("{d}", d.cast("string"))):
        t = F.replace(t, F.lit(name), value)
    pair = lambda values: pick(values, p)
    return li.select(F.concat_ws("-", F.col("o").cast("string"), F.col("k").cast("string")).alias("id"), pair(["en", "en", "en", "zh", "ar"]).alias("source"), pair(["zh", "he", "ar", "en", "en"]).alias("target"), t.alias("text"))


_EN_SAID = f"""CASE WHEN p = 0 THEN (m + 1) || '月' || d || '日的吗哪' WHEN p = 1 THEN 'מן ל-' || d || ' ב' || {opening_lines.MONTHS['he']!r}[m + 1] ELSE 'المنّ ليوم ' || d || ' ' || {opening_lines.MONTHS['ar']!r}[m + 1] END"""
_SAID = f"""
WITH {_LI}, t AS (SELECT *, {_EN_SAID} AS title, ['再读一遍经文', 'הטקסט שוב', 'النص مجددًا'][p + 1] AS again, ['。', '.', '.'][p + 1] AS stop, ['：', ': ', ': '][p + 1] AS colon, 'المنّ السماوي اليومي.' AS series, d BETWEEN 1 AND 31 AS ok, 'Manna for ' || {opening_lines.MONTHS['en']!r}[m + 1] || ' ' || d || '.' AS en FROM x),
r AS (SELECT *,
  CASE WHEN p < 3 THEN CASE WHEN f = 0 AND ok THEN title || stop WHEN f = 1 AND ok THEN title || colon WHEN f = 2 THEN again || colon WHEN f = 3 THEN again || trim(colon)
      WHEN f = 5 AND p = 2 THEN CASE WHEN ok THEN series || ' ' || title || colon ELSE series || ' ' END WHEN f = 6 AND p = 2 THEN series END
    WHEN p = 3 THEN CASE WHEN f % 6 = 0 AND ok THEN en WHEN f % 6 = 1 AND ok THEN en || ' ' WHEN f % 6 = 2 THEN 'The text again: ' WHEN f % 6 = 3 THEN 'The text again:' END
    ELSE CASE WHEN f % 5 = 0 AND ok THEN en WHEN f % 5 = 1 AND ok THEN en || ' ' WHEN f % 5 = 2 THEN 'The text again: ' END END AS rendered,
  CASE WHEN p < 3 THEN CASE f WHEN 1 THEN 'Rejoice always' WHEN 2 THEN 'thou' WHEN 5 THEN CASE WHEN ok THEN 'rest' ELSE 'Manna for ' || {opening_lines.MONTHS['en']!r}[m + 1] || ' ' || d || ', rest' END ELSE '' END
    WHEN p = 3 THEN CASE f % 6 WHEN 1 THEN '你们要喜乐' WHEN 2 THEN '神' ELSE '' END ELSE CASE f % 5 WHEN 1 THEN 'افرحوا' WHEN 2 THEN 'الرب' ELSE '' END END AS left_over FROM t)"""


@query(f"{_SAID} SELECT id, rendered, CASE WHEN rendered IS NOT NULL THEN left_over END AS rest FROM r")
def fixed_lines(spark, sf_dir):
    return opening_lines.fixed_lines(_made(spark, sf_dir)).select("id", "rendered", "rest")


def _upper(texts: list[str]) -> list[str]:
    return [t.upper() for t in texts]


@query(f"{_SAID} SELECT id, CASE WHEN left_over = '' THEN 'fixed' ELSE 'model' END AS route, rendered || upper(left_over) AS translated FROM r WHERE rendered IS NOT NULL")
def translate_opened(spark, sf_dir):
    cut = opening_lines.set_apart(_made(spark, sf_dir)).where("opened IS NOT NULL")
    spans = citations.find_citations(cut, citations.book_tokens(spark))
    return restoring.translate_segments(citations.mask_citations(cut, spans), _upper, "zh", opened="opened").select("id", "route", "translated")
