"""Queries of number words, with SQL that builds the words by cases."""

from __future__ import annotations

from ..functions import rules
from ..operators import numbers
from ..sources import fixtures as fx
from .building_blocks import collector

QUERIES, ORACLES = {}, {}
query = collector(QUERIES, ORACLES)

_D = f"'{rules.ZH_DIGITS}'"
_LEX = f"""
n AS (SELECT value, value // 1000 AS t, value // 100 % 10 AS h, value // 10 % 10 AS z, value % 10 AS o, value % 100 AS r FROM (SELECT unnest(range(10000)) AS value)),
zh AS (SELECT value, CASE WHEN value = 0 THEN '零' WHEN value BETWEEN 10 AND 19 THEN '十' || CASE WHEN o > 0 THEN {_D}[o + 1] ELSE '' END ELSE
 CASE WHEN t > 0 THEN {_D}[t + 1] || '千' ELSE '' END || CASE WHEN h > 0 THEN {_D}[h + 1] || '百' WHEN t > 0 AND r > 0 THEN '零' ELSE '' END ||
 CASE WHEN z > 0 THEN {_D}[z + 1] || '十' WHEN h > 0 AND o > 0 THEN '零' ELSE '' END || CASE WHEN o > 0 THEN {_D}[o + 1] ELSE '' END END AS words FROM n),
hi AS (SELECT value, concat_ws(' ', CASE WHEN t > 0 THEN l[t + 1] || ' {rules.HI_THOUSAND}' END, CASE WHEN h > 0 THEN l[h + 1] || ' {rules.HI_HUNDRED}' END, CASE WHEN r > 0 OR value = 0 THEN l[r + 1] END) AS words FROM n, (SELECT {rules.HI_UNDER_100!r} AS l)),
lex AS (SELECT 'zh' AS lang, * FROM zh UNION ALL SELECT 'hi', * FROM hi)
"""


@query(f"""
WITH {_LEX}, li AS (SELECT DISTINCT l_partkey AS p, l_linenumber AS l, ['zh', 'hi', 'xx'][l_partkey % 3 + 1] AS lang FROM lineitem)
SELECT p || '-' || l AS id, 'room ' || coalesce(a.words, p::VARCHAR) || ' and ' || coalesce(b.words, l::VARCHAR) AS text, a.words IS NOT NULL OR b.words IS NOT NULL AS changed
FROM li LEFT JOIN lex a ON a.lang = li.lang AND a.value = p LEFT JOIN lex b ON b.lang = li.lang AND b.value = l""")
def spell_numbers(spark, sf_dir):
    lexicon = numbers.number_lexicon(spark, "zh").unionByName(numbers.number_lexicon(spark, "hi"))
    return numbers.spell_numbers(fx.digits_text(spark, sf_dir), lexicon)
