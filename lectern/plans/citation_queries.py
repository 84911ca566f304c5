"""Queries of the citation operators. Their SQL builds the answer from how the sentences were made."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import citations
from ..sources import fixtures as fx
from .building_blocks import collector

QUERIES, ORACLES = {}, {}
query = collector(QUERIES, ORACLES)

_NAMES = [line.split(":")[0] for line in rules.BOOKS.strip().splitlines()]
_MADE = f"""
li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
b AS (SELECT *, ({_NAMES!r})[l_partkey % {len(_NAMES)} + 1] AS book, 1 + l_suppkey % 150 AS c, l_linenumber AS v, l_orderkey % 5 AS form FROM li),
x AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, book, c, v, form, CASE form WHEN 0 THEN book || ' ' || c || ':' || v WHEN 1 THEN book || ' ' || c || '.' || v WHEN 2 THEN book || ', chapter ' || c || ', verse ' || v WHEN 3 THEN book || ' ' || c || ', verses ' || v || ' and ' || (v + 1) ELSE 'Section ' || c || ', verse ' || v END AS cite FROM b),
s AS (SELECT *, form < 4 AND book <> 'Song of Solomon' AS found, c || ':' || v || CASE WHEN form = 3 THEN ',' || (v + 1) ELSE '' END AS numbers FROM x)
"""


def _found(spark, sf_dir):
    sentences = fx.citation_text(spark, sf_dir)
    return sentences, citations.find_citations(sentences, citations.book_tokens(spark))


@query(f'WITH {_MADE} SELECT id, 5 AS begin, 5 + length(cite) AS "end", cite AS surface FROM s WHERE found')
def find_citations(spark, sf_dir):
    return _found(spark, sf_dir)[1]


@query(f"WITH {_MADE} SELECT id, book, numbers FROM s WHERE found")
def name_citations(spark, sf_dir):
    return citations.name_citations(_found(spark, sf_dir)[1], citations.book_tokens(spark)).select("id", "book", "numbers")


@query(f"WITH {_MADE} SELECT id, CASE WHEN (list_position({_NAMES!r}, book) - 1) % 60 <> 1 THEN book || '_de ' || numbers END AS local FROM s WHERE found")
def localize_citations(spark, sf_dir):
    named = citations.name_citations(_found(spark, sf_dir)[1], citations.book_tokens(spark))
    return citations.localize_citations(named, fx.book_labels(spark), "de").select("id", "local")


@query(f"WITH {_MADE} SELECT id, CASE WHEN found THEN 'read @0@ again' ELSE 'read ' || cite || ' again' END AS masked, CASE WHEN found THEN cite ELSE '' END AS refs, false AS only FROM s")
def mask_citations(spark, sf_dir):
    m = citations.mask_citations(*_found(spark, sf_dir))
    return m.select("id", "masked", F.array_join("refs", "|").alias("refs"), citations.is_only_citation(F.col("masked"), F.col("refs")).alias("only"))


@query(f"WITH {_MADE} SELECT id, CASE WHEN NOT found THEN 'read ' || cite || ' again' WHEN id LIKE '%1' THEN 'read  again ' || cite ELSE 'read ' || cite || ' again' END AS restored FROM s")
def restore_citations(spark, sf_dir):
    m = citations.mask_citations(*_found(spark, sf_dir))
    back = F.when(F.col("id").like("%1"), F.replace("masked", F.lit("@0@"), F.lit(""))).otherwise(F.replace("masked", F.lit("@0@"), F.lit("＠ 0@")))
    return m.select("id", citations.restore_citations(back, F.col("refs")).alias("restored"))


@query("""
WITH c AS (SELECT l_orderkey AS id, l_partkey % 97 AS b, l_partkey % 97 + floor(l_quantity)::BIGINT % 9 + 1 AS e FROM lineitem),
o AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY b, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c),
g AS (SELECT *, sum(CASE WHEN b < m THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY b, e DESC ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT id, min(b) AS begin, max(e) AS "end" FROM g GROUP BY id, g""")
def merge_spans(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    begin = F.col("l_partkey") % 97
    return citations.merge_spans(li.select(F.col("l_orderkey").alias("id"), begin.alias("begin"), (begin + F.floor("l_quantity") % 9 + 1).alias("end")))
