"""Queries of restored citations, routes round the model, gazetteers and the ledger's snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations, labels, ledger, restoring
from ..sources import fixtures as fx
from .building_blocks import collector
from .citation_queries import _MADE

QUERIES, ORACLES = {}, {}
query = collector(QUERIES, ORACLES)


def _upper(texts: list[str]) -> list[str]:
    return [t.upper() for t in texts]


@query(f"""
WITH {_MADE}
SELECT id, CASE WHEN id LIKE '%7' THEN 'blank' WHEN id LIKE '%3' AND found THEN 'citation' ELSE 'model' END AS route,
  CASE WHEN id LIKE '%7' THEN '  ' WHEN id LIKE '%3' THEN CASE WHEN found THEN cite || '.' ELSE upper(cite || '.') END ELSE CASE WHEN found THEN 'READ ' || cite || ' AGAIN' ELSE upper('read ' || cite || ' again') END END AS translated
FROM s""")
def translate_segments(spark, sf_dir):
    cite = F.regexp_extract("text", "^read (.*) again$", 1)
    sentences = fx.citation_text(spark, sf_dir).select("id", F.when(F.col("id").like("%7"), "  ").when(F.col("id").like("%3"), F.concat(cite, F.lit("."))).otherwise(F.col("text")).alias("text"))
    spans = citations.find_citations(sentences, citations.book_tokens(spark))
    return restoring.translate_segments(citations.mask_citations(sentences, spans), _upper, "en").select("id", "route", "translated")


_RU = """
li AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS k FROM lineitem),
w AS (SELECT concat_ws('-', o, k) AS id, o % 5 AS form, o % 2 = 0 AS stop, k % 3 AS n, ['Книга Иова', 'Первая книга Царств', '1-е послание Петра'][k % 3 + 1] AS name FROM li),
f AS (SELECT *, ['Книгу Иова', 'Первую книгу Царств', '1-е послание Петра'][n + 1] AS acc, ['Книгой Иова', 'Первой книгой Царств', '1-м посланием Петра'][n + 1] AS ins, ['Книги Иова', 'Первой книги Царств', '1-го послания Петра'][n + 1] AS gen, ['Книге Иова', 'Первой книге Царств', '1-м послании Петра'][n + 1] AS prep FROM w)"""


@query(f"""
WITH {_RU}
SELECT id, CASE form WHEN 0 THEN 'Сравнить ' || acc || ' с ' || ins WHEN 1 THEN 'Читайте ' || acc WHEN 2 THEN 'Это ' || name || ' и после ' || gen WHEN 3 THEN 'Откройте свою Библию на ' || prep ELSE 'Слава за ' || acc END
  || CASE WHEN stop THEN '!' ELSE '' END AS restored FROM f""")
def inflect_by_context(spark, sf_dir):
    return _restored(spark, sf_dir, "ru", ["Сравнить @0@ с @1@", "Читайте @0@", "Это @0@ и после @1@", "Откройте свою Библию на @0@", "Слава за @0@"], ["Книга Иова", "Первая книга Царств", "1-е послание Петра"])


@query("""
WITH li AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS k FROM lineitem)
SELECT concat_ws('-', o, k) AS id, CASE o % 5
  WHEN 0 THEN 'ראו ב' || CASE k % 3 WHEN 0 THEN 'תהילים' WHEN 1 THEN 'איגרת אל העברים' ELSE '-Psalm' END
  WHEN 1 THEN 'וב' || CASE k % 3 WHEN 0 THEN 'תהילים' WHEN 1 THEN 'איגרת אל העברים' ELSE '-Psalm' END || ' היום'
  WHEN 2 THEN 'של ' || ['תהילים', 'האיגרת אל העברים', 'Psalm'][k % 3 + 1]
  WHEN 3 THEN 'ו' || CASE k % 3 WHEN 0 THEN 'תהילים' WHEN 1 THEN 'האיגרת אל העברים' ELSE '-Psalm' END
  ELSE ['תהילים', 'האיגרת אל העברים', 'Psalm'][k % 3 + 1] END || CASE WHEN o % 2 = 0 AND o % 5 <> 1 THEN '!' ELSE '' END AS restored FROM li""")
def fit_hebrew_prefix(spark, sf_dir):
    return _restored(spark, sf_dir, "he", ["ראו ב @0@", "וב @0@ היום", "של @0@", "ו ＠0＠", "@0@"], ["תהילים", "האיגרת אל העברים", "Psalm"])


def _restored(spark, sf_dir, lang, forms, names):
    li = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k")).distinct()
    pick = lambda values, at: F.element_at(F.array(*[F.lit(x) for x in values]), (at + 1).cast("int"))
    name = pick(names, F.col("k") % 3)
    translated = pick(forms, F.col("o") % 5)
    source = F.concat(F.lit("compare @0@ and @1@"), F.when(F.col("o") % 2 == 0, "!").otherwise(""))
    refs = F.when(F.contains(translated, F.lit("@1@")), F.array(name, name)).otherwise(F.array(name))
    return li.select(F.concat_ws("-", F.col("o").cast("string"), F.col("k").cast("string")).alias("id"), restoring.unprotect(source, translated, refs, lang).alias("restored"))


@query("""
WITH n AS (SELECT n_name AS book, n_nationkey AS k FROM nation),
l AS (SELECT book, 'en' AS code, lower(book) AS label FROM n UNION ALL SELECT book, 'nb', book || ' nb' FROM n WHERE k % 2 = 0 UNION ALL SELECT book, 'nn', book || ' nn' FROM n WHERE k % 3 = 0 UNION ALL SELECT book, 'ru', CASE WHEN k % 5 = 0 THEN ' ' ELSE book || ' ru' END FROM n),
s AS (SELECT book, lang, book || ' more' AS label FROM n, (VALUES ('no'), ('ru'), ('en')) v(lang) WHERE k % 7 <> 3)
SELECT book, lang, label, 'table' AS origin FROM (
  SELECT book, CASE code WHEN 'nb' THEN 'no' WHEN 'nn' THEN 'no' ELSE code END AS lang, label FROM l WHERE trim(label) <> '' QUALIFY row_number() OVER (PARTITION BY book, lang ORDER BY code) = 1)
UNION ALL SELECT book, lang, label, 'supplement' FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.book = s.book AND CASE code WHEN 'nb' THEN 'no' WHEN 'nn' THEN 'no' ELSE code END = s.lang AND trim(l.label) <> '')""")
def load_gazetteer(spark, sf_dir):
    n = fx.table(spark, sf_dir, "nation").select(F.col("n_name").alias("book"), F.col("n_nationkey").alias("k"))
    label = lambda code, text, keep="true": n.where(keep).select("book", F.lit(code).alias("code"), text.alias("label"))
    own = label("en", F.lower("book")).unionByName(label("nb", F.concat("book", F.lit(" nb")), "k % 2 = 0")).unionByName(label("nn", F.concat("book", F.lit(" nn")), "k % 3 = 0"))
    own = own.unionByName(label("ru", F.when(F.col("k") % 5 == 0, " ").otherwise(F.concat("book", F.lit(" ru")))))
    aliases = spark.createDataFrame([("nb", "no", 1), ("nn", "no", 2)], "code string, lang string, rank int")
    more = n.where("k % 7 <> 3").select("book", F.explode(F.array(*[F.lit(x) for x in ("no", "ru", "en")])).alias("lang"), F.concat("book", F.lit(" more")).alias("label"))
    return labels.load_gazetteer(own, aliases, more)


@query("""
SELECT event_id AS id, CASE WHEN event_id % 7 = 3 OR event_id % 11 = 5 THEN NULL ELSE 'f' || user_id END AS path, event_id % 7 = 3 OR event_id % 11 = 5 AS broken FROM events""")
def ledger_quarantine(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("status"))
    body = F.to_json(F.struct(F.when(F.col("id") % 11 != 5, F.col("path")).alias("path"), "status"))
    raw = e.select("id", F.when(F.col("id") % 7 == 3, F.substring(body, 1, 12)).otherwise(body).alias("value"))
    rows, broken = ledger.ledger_quarantine(raw, "path STRING, status STRING")
    return rows.select("id", "path", F.lit(False).alias("broken")).unionByName(broken.select("id", F.lit(None).cast("string").alias("path"), F.lit(True).alias("broken")))


@query("""
WITH s AS (SELECT doc_id, '/src/' || source || '/' || lang AS dir, doc_id % 3 AS m FROM documents)
SELECT doc_id, CASE WHEN m = 0 THEN 'undecided' ELSE 'transcribe' END AS mode, CASE WHEN m = 0 THEN dir || '|/texts' END AS searched FROM s""")
def ledger_snapshot(spark, sf_dir):
    state = fx.files(spark, sf_dir).select("doc_id", "path", F.when(F.col("doc_id") % 3 == 0, "undecided").otherwise("transcribe").alias("mode"))
    return ledger.ledger_snapshot(state, "/texts").select("doc_id", "mode", F.array_join("searched", "|").alias("searched"))
