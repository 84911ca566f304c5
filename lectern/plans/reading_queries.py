"""Queries of prose, languages of files, spoken citations and scored takes. Their SQL builds the answer from how the
texts were made; that of chunks_from_prose would need look-around (see the tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, citations, forms, numbers, reading, scoring
from ..sources import fixtures as fx
from .alignment_queries import _SAID
from .building_blocks import _sentences, collector
from .oracles import _SEG

QUERIES, ORACLES = {}, {}
query = collector(QUERIES, ORACLES)


def _marked(texts: list[str]) -> list[str]:
    return ["" if len(t) % 4 == 0 else f" +{t} " for t in texts]


def _lines(spark, sf_dir, name="o", order="k"):
    return fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias(name), F.col("l_linenumber").alias(order)).distinct()


def _pick(values, at):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (at + 1).cast("int"))


_LI = "li AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS k FROM lineitem)"
_PROSE = f"WITH {_SAID}, l AS (SELECT doc_id, {_sentences('text')} AS l FROM said WHERE text <> '')"


@query(f"{_PROSE} SELECT doc_id, unnest(range(len(l))) AS sent, unnest(l) AS text FROM l")
def prose_sentences(spark, sf_dir):
    return reading.prose_sentences(fx.segments(spark, sf_dir))


@query(f"{_PROSE}, m AS (SELECT doc_id, list_filter(l, lambda x: length(x) % 4 <> 0) AS m FROM l) SELECT doc_id, coalesce(array_to_string(list_transform(m, lambda x: '+' || x), chr(10)) || CASE WHEN len(m) > 0 THEN chr(10) ELSE '' END, '') AS body FROM m")
def translate_prose(spark, sf_dir):
    return reading.translate_prose(reading.prose_sentences(fx.segments(spark, sf_dir)), _marked)


@query(f"WITH {_SEG} SELECT doc_id, seg_id AS chunk_id, role AS style, '+' || text AS text FROM segments WHERE length(text) % 4 <> 0")
def translate_chunks(spark, sf_dir):
    return reading.translate_chunks(fx.segments(spark, sf_dir).select("doc_id", F.col("seg_id").alias("chunk_id"), F.col("role").alias("style"), "text"), _marked)


@query(None)
def chunks_from_prose(spark, sf_dir):
    return reading.chunks_from_prose(fx.table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END WHEN doc_id % 7 = 0 OR lang NOT IN ('de', 'fr') THEN 'en' ELSE lang END AS source_code FROM documents WHERE lang IS NOT NULL")
def source_code(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("lang")).alias("detected"), (F.col("doc_id") % 5 > 0).alias("told"))
    return reading.source_code(d, spark.createDataFrame([("de",), ("fr",)], "lang string"), told="told").select("doc_id", "source_code")


@query("""
WITH f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['es', 'fr'] ELSE ['de'] END AS t, CASE doc_id % 3 WHEN 0 THEN ['fr'] WHEN 1 THEN []::VARCHAR[] ELSE ['de', 'es'] END AS r FROM documents),
a AS (SELECT *, list_concat(t, list_filter(r, lambda x: NOT list_contains(t, x))) AS l FROM f),
e AS (SELECT doc_id, t, r, unnest(l) AS lang, unnest(range(len(l))) AS "at" FROM a)
SELECT doc_id AS path, lang, "at", list_contains(r, lang) AND list_contains(t, lang) AND lang <> 'fr' AS read,
  CASE WHEN NOT list_contains(t, lang) THEN 'untranslated' WHEN list_contains(r, lang) AND lang = 'fr' THEN 'unspeakable' END AS refused FROM e""")
def fan_out_languages(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 2 == 0, "es, fr es").otherwise("de").alias("targets"), _pick(["fr", "", "de,es"], F.col("doc_id") % 3).alias("readings"))
    return reading.fan_out_languages(d, spark.createDataFrame([("de",), ("es",)], "lang string"))


_BOOKS, _NAMED = ["Hebrews", "I Timothy", "II Peter", "Job"], ["Hebrews", "1 Timothy", "2 Peter", "Job"]
_WORDS = [reading.UNITS[n] if n < 20 else reading.TENS[n // 10 - 2] + (f"-{reading.UNITS[n % 10]}" if n % 10 else "") for n in range(1, 61)]


@query(f"WITH {_LI} SELECT concat_ws('-', o, k) AS id, 4 AS begin, {_NAMED!r}[k % 4 + 1] || ' ' || (o % 60 + 1) || ':' || k AS citation FROM li")
def english_citation_list(spark, sf_dir):
    c, v, f = F.col("o") % 60, F.col("k").cast("string"), F.col("o") % 4
    said = F.when(f == 0, F.concat(F.lit(" chapter "), _pick(_WORDS, c), F.lit(", verse "), v)).when(f == 1, F.concat(F.lit(", Chapter "), _pick(_WORDS, c), F.lit(" verses "), _pick(_WORDS, F.col("k") - 1)))
    said = said.when(f == 2, F.concat(F.lit(", chapter "), (c + 1).cast("string"), F.lit(", verse "), v)).otherwise(F.concat(F.lit(" "), (c + 1).cast("string"), F.lit(":"), v))
    made = _lines(spark, sf_dir).select(F.concat_ws("-", F.col("o").cast("string"), F.col("k").cast("string")).alias("id"), F.concat(F.lit("See "), _pick(_BOOKS, F.col("k") % 4), said, F.lit(" too.")).alias("text"))
    return reading.english_citation_list(made, citations.book_tokens(spark))


_SPOKEN = {"zh": ["詩篇", "雅各书"], "he": ["תהילים", "באיגרת אל העברים"], "ar": ["المزامير", "العبرانيين"], "hi": ["भजन संहिता", "याकूब"]}
_KNOWN = _SPOKEN | {"he": ["תהילים", "האיגרת אל העברים"]}
_MASCULINE = "אחד שניים שלושה ארבעה חמישה שישה שבעה שמונה תשעה עשרה".split()
_SPEAK = f"""
WITH {_LI}, x AS (SELECT concat_ws('-', o, k) AS id, k % 4 AS p, o % 5 AS f, 1 + o % 12 AS c, k AS v, k + 1 AS w, o % 2 AS b, {list(_SPOKEN.values())!r}[k % 4 + 1][o % 2 + 1] AS book FROM li),
t AS (SELECT *, CASE f WHEN 1 THEN v || ',' || w WHEN 2 THEN v || '-' || w ELSE v || '' END AS verses, CASE WHEN f = 3 THEN 'z' ELSE book END AS name, CASE WHEN f = 4 THEN ' बजे' ELSE ' y' END AS after, {_MASCULINE!r} AS m FROM x),
u AS (SELECT *, 'x ' || name || ' ' || c || CASE WHEN f = 4 THEN '.' ELSE ':' END || verses || after AS text FROM t)"""


@query(f"""{_SPEAK}
SELECT id, CASE
  WHEN p = 0 AND f <> 3 THEN 'x ' || name || ' 第' || c || CASE WHEN b = 0 THEN '篇' ELSE '章' END || '第' || replace(replace(verses, ',', '和第'), '-', '至') || '节' || after
  WHEN p = 1 AND f NOT IN (2, 3) AND c <= 10 THEN 'x ' || name || ', פרק ' || m[c] || ', ' || CASE WHEN f = 1 THEN 'פסוקים ' || m[v] || ' ו' || m[w] ELSE 'פסוק ' || m[v] END || after
  WHEN p = 2 AND f NOT IN (2, 3) THEN 'x ' || name || '، الإصحاح ' || c || '، ' || CASE WHEN f = 1 THEN 'الآيتان ' || v || ' و' || w ELSE 'الآية ' || v END || after
  WHEN p = 3 AND f NOT IN (2, 4) THEN 'x ' || name || ' अध्याय ' || c || ', वचन ' || replace(verses, ',', ' और ') || after
  ELSE text END AS said FROM u""")
def speak_citations(spark, sf_dir):
    o, k = F.col("o"), F.col("k")
    f, n = o % 5, F.col("k").cast("string")
    verses = F.when(f == 1, F.concat_ws(",", n, (k + 1).cast("string"))).when(f == 2, F.concat_ws("-", n, (k + 1).cast("string"))).otherwise(n)
    out = None
    for p, (lang, names) in enumerate(_SPOKEN.items()):
        name = F.when(f == 3, "z").otherwise(_pick(names, o % 2))
        t = F.concat(F.lit("x "), name, F.lit(" "), (1 + o % 12).cast("string"), F.when(f == 4, ".").otherwise(":"), verses, F.when(f == 4, " बजे").otherwise(" y"))
        made = _lines(spark, sf_dir).where(k % 4 == p).select(F.concat_ws("-", o.cast("string"), n).alias("id"), t.alias("text"))
        said = numbers.speak_citations(made, lang, _KNOWN[lang], dict(enumerate(_MASCULINE, 1))).select("id", "said")
        out = said if out is None else out.unionByName(said)
    return out


# written, and its forms by figure
_HE = [("שָׁלוֹם", "שלומ", "שלמ", "שלמ", "שלומ"), ("שנים עשר", "שתימעשר", "שתמעשר", "שתמאשר", "שתימ עשר"), ("עשרה", "עשר", "עשר", "אשר", "עשר"), ("וּשלושה", "ושלוש", "ושלש", "ושלש", "ושלוש"), ("מים־קר!", "מימקר", "ממקר", "ממכר", "מימ קר")]


@query(f"WITH {_LI}, w AS (SELECT o, k, unnest({[dict(zip(('letters', 'skeleton', 'sound', 'words'), x[1:])) for x in _HE]!r}[(o + k) % 5 + 1:(o + k) % 5 + 1]) AS x FROM li) SELECT o AS id, string_agg(x.letters, '' ORDER BY k) AS letters, string_agg(x.skeleton, '' ORDER BY k) AS skeleton, string_agg(x.sound, '' ORDER BY k) AS sound, string_agg(x.words, ' ' ORDER BY k) AS words FROM w GROUP BY o")
def score_forms(spark, sf_dir):
    said = _pick([x[0] for x in _HE], (F.col("o") + F.col("k")) % 5)
    texts = _lines(spark, sf_dir).groupBy(F.col("o").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", said.alias("w")))), lambda x: x["w"]), " ").alias("text"))
    heard = texts.withColumn("text", F.concat("text", F.when(F.col("id") % 2 == 0, " תודה רבה. תודה רבה").otherwise("")))
    return forms.score_forms(heard, "he", heard=True).select("id", "letters", "skeleton", "sound", F.array_join("words", " ").alias("words"))


_SEVEN = "אבג דהו זחט יכל מנס עפצ קרש".split()


def _read(spark, sf_dir, change):
    """doc_id, words: an order's lines as words, changed."""
    word = change(F.col("k"), _pick(_SEVEN, F.col("k") - 1))
    listed = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("k", word.alias("w")))), lambda x: x["w"]), lambda w: w.isNotNull())
    return _lines(spark, sf_dir).groupBy(F.col("o").alias("doc_id")).agg(listed.alias("words"))


def _hole(k, w):
    return F.when(~k.between(2, 4), w)


@query(f"""
WITH {_LI}, c AS (SELECT o, count(*) AS n, count(*) FILTER (WHERE k = 2) AS two, count(*) FILTER (WHERE k BETWEEN 2 AND 4) AS cut FROM li GROUP BY o),
e AS (SELECT o AS id, n, two, cut, unnest(['words', 'letters', 'skeleton']) AS figure FROM c),
r AS (SELECT id, figure, unnest(['one', 'two']) AS take, CASE figure WHEN 'words' THEN n WHEN 'letters' THEN 3 * n ELSE 3 * n - two END AS n, CASE figure WHEN 'words' THEN two ELSE 3 * two END AS swapped, CASE figure WHEN 'words' THEN cut WHEN 'letters' THEN 3 * cut ELSE 3 * cut - two END AS cut, CASE WHEN figure = 'words' AND cut >= 3 THEN cut ELSE 0 END AS gone FROM e),
x AS (SELECT figure, take, id, n, CASE take WHEN 'one' THEN swapped ELSE cut END AS edits, CASE take WHEN 'one' THEN 0 ELSE gone END AS lost FROM r)
SELECT figure, take, id AS doc_id, sum(edits)::BIGINT AS edits, sum(n)::BIGINT AS n, round(sum(edits) / sum(n), 9) AS rate, sum(lost)::BIGINT AS lost FROM x GROUP BY GROUPING SETS ((figure, take, id), (figure, take), (figure))""")
def score_takes(spark, sf_dir):
    plain = lambda df: df.withColumn("text", F.array_join("words", " ")).drop("words")
    one = plain(_read(spark, sf_dir, lambda k, w: F.when(k == 2, "תתת").otherwise(w))).withColumn("take", F.lit("one"))
    two = plain(_read(spark, sf_dir, _hole)).withColumn("take", F.lit("two"))
    scored = forms.score_takes(plain(_read(spark, sf_dir, lambda k, w: w)), one.unionByName(two), "he")
    return scored.where("figure <> 'sound'").withColumn("rate", F.round("rate", 9))


_CUT = f"WITH {_LI}, r AS (SELECT o AS id, string_agg({_SEVEN!r}[k], ' ' ORDER BY k) AS part FROM li WHERE k BETWEEN 2 AND 4 GROUP BY o HAVING count(*) > 1)"


def _regions(spark, sf_dir, spoken, heard):
    a, b = _read(spark, sf_dir, spoken).withColumnRenamed("words", "ref"), _read(spark, sf_dir, heard).withColumnRenamed("words", "hyp")
    return alignment.edit_regions(a.join(b, "doc_id").withColumnRenamed("doc_id", "id"))


@query(f"{_CUT} SELECT id, part AS spoken FROM r")
def missing_text(spark, sf_dir):
    return scoring.added_or_missing(_regions(spark, sf_dir, lambda k, w: w, _hole), 6, "missing").select("id", "spoken")


@query(f"{_CUT} SELECT id, part AS heard FROM r")
def added_text(spark, sf_dir):
    return scoring.added_or_missing(_regions(spark, sf_dir, _hole, lambda k, w: w), 6, "added").select("id", "heard")
