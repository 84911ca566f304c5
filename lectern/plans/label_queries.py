"""Queries of labels by likeness and sound, tagged scripts, punctuation labels and replaced segments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import labels, punctuation, repair, segmenting, tagged
from ..sources import fixtures as fx
from .building_blocks import _SCRIPT, collector
from .oracles import _SEG, _WORDS, _words

QUERIES, ORACLES = {}, {}
query = collector(QUERIES, ORACLES)

_NAMES = [line.split(":")[0].lower() for line in rules.BOOKS.strip().splitlines()]
_HEARD = f"""
l AS (SELECT unnest({_NAMES!r}) AS book),
li AS (SELECT DISTINCT l_partkey, l_suppkey, l_linenumber FROM lineitem),
n AS (SELECT concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS id, ({_NAMES!r})[l_partkey % {len(_NAMES)} + 1] AS name, l_suppkey % 4 AS how, l_linenumber AS k FROM li),
h AS (SELECT id, CASE how WHEN 0 THEN name WHEN 1 THEN left(name, k) || substr(name, k + 2) WHEN 2 THEN left(name, k) || 'x' || substr(name, k + 2) ELSE substr(name, 2) || 'o' END AS heard FROM n),
c AS (SELECT id, 1 AS length, heard AS phrase FROM h UNION ALL SELECT id, 2, 'the ' || heard FROM h)"""


def _heard(spark, sf_dir):
    """id, length, phrase: names of books with edits, alone and with a word before them."""
    li = fx.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber").distinct()
    books = fx.books(spark).select("ord", F.lower("book").alias("name"))
    k, how = F.col("l_linenumber").cast("int"), F.col("l_suppkey") % 4
    n = li.join(books, F.col("l_partkey") % len(_NAMES) == F.col("ord"))
    rest = F.substr("name", k + 2)
    head = F.substr("name", F.lit(1), k)
    heard = F.when(how == 0, F.col("name")).when(how == 1, F.concat(head, rest)).when(how == 2, F.concat(head, F.lit("x"), rest)).otherwise(F.concat(F.substr("name", F.lit(2)), F.lit("o")))
    h = n.select(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")]).alias("id"), heard.alias("heard"))
    return h.select("id", F.explode(F.array(F.struct(F.lit(1).alias("length"), F.col("heard").alias("phrase")), F.struct(F.lit(2).alias("length"), F.concat(F.lit("the "), "heard").alias("phrase")))).alias("c")).select("id", "c.*")


@query(f"""
WITH {_HEARD},
s AS (SELECT phrase, book, 1 - levenshtein(phrase, book)::DOUBLE / greatest(length(phrase), length(book)) AS score FROM (SELECT DISTINCT phrase FROM c WHERE phrase <> ''), l),
r AS (SELECT *, row_number() OVER w AS place, coalesce(lead(score) OVER w, 0) AS next FROM s WHERE score >= 0.55 - 1e-9 WINDOW w AS (PARTITION BY phrase ORDER BY score DESC, book DESC)),
t AS (SELECT id, length, book, score, score >= 0.85 - 1e-9 OR (score >= 0.65 - 1e-9 AND score - next >= 0.1 - 1e-9) AS clear FROM c JOIN r USING (phrase) WHERE place = 1),
b AS (SELECT *, first_value(book) OVER (PARTITION BY id ORDER BY score DESC, book DESC, length DESC) AS named FROM t)
SELECT id, book, length, round(score, 9) AS score FROM b WHERE clear AND book = named
QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, length DESC) = 1""")
def fuzzy_label_match(spark, sf_dir):
    names = fx.books(spark).select(F.lower("book").alias("book"), F.lower("book").alias("label"))
    return labels.fuzzy_label_match(_heard(spark, sf_dir), names).withColumn("score", F.round("score", 9))


_SOUNDS = """
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id AS book, w[1:2 + doc_id % 7] AS sounds FROM d WHERE len(w) > 0 AND doc_id % 3 = 0),
p AS (SELECT doc_id AS id, w[1 + doc_id % 2:7] AS sounds FROM d WHERE len(w) > 0)"""
_ENDS = """e AS (SELECT book, array_to_string(sounds[-n:], ' ') AS ending, n AS length FROM (SELECT book, sounds, unnest(range(3, least(len(sounds), 7) + 1)) AS n FROM l)),
u AS (SELECT ending, length, min(book) AS book FROM e GROUP BY ending, length HAVING count(DISTINCT book) = 1)"""


def _sounds(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "").alias("w")).where("size(w) > 0")
    own = d.where("doc_id % 3 = 0").selectExpr("doc_id AS book", "slice(w, 1, cast(2 + doc_id % 7 as int)) AS sounds")
    return own, d.selectExpr("doc_id AS id", "slice(w, cast(1 + doc_id % 2 as int), cast(7 - doc_id % 2 as int)) AS sounds")


@query(f"WITH {_SOUNDS}, {_ENDS} SELECT ending, book, length FROM u")
def unique_endings(spark, sf_dir):
    return labels.unique_endings(_sounds(spark, sf_dir)[0])


@query(f"""
WITH {_SOUNDS}, {_ENDS},
i AS (SELECT array_to_string(sounds, ' ') AS ending, len(sounds) AS length, max(book) AS book, 1 AS whole FROM l WHERE len(sounds) BETWEEN 2 AND 8 GROUP BY ALL UNION ALL SELECT ending, length, book, 0 FROM u),
f AS (SELECT id, array_to_string(sounds[-n:], ' ') AS ending, n AS length FROM (SELECT id, sounds, unnest(range(2, least(len(sounds), 8) + 1)) AS n FROM p))
SELECT id, book, length FROM f JOIN i USING (ending, length) QUALIFY row_number() OVER (PARTITION BY id ORDER BY whole DESC, length DESC, book DESC) = 1""")
def label_by_sound(spark, sf_dir):
    own, phrases = _sounds(spark, sf_dir)
    return labels.label_by_sound(phrases, own)


_KNOWN = [*rules.STYLES, *rules.MERGED_STYLES, *rules.STYLE_ALIASES, *rules.SOUND_TAGS]
_TO = {s: s for s in rules.STYLES} | rules.MERGED_STYLES | rules.STYLE_ALIASES
_TAGS = f"""
{_SCRIPT},
cut AS (SELECT doc_id, string_split(regexp_replace(text, '(\\[[A-Za-z][A-Za-z0-9_-]*\\])', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM script),
pc AS (SELECT doc_id, unnest(range(len(p))) AS place, unnest(p) AS piece FROM cut),
tok AS (SELECT *, CASE WHEN place % 2 = 1 THEN lower(replace(replace(piece, '[', ''), ']', '')) END AS token FROM pc),
st AS (SELECT *, map({list(_TO)!r}, {list(_TO.values())!r})[token] AS style FROM tok)"""


@query(rf"""
WITH {_TAGS},
r AS (SELECT *, count(style) OVER w AS run, coalesce(last_value(style IGNORE NULLS) OVER w, 'neutral') AS held FROM st WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
b AS (SELECT doc_id, run, held, string_split_regex(string_agg(CASE WHEN style IS NOT NULL OR token IN {tuple(rules.SOUND_TAGS)!r} THEN '' ELSE piece END, '' ORDER BY place), '\n[ \t]*\n') AS blocks FROM r GROUP BY doc_id, run, held),
k AS (SELECT doc_id, run, held, unnest(range(len(blocks))) AS k, regexp_replace(unnest(blocks), '^\s+|\s+$', '', 'g') AS text FROM b),
n AS (SELECT *, sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY run, k ROWS UNBOUNDED PRECEDING) AS breaks FROM k),
f AS (SELECT *, lag(breaks) OVER o AS before, row_number() OVER o - 1 AS chunk_id FROM n WHERE text <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY run, k))
SELECT doc_id, chunk_id, text, held AS style, before IS NULL OR breaks > before AS starts_paragraph FROM f""")
def parse_tagged_script(spark, sf_dir):
    return tagged.parse_tagged_script(fx.script(spark, sf_dir), tagged.style_tags(spark), budget=None)


@query(f"""
WITH {_TAGS}
SELECT doc_id, token, CASE WHEN token IN {tuple(rules.MERGED_STYLES)!r} THEN 'merged' WHEN token IN {tuple(rules.STYLE_ALIASES)!r} THEN 'alias' WHEN token IN {tuple(rules.SOUND_TAGS)!r} THEN 'removed' ELSE 'unknown' END AS notice, any_value(style) AS style, count(*) AS times
FROM st WHERE token IS NOT NULL AND token NOT IN {tuple(rules.STYLES)!r} GROUP BY doc_id, token""")
def script_notices(spark, sf_dir):
    return tagged.script_notices(fx.script(spark, sf_dir), tagged.style_tags(spark))


@query(f"""
SELECT event_id AS id, coalesce(map({list(_TO)!r}, {list(_TO.values())!r})[event_type], 'neutral') AS resolved, CASE WHEN event_type IN {tuple(_TO)!r} THEN NULL ELSE 'unknown' END AS notice FROM events""")
def resolve_style(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("style"))
    return tagged.resolve_style(e, tagged.style_tags(spark)).select("id", "resolved", "notice")


_TRAIL, _BARE = "'[.,!?:;…-]+$'", "coalesce(nullif(regexp_replace(word, '[.,!?:;…-]+$', ''), ''), word)"
_RUNS = rf"""
{_WORDS},
en AS (SELECT *, regexp_matches(word, '[.!?…]["''”’)\]]*$') AS ends FROM words),
rn AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, len(regexp_replace(word, '[^,;:]', '', 'g')) AS mk FROM en),
ru AS (SELECT doc_id, run, min(pos) AS first, max(pos) AS last FROM rn GROUP BY doc_id, run HAVING count(*) >= 40 AND (sum(mk) - arg_max(mk, pos)) * 40 < count(*)),
sp AS (SELECT doc_id, pos AS sf, pos + 3 AS sl FROM words WHERE pos % 50 = 20),
wr AS (
  SELECT rn.doc_id, pos, word, first, last, CASE WHEN sf >= first AND sl <= last THEN sf END AS sf, CASE WHEN sf >= first AND sl <= last THEN sl END AS sl,
    CASE WHEN pos % 29 = 5 THEN '?' WHEN pos % 11 = 3 THEN '.' WHEN pos % 7 = 2 THEN ',' ELSE '' END AS label
  FROM rn LEFT JOIN ru USING (doc_id, run) LEFT JOIN sp ON sp.doc_id = rn.doc_id AND pos BETWEEN sf AND sl)"""


def _labelled(spark, sf_dir):
    words = fx.words(spark, sf_dir).select("doc_id", "pos", "word", F.floor(F.col("pos") / 12).alias("owner"))
    spans = words.where("pos % 50 = 20").select("doc_id", F.col("pos").alias("first"), (F.col("pos") + 3).alias("last"))
    label = F.when(F.col("pos") % 29 == 5, "?").when(F.col("pos") % 11 == 3, ".").when(F.col("pos") % 7 == 2, ",").otherwise("0")
    return words, segmenting.unpunctuated_runs(words), spans, words.select("doc_id", "pos", label.alias("label"))


@query(rf"""
WITH {_RUNS},
a AS (SELECT *, coalesce(pos < sl, false) AS inside, sf IS NOT NULL AND max(CASE WHEN pos < sl AND label IN ('.', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sf, sl) = 1 AS stopped FROM wr),
b AS (SELECT *, CASE WHEN lead(stopped AND sf = pos) OVER o AND lead(first) OVER o = first THEN '.' WHEN inside THEN '' WHEN stopped AND label NOT IN ('.', '?') THEN '.' ELSE label END AS put FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT *, {_BARE} || put AS ended FROM b),
d AS (SELECT *, CASE WHEN pos > first THEN lag(ended) OVER (PARTITION BY doc_id ORDER BY pos) END AS before, CASE WHEN pos = last THEN {_BARE} || coalesce(nullif(regexp_extract(word, {_TRAIL}), ''), '.') ELSE ended END AS said FROM c),
e AS (SELECT doc_id, pos, CASE WHEN first IS NULL THEN word WHEN (before IS NULL OR regexp_matches(before, '[.?]$')) AND regexp_matches(said, '^\p{{Ll}}') THEN CASE said[1] WHEN 'ß' THEN 'SS' ELSE upper(said[1]) END || said[2:] ELSE said END AS word FROM d)
SELECT doc_id, pos // 12 AS owner, string_agg(word, ' ' ORDER BY pos) AS text FROM e GROUP BY doc_id, owner""")
def apply_punctuation_labels(spark, sf_dir):
    words, runs, spans, marks = _labelled(spark, sf_dir)
    return punctuation.by_owner(punctuation.apply_punctuation_labels(words, marks, runs, spans))


@query(rf"""
WITH {_RUNS},
e AS (SELECT doc_id, pos, CASE WHEN first IS NOT NULL AND ((pos = last AND NOT regexp_matches(word, '[.!?…]["''”’)\]]*$')) OR (pos < last AND label = '.' AND (sl IS NULL OR pos >= sl))) THEN regexp_replace(word, {_TRAIL}, '') || '.' ELSE word END AS word FROM wr)
SELECT doc_id, pos // 12 AS owner, string_agg(word, ' ' ORDER BY pos) AS text FROM e GROUP BY doc_id, owner""")
def apply_sentence_breaks(spark, sf_dir):
    words, runs, spans, marks = _labelled(spark, sf_dir)
    return punctuation.by_owner(punctuation.apply_sentence_breaks(words, marks.where("label = '.'"), runs, spans))


@query(rf"""
WITH {_WORDS}, x AS (SELECT *, lead(word) OVER o AS a, lead(word, 2) OVER o AS b FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, pos, word, lower({_BARE.replace("word", "a")}) AS a, lower({_BARE.replace("word", "b")}) AS b FROM x)
SELECT doc_id, pos, CASE WHEN coalesce((a = 'in' AND b = 'the') OR (a = 'of' AND b = 'the'), false) AND NOT regexp_matches(word, '[.!?…]["''”’)\]]*$') THEN regexp_replace(word, {_TRAIL}, '') || '.' ELSE word END AS word, pos // 12 AS owner FROM f""")
def break_before_marker(spark, sf_dir):
    return punctuation.break_before_marker(_labelled(spark, sf_dir)[0], [("in", "the"), ("of", "the")])


@query(f"""
WITH {_WORDS}, o AS (SELECT doc_id, pos, coalesce(sum(len(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM words),
s AS (SELECT doc_id, 37 * k + doc_id % 11 AS begin, 37 * k + doc_id % 11 + 9 AS "end" FROM documents, range(5) r(k))
SELECT s.doc_id, begin, "end", min(pos) AS first, max(pos) AS last FROM s JOIN o ON o.doc_id = s.doc_id AND place >= begin AND place < "end" GROUP BY ALL""")
def spans_cover_words(spark, sf_dir):
    spans = fx.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("doc_id", (37 * F.col("k") + F.col("doc_id") % 11).alias("begin"), (37 * F.col("k") + F.col("doc_id") % 11 + 9).alias("end"))
    return punctuation.spans_cover_words(fx.words(spark, sf_dir), spans)


_PIECE = "zqa zqb zqc zqd zqe"


@query(f"""
WITH {_SEG},
sl AS (SELECT doc_id, seg_id, "start", "end", text, len({_words('coalesce(text, \'\')')}) AS old FROM segments WHERE seg_id % 5 = 4),
op AS (SELECT *, unnest([1, 2, 3]) AS option FROM sl),
sp AS (SELECT *, CASE option WHEN 3 THEN "start" + old / 2.5 ELSE "start" END AS b, CASE option WHEN 2 THEN "end" - old / 2.5 ELSE "end" END AS f FROM op),
pi AS (SELECT *, CASE WHEN option = 1 THEN 'all of ' || text WHEN (seg_id + option) % 2 = 0 THEN '{_PIECE}' ELSE text END AS said FROM sp WHERE f - b >= 1.5),
ok AS (SELECT *, len({_words('said')}) + CASE WHEN option > 1 THEN old ELSE 0 END AS n FROM pi WHERE option = 1 OR said = '{_PIECE}'),
be AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY doc_id, seg_id ORDER BY n DESC, option) = 1),
wo AS (SELECT * FROM be WHERE n - old >= 3),
al AS (
  SELECT doc_id, seg_id, NULL::BIGINT AS piece, "start", "end", text FROM segments s WHERE NOT EXISTS (SELECT 1 FROM wo WHERE wo.doc_id = s.doc_id AND wo.seg_id = s.seg_id)
  UNION ALL SELECT doc_id, seg_id, 0, b, f, said FROM wo
  UNION ALL SELECT doc_id, seg_id, NULL, CASE option WHEN 3 THEN "start" ELSE "end" - old / 2.5 END, CASE option WHEN 3 THEN "start" + old / 2.5 ELSE "end" END, text FROM wo WHERE option > 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY "start", seg_id, piece NULLS FIRST) - 1 AS at, seg_id, piece, round("start", 6) AS "start", round("end", 6) AS "end", text FROM al""")
def replace_slow_segments(spark, sf_dir):
    segments = fx.segments(spark, sf_dir).select("doc_id", "seg_id", "start", "end", "text")
    slow = segments.where("seg_id % 5 = 4").select("doc_id", "seg_id")
    spans = repair.slow_options(segments, slow).join(segments.select("doc_id", "seg_id", "text"), ["doc_id", "seg_id"])
    said = F.when(F.col("option") == 1, F.concat(F.lit("all of "), "text")).when((F.col("seg_id") + F.col("option")) % 2 == 0, _PIECE).otherwise(F.col("text"))
    candidates = spans.select("doc_id", "seg_id", "option", F.lit(0).alias("piece"), F.col("begin").alias("start"), F.col("finish").alias("end"), said.alias("text"))
    words = segments.select("doc_id", "start", "end", F.lit("w").alias("word"))
    out, _ = repair.replace_slow_segments(segments, words, slow, candidates)
    return out.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})
