"""Queries of the operators that larger jobs are made of, each with its DuckDB SQL beside it (None: see the tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import ledger, repair, scoring, segmenting
from ..sources import fixtures as fx
from .oracles import _EVENTS, _FILES, _PAIRS, _SEG, _q, _words

def collector(queries: dict, oracles: dict):
    """A decorator that takes a query's SQL (None: none) and puts both under the query's name; ints become longs."""

    def query(sql: str | None):
        def register(f):
            def call(spark, sf_dir):
                out = f(spark, sf_dir)
                return out.select(*[F.col(n).cast("long").alias(n) if t == "int" else F.col(n) for n, t in out.dtypes])

            queries[f.__name__] = call
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return register

    return query


QUERIES, ORACLES = {}, {}
query = collector(QUERIES, ORACLES)


def _paragraphs(col: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({col}, '\n\s*\n+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"


def _sentences(col: str) -> str:
    t = rf"regexp_replace(trim({col}), '\s*\n\s*', ' ', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '{_q(text.OPENER)}', '\1{text.MARK}\2', 'g')"
    t = rf"regexp_replace({t}, '{_q(text.CASELESS)}', '\1{text.MARK}', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '{_q(text.ABBREVIATED)}', '\1 ', 'g')"
    return f"list_filter(list_transform(string_split({t}, '{text.MARK}'), lambda s: trim(s)), lambda s: s <> '')"


_SCRIPT = r"script AS (SELECT conv_id AS doc_id, string_agg(['[calm] ', '[angry] ', '[laugh] ', '[inaudible] '][turn % 4 + 1] || text, E'\n\n' ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)"
_PARAS = f"{_SCRIPT}, pl AS (SELECT doc_id, {_paragraphs('text')} AS p FROM script), paras AS (SELECT doc_id, unnest(range(len(p))) AS para, unnest(p) AS text FROM pl)"
_SENTS = f"{_PARAS}, sl AS (SELECT doc_id, para, {_sentences('text')} AS s FROM paras), sents AS (SELECT doc_id, para, unnest(range(len(s))) AS sent, unnest(s) AS text FROM sl)"


@query(f"WITH {_PARAS} SELECT doc_id, para, text FROM paras")
def split_paragraphs(spark, sf_dir):
    return segmenting.split_paragraphs(fx.script(spark, sf_dir))


@query(f"WITH {_SENTS} SELECT doc_id, para, sent, text FROM sents")
def split_sentences(spark, sf_dir):
    return segmenting.split_sentences(fx.script(spark, sf_dir))


@query(rf"""
WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_'']+'), lambda w: trim(lower(regexp_replace(strip_accents(w), '[^\p{{L}}\p{{N}}'']', '', 'g')), '''')), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM w""")
def tokenize(spark, sf_dir):
    return segmenting.tokenize(fx.table(spark, sf_dir, "documents"))


@query(rf"""
WITH {_SCRIPT}, pl AS (SELECT doc_id, {_paragraphs('text')} AS p FROM script),
c AS (SELECT doc_id, CASE WHEN len(p) >= 2 AND list_avg(list_transform(p, lambda x: len({_words('x')}))) <= {rules.PARAGRAPH_WORDS} THEN list_transform(p, lambda x: regexp_replace(x, '\s*\n\s*', ' ', 'g')) ELSE flatten(list_transform(p, lambda x: {_sentences('x')})) END AS c FROM pl)
SELECT doc_id, unnest(range(len(c))) AS chunk_id, unnest(c) AS text FROM c""")
def chunk_text(spark, sf_dir):
    return segmenting.chunk_text(fx.script(spark, sf_dir)).select("doc_id", "chunk_id", "text")


@query(rf"""
WITH w AS (SELECT doc_id, len({_words('text')}) AS n FROM documents), l AS (SELECT doc_id, n, greatest(ceil((n - 200) / 180.0), 0)::BIGINT AS l FROM w WHERE n > 0), v AS (SELECT doc_id, n, unnest(range(l + 1)) AS win FROM l),
t AS (SELECT doc_id, win, unnest(range(win * 180, least(win * 180 + 200, n))) AS pos FROM v),
m AS (SELECT doc_id, pos, avg(((pos * 7 + win * 3) % 11 - 6) / 2.0::DOUBLE) AS logit FROM t GROUP BY doc_id, pos)
SELECT doc_id, pos, round(1 / (1 + exp(-logit)), 9) AS score, 1 / (1 + exp(-logit)) > 0.25 AS is_break FROM m""")
def merge_window_scores(spark, sf_dir):
    w = segmenting.window_tokens(fx.words(spark, sf_dir).select("doc_id", "pos"), 200, 180)
    scored = w.select("doc_id", "pos", (((F.col("pos") * 7 + F.col("win") * 3) % 11 - 6) / 2.0).alias("logit"))
    return segmenting.merge_window_scores(scored).select("doc_id", "pos", F.round("score", 9).alias("score"), "is_break")


def _clauses(col: str, least: int = 6) -> str:
    """The clause fold over pieces; a short tail joins the clause before it."""
    pieces = rf"list_filter(string_split(regexp_replace({col}, '([^0-9])([,，;；])', '\1\2{text.MARK}', 'g'), '{text.MARK}'), lambda p: p <> '')"
    fold = f"list_reduce(list_transform({pieces}, lambda p: {{'o': p, 'd': []::VARCHAR[]}}), lambda a, x: CASE WHEN length(regexp_replace(a.o || x.o, '^[ ,，;；]+|[ ,，;；]+$', '', 'g')) >= {least} THEN {{'o': '', 'd': list_append(a.d, a.o || x.o)}} ELSE {{'o': a.o || x.o, 'd': a.d}} END, {{'o': '', 'd': []::VARCHAR[]}})"
    return fold


def _closed(fold: str) -> str:
    return f"list_transform(CASE WHEN ({fold}).o = '' THEN ({fold}).d ELSE list_append(({fold}).d[:-2], coalesce(({fold}).d[-1], '') || ({fold}).o) END, lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g'))"


_CLAUSES = f"{_PAIRS}, cf AS (SELECT id, {_clauses('ref')} AS f FROM pairs), cl AS (SELECT id, {_closed('f')} AS c FROM cf), clauses AS (SELECT id, unnest(range(len(c))) AS clause, unnest(c) AS text FROM cl)"


@query(f"WITH {_CLAUSES} SELECT id, clause, text FROM clauses")
def source_clauses(spark, sf_dir):
    return segmenting.source_clauses(fx.pairs(spark, sf_dir), "id", "ref")


@query(None)
def reading_clauses(spark, sf_dir):
    return segmenting.reading_clauses(fx.table(spark, sf_dir, "documents"))


@query(rf"""
WITH {_SENTS}, ol AS (SELECT doc_id, list(text ORDER BY para, sent) AS s FROM sents GROUP BY doc_id),
u AS (SELECT doc_id, list_transform(s, lambda t: {{'o': t, 'n': round_even(length(t) + {rules.DENSE_EXTRA} * (length(t) - length(regexp_replace(t, '{text.DENSE}', '', 'g'))) + {rules.ABJAD_EXTRA} * (length(t) - length(regexp_replace(t, '{text.ABJAD}', '', 'g'))), 0)::BIGINT, 'd': []::VARCHAR[]}}) AS s FROM ol),
f AS (SELECT doc_id, list_reduce(s, lambda a, x: CASE WHEN a.n > 0 AND a.n + 1 + x.n <= {rules.CHUNK_BUDGET} THEN {{'o': a.o || ' ' || x.o, 'n': a.n + 1 + x.n, 'd': a.d}} ELSE {{'o': x.o, 'n': x.n, 'd': list_append(a.d, a.o)}} END) AS f FROM u),
c AS (SELECT doc_id, list_append(f.d, f.o) AS c FROM f)
SELECT doc_id, unnest(range(len(c))) AS chunk_id, unnest(c) AS text FROM c""")
def pack_chunks(spark, sf_dir):
    s = segmenting.split_sentences(fx.script(spark, sf_dir)).select("doc_id", F.struct("para", "sent").alias("sent"), "text")
    return segmenting.pack_chunks(s)


@query(f"""
WITH {_SENTS}, b AS (SELECT doc_id, para, string_agg(text, chr(10) ORDER BY sent) AS body FROM sents WHERE trim(text) <> '' GROUP BY doc_id, para)
SELECT doc_id, string_agg(body, E'\\n\\n' ORDER BY para) AS text FROM b GROUP BY doc_id""")
def rebuild_paragraphs(spark, sf_dir):
    return segmenting.rebuild_paragraphs(segmenting.split_sentences(fx.script(spark, sf_dir)))


_FOLDED = {(lang, level): f"{lang}_{level}" for lang in ("he", "ar", "zh", "hi") for level in ("letters", "sound")}


def _fold_sql(lang: str, level: str) -> str:
    t = f"regexp_replace(text, '{text.DROPPED[lang]}', '', 'g')" if lang in text.DROPPED else "text"
    for step in ("letters", "sound") if level == "sound" else ("letters",):
        if (lang, step) in text.FOLDS:
            t = f"translate({t}, '{text.FOLDS[lang, step][0]}', '{text.FOLDS[lang, step][1]}')"
    return t


@query("SELECT doc_id, " + ", ".join(f"md5({_fold_sql(*k)}) AS {name}" for k, name in _FOLDED.items()) + " FROM documents")
def fold_script(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", *[F.md5(text.fold_script(F.col("text"), *k)).alias(name) for k, name in _FOLDED.items()])


@query("SELECT doc_id, replace(replace(translate(text, '\"“”«»', ''), 'the ', 'ze '), 'la ', 'lah ') AS said FROM documents")
def respell(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.respell(F.col("text"), [("the ", "ze "), ("la ", "lah ")], '"“”«»').alias("said"))


@query(r"SELECT doc_id, regexp_replace(translate('the lord。' || text, '。！？，：；', '.!?,:;'), '\b([Tt]he|[Oo]ur) lord\b', '\1 Lord', 'g') AS source FROM documents")
def source_fixups(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.source_fixups(F.concat(F.lit("the lord。"), "text")).alias("source"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')) AS plain FROM pages")
def unescape(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", F.md5(text.unescape(F.col("html"))).alias("plain"))


@query("SELECT doc_id, CASE WHEN lang = source THEN lang ELSE lang || '|' || source END AS codes FROM documents")
def language_list(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(text.language_list(F.concat("lang", F.lit(", "), "source", F.lit(" ,"), "lang")), "|").alias("codes"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE / 20 - 0.25::DOUBLE AS e, l_discount::DOUBLE * 12 AS w, l_tax::DOUBLE * 20 AS t FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem))
SELECT l_orderkey, l_linenumber, round(least(greatest(e, 0.0), 1.5), 3)::DOUBLE AS exaggeration, round(least(greatest(w, 0.0), 1.0), 3)::DOUBLE AS cfg_weight, round(least(greatest(t, 0.05), 1.5), 3)::DOUBLE AS temperature FROM v""")
def style_params(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")]).distinct()
    p = text.style_params(F.col("l_quantity") / 20 - 0.25, F.col("l_discount") * 12, F.col("l_tax") * 20)
    return li.select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'es' WHEN doc_id % 3 = 1 THEN coalesce(nullif(lower(trim(lang)), ''), 'en') ELSE 'en' END AS lang FROM documents")
def resolve_reading_language(spark, sf_dir):
    third = F.col("doc_id") % 3
    targets = F.when(third == 0, F.array(F.lit(" ES "), F.lit("ru"))).otherwise(F.array().cast("array<string>"))
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.resolve_reading_language(targets, F.when(third == 1, F.col("lang")), F.lit(" ")).alias("lang"))


_STRETCH = f"{_SEG}, c AS (SELECT doc_id, seg_id // 3 AS stretch, seg_id % 3 AS way, \"end\", len({_words('text')}) AS n FROM segments), st AS (SELECT doc_id, stretch, min(\"end\") + 15 AS finish FROM c GROUP BY ALL)"


@query(f"""
WITH {_STRETCH}, w AS (SELECT c.doc_id, c.stretch, way, sum(n)::BIGINT AS words FROM c JOIN st USING (doc_id, stretch) WHERE "end" <= finish + {rules.SLACK_SECONDS} GROUP BY ALL HAVING sum(n) >= 3)
SELECT doc_id, stretch, arg_max(way, words * 10 - way) AS way, max(words) AS words FROM w GROUP BY ALL""")
def choose_refill(spark, sf_dir):
    c = fx.segments(spark, sf_dir).select("doc_id", F.floor(F.col("seg_id") / 3).alias("stretch"), (F.col("seg_id") % 3).alias("way"), "end", "text")
    stretches = c.groupBy("doc_id", "stretch").agg((F.min("end") + 15).alias("finish"))
    return repair.choose_refill(stretches, c, rules.REFILL_WORDS)


@query(f"""
WITH {_SEG}, g0 AS (SELECT doc_id, coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS b, "start" AS e FROM segments),
g AS (SELECT DISTINCT doc_id, b, e FROM g0 WHERE e - b > 1.5),
f AS (SELECT doc_id, unnest(range(floor(duration * 10)::BIGINT + 1)) AS frame_no FROM docs), r AS (SELECT *, ((frame_no * 37 + doc_id * 11) % 100) / 100.0::DOUBLE AS rms FROM f),
l AS (SELECT doc_id, quantile_cont(rms, 0.75) * {rules.LOUD_LEVEL}::DOUBLE AS level FROM r GROUP BY doc_id),
s AS (SELECT g.doc_id, b, e, avg((rms > level)::INT) AS share FROM g JOIN r ON r.doc_id = g.doc_id AND frame_no BETWEEN floor(b / 0.1::DOUBLE) AND floor(e / 0.1::DOUBLE) JOIN l ON l.doc_id = g.doc_id GROUP BY ALL)
SELECT doc_id, round(b, 3) AS begin, round(e, 3) AS finish, round(share, 9) AS loud_share FROM s WHERE share >= {rules.LOUD_SHARE}""")
def speech_loud_gaps(spark, sf_dir):
    docs = fx.docs(spark, sf_dir)
    gaps = repair.segment_gaps(fx.segments(spark, sf_dir), docs.limit(0)).distinct()
    frames = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("duration") * 10))).alias("frame_no"))
    frames = frames.withColumn("rms", ((F.col("frame_no") * 37 + F.col("doc_id") * 11) % 100) / 100.0)
    return repair.speech_loud_gaps(gaps, frames).select("doc_id", F.round("begin", 3).alias("begin"), F.round("finish", 3).alias("finish"), F.round("loud_share", 9).alias("loud_share"))


@query(f"WITH {_FILES} SELECT path, CASE WHEN doc_id % 4 > 1 THEN doc_id::DOUBLE WHEN doc_id % 3 > 0 THEN doc_id % 3 + 0.5::DOUBLE WHEN doc_id % 4 = 0 THEN 0.0::DOUBLE END AS duration FROM files")
def fill_durations(spark, sf_dir):
    f = fx.files(spark, sf_dir)
    known = f.select("path", F.when(F.col("doc_id") % 4 > 1, F.col("doc_id").cast("double")).when(F.col("doc_id") % 4 == 0, 0.0).alias("duration"))
    probes = f.select("path", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3 + 0.5).otherwise(-1.0).alias("probe"))
    return repair.fill_durations(known, probes)


_MODES = ["text", "align", "undecided", "transcribe", "speak"]
_MODED = f"{_EVENTS}, moded AS (SELECT path, seq, status, {_MODES!r}[seq % 5 + 1] AS mode FROM state), found AS (SELECT path, CASE WHEN seq % 2 = 0 THEN path || '.txt' END AS text_path FROM state)"


def _moded(spark, sf_dir):
    state = ledger.ledger_state(fx.ledger_events(spark, sf_dir))
    mode = F.element_at(F.array(*[F.lit(m) for m in _MODES]), (F.col("seq") % 5 + 1).cast("int"))
    return state.select("path", "seq", "status", mode.alias("mode")), state.select("path", F.when(F.col("seq") % 2 == 0, F.concat("path", F.lit(".txt"))).alias("text_path"))


@query(f"""
WITH {_EVENTS}, n AS (SELECT DISTINCT 'f' || (user_id + 7) || CASE WHEN event_id % 4 = 0 THEN '.TXT' ELSE '' END AS path, user_id FROM events), k AS (SELECT * FROM n WHERE path NOT IN (SELECT path FROM state))
SELECT path, 'pending' AS status, CASE WHEN ends_with(lower(path), '.txt') THEN 'text' WHEN user_id % 2 = 0 THEN 'align' ELSE 'undecided' END AS mode FROM k""")
def ledger_add(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    path = F.concat(F.lit("f"), (F.col("user_id") + 7).cast("string"), F.when(F.col("event_id") % 4 == 0, ".TXT").otherwise(""))
    new = e.select(path.alias("path"), "user_id").distinct()
    return ledger.ledger_add(ledger.ledger_state(fx.ledger_events(spark, sf_dir)), new, new.where("user_id % 2 = 0").select("path", F.col("path").alias("text_path")))


@query(f"""
WITH {_EVENTS}, c AS (SELECT path, status, seq, error, seq * 1.0::DOUBLE AS s, seq + 1.0::DOUBLE AS f, ['pending', 'in_progress', 'done', 'failed', 'skipped', NULL][seq % 6 + 1] AS t FROM state)
SELECT path, coalesce(t, status) AS status, CASE WHEN t = 'in_progress' THEN 5.0::DOUBLE WHEN t = 'pending' THEN NULL ELSE s END AS started, CASE WHEN t IS NULL THEN f WHEN t IN ('done', 'failed', 'skipped') THEN 5.0::DOUBLE END AS finished, CASE WHEN t IS NULL THEN error WHEN t = 'failed' THEN 'm' || seq END AS error FROM c""")
def ledger_transition(spark, sf_dir):
    s = ledger.ledger_state(fx.ledger_events(spark, sf_dir)).select("path", "status", "seq", F.col("seq").cast("double").alias("started"), (F.col("seq") + 1.0).alias("finished"), "error")
    to = F.element_at(F.array(*[F.lit(x) for x in ("pending", "in_progress", "done", "failed", "skipped")]), (F.col("seq") % 6 + 1).cast("int"))
    changes = s.where("seq % 6 < 5").select("path", to.alias("to"), F.lit(5.0).alias("at"), F.concat(F.lit("m"), F.col("seq").cast("string")).alias("message"))
    return ledger.ledger_transition(s, changes)


@query(f"WITH {_MODED} SELECT path, 'skipped' AS status, 'skip' AS mode FROM moded WHERE mode = 'undecided'")
def ledger_decide_all(spark, sf_dir):
    return ledger.ledger_decide_all(_moded(spark, sf_dir)[0], "skip")


@query(f"WITH {_MODED} SELECT path, seq, status, CASE WHEN status IN ('done', 'skipped') OR mode = 'text' THEN mode WHEN text_path IS NOT NULL THEN 'align' ELSE 'undecided' END AS mode FROM moded JOIN found USING (path)")
def ledger_apply_reference_mode(spark, sf_dir):
    return ledger.ledger_apply_reference_mode(*_moded(spark, sf_dir), True).select("path", "seq", "status", "mode")


@query(f"WITH {_MODED} SELECT path, 'align' AS mode, text_path FROM moded JOIN found USING (path) WHERE mode = 'undecided' AND text_path IS NOT NULL")
def ledger_rematch(spark, sf_dir):
    return ledger.ledger_rematch(*_moded(spark, sf_dir)).select("path", "mode", "text_path")


@query(f"WITH {_MODED} SELECT path, CASE WHEN mode = 'speak' THEN 'text' ELSE mode END AS mode FROM moded")
def ledger_legacy_modes(spark, sf_dir):
    return ledger.ledger_legacy_modes(_moded(spark, sf_dir)[0]).select("path", "mode")


@query(f"WITH {_EVENTS} SELECT path, seq, status FROM state WHERE status IN ('pending', 'in_progress')")
def ledger_unfinished(spark, sf_dir):
    return ledger.ledger_unfinished(ledger.ledger_state(fx.ledger_events(spark, sf_dir))).select("path", "seq", "status")


@query(f"""
WITH {_EVENTS}, r AS (SELECT path, min(ts) AS a, max(ts) AS b FROM events0 WHERE seq % 3 = 0 GROUP BY path)
SELECT count(*) AS total, count(*) FILTER (WHERE a IS NOT NULL AND status IN ('done', 'failed')) AS processed, count(*) FILTER (WHERE a IS NOT NULL AND status = 'done') AS completed, count(*) FILTER (WHERE a IS NOT NULL AND status = 'failed') AS failed, count(*) FILTER (WHERE a IS NULL AND status = 'done') AS already_done, round(epoch(max(b)) - epoch(min(a)), 3) AS elapsed FROM state LEFT JOIN r USING (path)""")
def ledger_run_report(spark, sf_dir):
    e = fx.ledger_events(spark, sf_dir)
    r = ledger.ledger_run_report(ledger.ledger_state(e), e.where("seq % 3 = 0").select("path", "ts"))
    return r.withColumn("elapsed", F.round("elapsed", 3))


def _stems(rows: str, key: str) -> str:
    return rf"SELECT DISTINCT {key}, substring(w, 1, 5) AS stem FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '\p{{L}}{{4,}}')) AS w FROM {rows}) WHERE w NOT IN ({', '.join(f"'{x}'" for x in rules.STOPWORDS)})"


@query(f"""
WITH {_CLAUSES}, whole AS (SELECT id, hyp AS text FROM pairs), a AS ({_stems('clauses', 'id, clause')}), b AS ({_stems('whole', 'id')}),
c AS (SELECT a.id, clause, count(*) AS n, count(b.stem) AS hits FROM a LEFT JOIN b ON a.id = b.id AND a.stem = b.stem GROUP BY ALL)
SELECT id, min(clause) AS clause FROM c WHERE n >= 3 AND hits = 0 GROUP BY id""")
def dropped_clause(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    return scoring.dropped_clause(p.select("id", F.col("hyp").alias("text")), segmenting.source_clauses(p, "id", "ref"))


@query("""
WITH w AS (SELECT l_orderkey AS id, l_suppkey % 5 AS c, count(*) AS w, count(*) FILTER (WHERE l_linenumber % 3 <> 0) AS g FROM lineitem GROUP BY ALL)
SELECT id, sum(least(w, g))::BIGINT AS "right", sum(w)::BIGINT AS wanted FROM w GROUP BY id""")
def citation_recall(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 5).alias("citation"), "l_linenumber")
    return scoring.citation_recall(li, li.where("l_linenumber % 3 <> 0"))


_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


@query("SELECT count(*) AS readings, round(avg((o_orderkey % 5 <> 0)::INT), 9) AS kept FROM orders")
def marker_kept(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "MMMM d").alias("day"))
    src = o.select("id", F.concat(F.lit("On "), "day").alias("text"))
    return scoring.marker_kept(src, o.select("id", F.when(F.col("id") % 5 != 0, F.upper("day")).otherwise("then").alias("text")), _MONTHS).withColumn("kept", F.round("kept", 9))


@query(r"""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 1 THEN text || ' Thank you. thanks!' ELSE regexp_replace(text || CASE WHEN doc_id % 3 = 2 THEN ' Thank you. thanks!' ELSE ' Thanks' END, '(?i)(?:\s*(?:thank you|thanks)[.!?]*)+\s*$', '') END) AS heard FROM documents""")
def strip_trailing_fillers(spark, sf_dir):
    full = F.concat("text", F.lit(" Thank you. thanks!"))
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" Thanks"))).otherwise(full).alias("heard"), F.when(F.col("doc_id") % 3 == 1, full).otherwise(F.lit("x")).alias("ref"))
    return d.select("doc_id", F.md5(scoring.strip_trailing_fillers(F.col("heard"), F.col("ref"), ["thank you", "thanks"])).alias("heard"))


@query(f"WITH {_EVENTS} SELECT path, CASE WHEN count(*) = 1 THEN arg_min(error, seq) ELSE arg_min(error, seq) || ' (' || (count(*) - 1) || ' more)' END AS digest FROM events0 WHERE status = 'failed' GROUP BY path")
def warning_digest(spark, sf_dir):
    return scoring.warning_digest(fx.ledger_events(spark, sf_dir).where("status = 'failed'").select("path", F.col("seq").alias("ord"), F.col("error").alias("message")), "path")


@query(f"""
WITH {_SEG}, f AS (SELECT doc_id, role, min(seg_id) AS seg, count(*) AS n, sum("end" - "start") AS s FROM segments GROUP BY ALL)
SELECT doc_id, string_agg(role, ',' ORDER BY seg) AS styles, sum(n)::BIGINT AS chunks, round(sum(s), 3) AS seconds FROM f GROUP BY doc_id""")
def reading_provenance(spark, sf_dir):
    c = fx.segments(spark, sf_dir).select("doc_id", F.col("seg_id").alias("chunk_id"), F.col("role").alias("style"), (F.col("end") - F.col("start")).alias("duration"))
    return scoring.reading_provenance(c).withColumn("styles", F.array_join("styles", ","))


@query(f"WITH {_SEG} SELECT doc_id, count(*) AS chunks, count(*) FILTER (WHERE seg_id % 4 <> 1) AS timed, count(*) FILTER (WHERE seg_id % 4 = 1) AS unmatched FROM segments GROUP BY doc_id")
def alignment_summary(spark, sf_dir):
    return scoring.alignment_summary(fx.segments(spark, sf_dir).select("doc_id", F.when(F.col("seg_id") % 4 != 1, F.col("start")).alias("start")))


_SCORES = "scores AS (SELECT l_linenumber AS take, l_suppkey AS doc_id, l_quantity::DOUBLE AS chrf, l_partkey % 4 AS r, l_partkey % 4 + l_orderkey % 2 AS w FROM lineitem)"


def _scores(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linenumber").alias("take"), F.col("l_suppkey").alias("doc_id"), F.col("l_quantity").cast("double").alias("chrf"), (F.col("l_partkey") % 4).alias("right"), (F.col("l_partkey") % 4 + F.col("l_orderkey") % 2).alias("wanted"))


@query(f'WITH {_SCORES} SELECT take, doc_id, round(avg(chrf), 6) AS chrf, sum(r)::BIGINT AS "right", sum(w)::BIGINT AS wanted FROM scores GROUP BY ROLLUP (take, doc_id)')
def round_trip_report(spark, sf_dir):
    return scoring.round_trip_report(_scores(spark, sf_dir)).withColumn("chrf", F.round("chrf", 6))


@query(f"WITH {_SCORES} SELECT take, doc_id, chrf FROM scores WHERE chrf < {rules.CHRF_FLOOR}")
def flag_invented(spark, sf_dir):
    return scoring.flag_invented(_scores(spark, sf_dir)).select("take", "doc_id", "chrf")


@query(f"WITH {_SCORES}, r AS (SELECT doc_id, take, row_number() OVER (PARTITION BY doc_id ORDER BY chrf DESC, take) AS r FROM scores) SELECT doc_id AS id, take AS way FROM r WHERE r = 1")
def choose_candidate(spark, sf_dir):
    return scoring.choose_candidate(_scores(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("take").alias("way"), "chrf"))
