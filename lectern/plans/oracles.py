"""DuckDB SQL for the queries of plans/registry.py, with the derived tables as common table expressions."""

from __future__ import annotations

from ..functions import rules, text


def _words(col: str) -> str:
    return rf"list_filter(string_split_regex({col}, '\s+'), lambda x: x <> '')"


_SEG = rf"""
t0 AS (SELECT conv_id AS doc_id, turn AS seg_id, role, text, len({_words('text')}) AS n FROM conversations),
t1 AS (SELECT *, n / 2.5::DOUBLE * CASE WHEN seg_id % 5 = 4 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS dur, CASE WHEN seg_id % 3 = 0 THEN 2.0::DOUBLE ELSE 0.3::DOUBLE END AS pause FROM t0),
t2 AS (SELECT *, round(coalesce(sum(dur + pause) OVER (PARTITION BY doc_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) + pause, 3) AS "start" FROM t1),
timed AS (SELECT doc_id, seg_id::BIGINT AS seg_id, "start", round("start" + dur, 3) AS "end", text, role FROM t2),
docs AS (SELECT doc_id, round(max("end") + CASE WHEN doc_id % 2 = 0 THEN 0.5::DOUBLE ELSE 2.5::DOUBLE END, 3) AS duration FROM timed GROUP BY doc_id),
segments AS (SELECT * FROM timed UNION ALL SELECT doc_id, 9999, round(duration - 0.9::DOUBLE, 3), round(duration + 29.1::DOUBLE, 3), 'Thank you', 'user' FROM docs WHERE doc_id % 4 = 0)
"""
_WORDS = rf"words AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT doc_id, {_words('text')} AS w FROM documents))"
_EVENTS = """
events0 AS (SELECT 'f' || user_id AS path, event_id AS seq, ts, CASE WHEN event_type IN ('signup', 'click') THEN 'pending' WHEN event_type = 'view' THEN 'in_progress' WHEN event_type = 'purchase' THEN 'done' ELSE 'failed' END AS status, CASE WHEN event_type NOT IN ('signup', 'click', 'view', 'purchase') THEN 'E' || (floor(value)::BIGINT % 3) END AS error FROM events),
state AS (SELECT path, seq, ts, status, error FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) AS r FROM events0) WHERE r = 1)
"""
_FILES = """
files AS (SELECT doc_id, '/src/' || source || '/' || lang AS dir, 'Doc' || doc_id AS stem, ['.mp3', '.MP4', '.txt', '.wav', '.jpg'][doc_id % 5 + 1] AS ext, '/src/' || source || '/' || lang || '/Doc' || doc_id || ['.mp3', '.MP4', '.txt', '.wav', '.jpg'][doc_id % 5 + 1] AS path FROM documents)
"""
_PAIRS = "pairs AS (SELECT doc_id AS id, text AS ref, substring(text, 1, length(text) * 2 // 5) || ' zz ' || substring(text, length(text) * 9 // 20 + 1) AS hyp FROM documents WHERE text IS NOT NULL)"
_ABBREVIATED = text.ABBREVIATED
_STAMP = lambda c: f"lpad((ms_{c} // 3600000)::VARCHAR, 2, '0') || ':' || lpad((ms_{c} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms_{c} // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((ms_{c} % 1000)::VARCHAR, 3, '0')"
_CLEAN = lambda c: rf"list_filter(list_transform({_words(f'lower({c})')}, lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: w <> '')"


def _q(s: str) -> str:
    return s.replace("'", "''")


ORACLES = {
    "sentence_report": rf"""
WITH p AS (SELECT lang, source, unnest(list_filter(list_transform(string_split_regex(text, '\n\s*\n+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')) AS p FROM documents),
f AS (SELECT lang, source, regexp_replace(trim(p), '\s*\n\s*', ' ', 'g') AS t FROM p),
a AS (SELECT lang, source, regexp_replace(regexp_replace(t, '{_q(text.OPENER)}', '\1{text.MARK}\2', 'g'), '{_q(text.OPENER)}', '\1{text.MARK}\2', 'g') AS t FROM f),
b AS (SELECT lang, source, regexp_replace(t, '{_q(text.CASELESS)}', '\1{text.MARK}', 'g') AS t FROM a),
c AS (SELECT lang, source, regexp_replace(regexp_replace(t, '{_q(_ABBREVIATED)}', '\1 ', 'g'), '{_q(_ABBREVIATED)}', '\1 ', 'g') AS t FROM b),
s AS (SELECT lang, source, unnest(list_filter(list_transform(string_split(t, '{text.MARK}'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM c),
n AS (SELECT lang, source, s, len({_words('s')}) AS n FROM s)
SELECT lang, source, count(*) AS sentences, sum(n)::BIGINT AS words, count(*) FILTER (WHERE n >= 40) AS long_sentences, count(*) FILTER (WHERE NOT regexp_matches(s, '[.!?]$')) AS no_stop FROM n GROUP BY lang, source""",
    "granularity_choice": rf"""
WITH s AS (SELECT conv_id AS doc_id, string_agg(['[calm] ', '[angry] ', '[laugh] ', '[inaudible] '][turn % 4 + 1] || text, '\n\n' ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
p AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split_regex(replace(text, '\n\n', chr(10) || chr(10)), '\n\s*\n+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> ''), lambda p: len({_words('p')})) AS n FROM s)
SELECT doc_id, len(n)::BIGINT AS paragraphs, round(list_sum(n) / len(n), 6) AS mean_words, CASE WHEN len(n) < 2 OR list_sum(n) / len(n) > 120 THEN 'sentence' ELSE 'paragraph' END AS granularity FROM p""",
    "unpunctuated_runs": rf"""
WITH {_WORDS},
e AS (SELECT *, regexp_matches(word, '[.!?…]["''”’)\]]*$')::INT AS ends, len(regexp_replace(word, '[^,;:]', '', 'g')) AS marks FROM words),
r AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e),
g AS (SELECT doc_id, run, min(pos) AS first, max(pos) AS last, count(*) AS n_words, (sum(marks) - arg_max(marks, pos))::BIGINT AS marks FROM r GROUP BY doc_id, run)
SELECT doc_id, first, last, n_words, marks FROM g WHERE n_words >= {rules.RUN_WORDS} AND marks * {rules.RUN_WORDS} < n_words""",
    "window_tokens": rf"""
WITH {_WORDS}, n AS (SELECT doc_id, max(pos) + 1 AS n FROM words GROUP BY doc_id),
l AS (SELECT doc_id, n, greatest(ceil((n - 200) / 180.0), 0)::BIGINT AS last_win FROM n),
w AS (SELECT doc_id, n, last_win, unnest(range(last_win + 1)) AS win FROM l)
SELECT doc_id, win, win * 180 AS first, least(win * 180 + 199, n - 1) AS last, CASE WHEN win = last_win THEN n - win * 180 ELSE 180 END AS kept FROM w""",
    "segment_gaps": f"""
WITH {_SEG},
g AS (SELECT doc_id, coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS begin, "start" AS finish FROM segments
UNION ALL SELECT d.doc_id, coalesce(m.e, 0.0), d.duration FROM docs d LEFT JOIN (SELECT doc_id, max("end") AS e FROM segments GROUP BY doc_id) m USING (doc_id))
SELECT doc_id, round(begin, 3) AS begin, round(finish, 3) AS finish FROM g WHERE finish - begin > 1.5""",
    "slow_segments": f"""
WITH {_SEG}, c AS (SELECT doc_id, seg_id, least("end", coalesce(duration, "end")) - "start" AS span, len({_words('text')}) AS words FROM segments LEFT JOIN docs USING (doc_id))
SELECT doc_id, seg_id, round(span, 3) AS span, words FROM c WHERE span >= 6.0 AND words < 1.3::DOUBLE * span""",
    "closing_filler": f"""
WITH {_SEG} SELECT doc_id, seg_id, "start", text FROM segments JOIN docs USING (doc_id) WHERE "start" > duration - 1.5 AND "end" > duration + 1.0""",
    "fragment_stats": rf"""
WITH {_SEG}, f AS (SELECT role, regexp_matches(trim(text), '^\p{{Ll}}')::INT AS a, (NOT regexp_matches(trim(text), '[.!?…]$'))::INT AS b FROM segments)
SELECT role, count(*) AS segments, round(avg(a), 9) AS begin_mid, round(avg(b), 9) AS no_stop, round(avg(a * b), 9) AS "both" FROM f GROUP BY role""",
    "densest_window": f"""
WITH {_SEG}, v AS (SELECT * FROM segments WHERE "end" > "start"),
o AS (SELECT a.doc_id, a.seg_id AS w, a."start" AS begin, sum(least(b."end", a."start" + 10) - greatest(b."start", a."start")) AS speech FROM v a JOIN v b ON a.doc_id = b.doc_id AND b."start" < a."start" + 10 AND b."end" > a."start" GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(speech, 6) DESC, begin, w) AS r FROM o)
SELECT doc_id, round(begin, 3) AS begin, round(speech, 3) AS speech, speech < 6.0 AS thin FROM r WHERE r = 1""",
    "reading_timeline": f"""
WITH {_SEG}, c AS (SELECT doc_id, seg_id AS chunk_id, "end" - "start" AS dur, row_number() OVER (PARTITION BY doc_id ORDER BY seg_id) AS r FROM segments WHERE seg_id < 9999),
p AS (SELECT *, CASE WHEN r = 1 THEN 0.0::DOUBLE WHEN chunk_id % 5 = 0 THEN 0.7::DOUBLE ELSE 0.28::DOUBLE END AS pause FROM c),
s AS (SELECT *, sum(pause) OVER (PARTITION BY doc_id ORDER BY chunk_id) + coalesce(sum(dur) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS st FROM p)
SELECT doc_id, chunk_id, round(st, 3) AS "start", round(st + dur, 3) AS "end" FROM s""",
    "render_srt_cues": f"""
WITH {_SEG}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", seg_id) AS cue, round_even("start" * 1000, 0)::BIGINT AS ms_a, round_even("end" * 1000, 0)::BIGINT AS ms_b FROM segments WHERE trim(text) <> '')
SELECT doc_id, cue, cue || chr(10) || {_STAMP('a')} || ' --> ' || {_STAMP('b')} || chr(10) || trim(text) AS body FROM c""",
    "document_words": f"WITH {_SEG} SELECT doc_id, sum(len({_words('text')}))::BIGINT AS words FROM segments GROUP BY doc_id",
    "live_excerpt": f"""
WITH {_SEG}, w AS (SELECT doc_id, seg_id, {_words('text')} AS w FROM segments), u AS (SELECT doc_id, seg_id, unnest(range(len(w))) AS p, unnest(w) AS word FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_id DESC, p DESC) AS r FROM u)
SELECT d.doc_id, coalesce(string_agg(word, ' ' ORDER BY seg_id, p), '') AS excerpt FROM (SELECT DISTINCT doc_id FROM segments) d LEFT JOIN r ON r.doc_id = d.doc_id AND r.r <= 34 GROUP BY d.doc_id""",
    "forward_order": f"""
WITH {_SEG}, c AS (SELECT doc_id, seg_id AS chunk_id, CASE WHEN seg_id % 3 = 1 THEN "start" - 20 ELSE "start" END AS st FROM segments),
f AS (SELECT *, greatest(coalesce(max(st) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS floor_ FROM c)
SELECT doc_id, chunk_id, CASE WHEN st >= floor_ - 0.5 THEN round(st, 3) END AS "start" FROM f""",
    "tail_ratio": """
WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS sq FROM embeddings),
q AS (SELECT vec_id, sqrt(list_sum(sq) / len(sq)) AS whole, sqrt(list_sum(sq[greatest(len(sq) - 15, 1):]) / least(len(sq), 16)) AS tail FROM p)
SELECT vec_id, round(CASE WHEN whole = 0 THEN 0.0 ELSE tail / whole END, 5) AS ratio FROM q""",
    "choose_take": """
WITH t AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS take, floor(l_quantity)::BIGINT % 7 AS lost, round(l_discount::DOUBLE * 10 + 0.0, 6) AS tail FROM lineitem),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS takes, row_number() OVER (PARTITION BY doc_id ORDER BY lost, tail, take) AS r FROM t)
SELECT doc_id, take, lost, tail, lost = 0 AND tail <= 0.55 AS clean, takes FROM r WHERE r = 1""",
    "repeat_share": f"""
WITH {_PAIRS}, w AS (SELECT id, {_CLEAN('hyp')} AS a, {_CLEAN('ref')} AS b FROM pairs)
SELECT id, round(CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_filter(a, lambda x: list_contains(b, x))) / len(a) END, 9) AS share FROM w""",
    "spoken_length": f"""
SELECT doc_id, round_even(length(text) + 3 * (length(text) - length(regexp_replace(text, '{text.DENSE}', '', 'g'))) + 0.54 * (length(text) - length(regexp_replace(text, '{text.ABJAD}', '', 'g'))), 0)::BIGINT AS units FROM documents""",
    "ledger_state": f"WITH {_EVENTS} SELECT path, seq, status, error FROM state",
    "ledger_summary": f"WITH {_EVENTS} SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in rules.STATUSES) + ", count(*) AS total FROM state",
    "ledger_retry_failed": f"WITH {_EVENTS} SELECT path, 'pending' AS status FROM state WHERE status = 'failed'",
    "ledger_reset_interrupted": f"WITH {_EVENTS} SELECT path, 'pending' AS status FROM state WHERE status = 'in_progress'",
    "failure_runs": f"""
WITH {_EVENTS}, f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, seq) - row_number() OVER (PARTITION BY path, error ORDER BY ts, seq) AS island FROM events0 WHERE status = 'failed')
SELECT path, error, min(seq) AS first_seq, count(*) AS failures FROM f GROUP BY path, error, island HAVING count(*) >= 3""",
    "next_pending": f"WITH {_EVENTS} SELECT path, seq FROM state WHERE status = 'pending' ORDER BY ts, seq, path LIMIT 5",
    "adopt_unfinished": f"WITH {_EVENTS} SELECT path, 'pending' AS status FROM state WHERE status IN ('pending', 'in_progress') AND seq % 2 <> 0",
    "purgeable_uploads": f"WITH {_EVENTS} SELECT count(*) AS files, coalesce(sum(seq), 0)::BIGINT AS bytes FROM state WHERE status NOT IN ('pending', 'in_progress')",
    "scan_catalog": f"WITH {_FILES} SELECT path, dir FROM files WHERE lower(ext) IN ('.mp3', '.mp4', '.wav')",
    "pair_reference_text": f"""
WITH {_FILES}, t AS (SELECT dir, stem FROM files WHERE doc_id % 3 = 0 UNION ALL SELECT '/texts', upper(stem) FROM files WHERE doc_id % 3 = 1 UNION ALL SELECT dir, stem || 'b' FROM files WHERE doc_id % 3 = 2),
m AS (SELECT f.path, t.dir || '/' || t.stem || '.txt' AS text_path, CASE WHEN t.dir = f.dir AND t.stem = f.stem THEN 1 WHEN t.dir = f.dir THEN 2 WHEN t.dir = '/texts' OR starts_with(t.dir, '/texts/') THEN 3 END AS how FROM files f LEFT JOIN t ON lower(t.stem) = lower(f.stem) WHERE f.ext <> '.txt'),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY how NULLS LAST, text_path) AS r FROM m)
SELECT path, CASE WHEN how IS NOT NULL THEN text_path END AS text_path, how FROM r WHERE r = 1""",
    "plan_output_paths": f"""
WITH {_FILES}, t AS (SELECT path, format, regexp_replace(dir, '^/src', '/out') || '/' || stem || '.' || format AS target FROM files, (SELECT unnest(['txt', 'srt', 'json']) AS format))
SELECT *, count(*) OVER (PARTITION BY target) AS clashes FROM t""",
    "stage_plan": f"""
WITH {_FILES}, s AS (SELECT 'transcribe' AS stage, NULL::VARCHAR AS lang FROM files WHERE ext <> '.txt' UNION ALL SELECT 'translate', unnest(['es', 'ru']) FROM files)
SELECT stage, lang, count(*) AS n FROM s GROUP BY stage, lang""",
    "chrf": rf"""
WITH {_PAIRS}, c AS (SELECT id, regexp_replace(hyp, '\s+', '', 'g') AS h, regexp_replace(ref, '\s+', '', 'g') AS r FROM pairs), k AS (SELECT unnest(range(1, 7)) AS n),
hg AS (SELECT id, n, substring(h, i, n) AS g, count(*) AS c FROM (SELECT id, h, n, unnest(range(1, length(h) - n + 2)) AS i FROM c, k) GROUP BY ALL),
rg AS (SELECT id, n, substring(r, i, n) AS g, count(*) AS c FROM (SELECT id, r, n, unnest(range(1, length(r) - n + 2)) AS i FROM c, k) GROUP BY ALL),
m AS (SELECT id, n, sum(least(coalesce(hg.c, 0), coalesce(rg.c, 0))) AS m, sum(hg.c) AS h, sum(rg.c) AS r FROM hg FULL JOIN rg USING (id, n, g) GROUP BY id, n),
s AS (SELECT id, avg(m / h) AS p, avg(m / r) AS r FROM m WHERE h > 0 AND r > 0 GROUP BY id)
SELECT pairs.id, round(coalesce(CASE WHEN p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) END, 0.0), 6) AS chrf FROM pairs LEFT JOIN s ON s.id = pairs.id""",
    "content_stems": rf"""
WITH {_PAIRS}, w AS (SELECT id, unnest(regexp_extract_all(lower(ref), '\p{{L}}{{4,}}')) AS w FROM pairs), s AS (SELECT DISTINCT id, substring(w, 1, 5) AS stem FROM w WHERE w NOT IN ({', '.join(f"'{x}'" for x in rules.STOPWORDS)}))
SELECT id, count(*) AS stems, min(stem) AS first_stem FROM s GROUP BY id""",
    "missing_runs": f"""
WITH {_WORDS}, l AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM words WHERE pos % 17 = 5 OR pos BETWEEN 40 AND 47)
SELECT doc_id, min(pos) AS first, count(*) AS n FROM l GROUP BY doc_id, island""",
}
