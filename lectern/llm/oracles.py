"""DuckDB SQL of the queries of this folder that SQL can say."""

from __future__ import annotations

from .merkle_manifest import ARITY, LOWER, UPPER

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{u}', '{l}'), '[\x20\x09-\x0D]+'), lambda w: w <> '')".format(u=UPPER, l=LOWER)

NGRAM_JOIN = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM docs),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  WHERE 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(y) FROM reach WHERE x = doc_id) AS component_id FROM sets
"""

HARD_NEGATIVES = """
WITH base AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows AS (SELECT vec_id, min(struct_pack(label := label, v := v)) AS r FROM base GROUP BY vec_id),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.r.label = b.r.label AS same,
    list_sum(list_transform(list_zip(a.r.v, b.r.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, coalesce(score, 0) AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
met AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score FROM positives p JOIN scored s
  ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)::INT AS rank,
  negative_id, positive_score, negative_score
FROM met QUALIFY rank <= 3
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    step = "lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(range(8), {step}, xor(crc, code))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda crc, code: {byte}, 4294967295::BIGINT), 4294967295)"


def _manifest(levels: int = 8, top: int = 4) -> str:
    """The trees level by level; enough levels for 8^levels rows of a language and 8^top languages."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    digest = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"

    def tree(kind: str, n: int) -> str:
        parts = []
        for k in range(n):
            grouped = f"FROM {kind}{k} GROUP BY tree, i // {ARITY}"
            parts.append(f"{kind}_kids{k} AS (SELECT tree, i // {ARITY} AS i, any_value(n) AS n, list(d ORDER BY i) AS kids {grouped})")
            parts.append(f"{kind}{k + 1} AS (SELECT tree, i, (n + {ARITY - 1}) // {ARITY} AS n, CASE WHEN n > 1 THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS d FROM {kind}_kids{k})")
        return ",\n".join(parts)

    def fold(kind: str, n: int, source: str) -> str:
        """p (siblings so far) and f (digest so far) of `source` (id, tree, i, p, f), level by level."""
        parts, last = [], source
        for k in range(n):
            slot = f"((x.i // {ARITY**k}) % {ARITY})"
            left, right = f"array_to_string(s.kids[1:{slot}], '')", f"array_to_string(s.kids[{slot} + 2:], '')"
            parts.append(f"{kind}_fold{k} AS (SELECT x.id, x.tree, x.i, CASE WHEN s.n > 1 THEN x.p || {left} || {right} ELSE x.p END AS p, CASE WHEN s.n > 1 THEN sha256({left} || x.f || {right}) ELSE x.f END AS f FROM {last} x JOIN {kind}_kids{k} s ON x.tree = s.tree AND x.i // {ARITY ** (k + 1)} = s.i)")
            last = f"{kind}_fold{k}"
        return ",\n".join(parts)

    return f"""
WITH leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS tree, {digest("text")} AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {digest(lowered)} END AS tampered
  FROM documents),
t0 AS MATERIALIZED (
  SELECT id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, leaf AS d
  FROM leaves),
{tree("t", levels)},
u0 AS (SELECT '' AS tree, tree AS lang, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, d FROM t{levels}),
{tree("u", top)},
t_start AS (SELECT t0.id, t0.tree, t0.i, '' AS p, coalesce(tampered, leaf) AS f FROM t0 JOIN leaves USING (id)),
{fold("t", levels, "t_start")},
u_start AS (SELECT x.id, u0.tree, u0.i, x.p, x.f FROM t_fold{levels - 1} x JOIN u0 ON x.tree = u0.lang),
{fold("u", top, "u_start")}
SELECT l.doc_id, l.leaf, u0.d AS subroot, r.d AS root, sha256(x.p) AS proof_sha256, x.f AS folded_root, x.f = r.d AS verified
FROM leaves l JOIN u_fold{top - 1} x USING (id) JOIN u0 ON l.tree = u0.lang CROSS JOIN u{top} r
"""


MERKLE_MANIFEST = _manifest()
