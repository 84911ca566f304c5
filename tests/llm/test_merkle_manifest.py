"""The manifest against plain trees, and the three queries with SQL against DuckDB."""

import hashlib
import zlib

import pytest
from oracle import duck, sparked

from lectern.llm import merkle_manifest, registry


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, siblings by level of each leaf: (left, right))."""
    level, proofs = [(d, [k]) for k, d in enumerate(leaves)], [[] for _ in leaves]
    while len(level) > 1:
        up = []
        for s in range(0, len(level), 8):
            run = level[s : s + 8]
            for k, (_, below) in enumerate(run):
                for b in below:
                    proofs[b].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])))
            up.append((h(*(d for d, _ in run)), [b for _, x in run for b in x]))
        level = up
    return level[0][0], proofs


def expected(rows):
    def leaf(r, low):
        text = r["text"]
        if low and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    langs = {}
    for r in rows:
        due = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        langs.setdefault((r["lang"] is not None, (r["lang"] or "").encode()), []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, False), leaf(r, due)))
    keys = sorted(langs)
    trees = {k: tree([x[2] for x in sorted(langs[k])]) for k in keys}
    root, tops = tree([trees[k][0] for k in keys]) if keys else (None, [])
    out = []
    for k, top in zip(keys, tops):
        sub, proofs = trees[k]
        for (known, doc_id, digest, now), proof in zip(sorted(langs[k]), proofs):
            path = proof + top
            for left, right in path:
                now = h(left, now, right)
            out.append((doc_id if known else None, digest, sub, root, h(*(a + b for a, b in path)), now, now == root))
    return sorted(map(str, out))


def rows_of(n, lang):
    return [{"doc_id": (i * 7919) % 100003, "source": None if i % 5 == 0 else "s", "lang": lang, "n_chars": i, "text": f"Text {i}" if i % 3 else None} for i in range(n)]


def query(spark, tmp_path, rows):
    df = spark.createDataFrame([tuple(r[k] for k in ("doc_id", "source", "lang", "n_chars", "text")) + ("x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, pos string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(str(tuple(r)) for r in merkle_manifest.op12_merkle_manifest(spark, str(tmp_path)).collect())


def test_trees_of_many_shapes(spark, tmp_path):
    rows = rows_of(1200, "en") + rows_of(65, "de") + rows_of(1, "fr") + rows_of(8, "") + rows_of(9, None) + rows_of(513, "é")
    rows += [{"doc_id": k, "source": "", "lang": f"x{k % 9}", "n_chars": None, "text": "Ünï " * 9000} for k in range(20)]
    rows += [{"doc_id": None, "source": None, "lang": "en", "n_chars": None, "text": "A"}, {"doc_id": 3, "source": None, "lang": "en", "n_chars": None, "text": "A"}, {"doc_id": 3, "source": None, "lang": "en", "n_chars": None, "text": "B"}]
    assert query(spark, tmp_path, rows) == expected(rows)


def test_one_language_and_empty(spark, tmp_path):
    assert query(spark, tmp_path / "one", rows_of(1, "en")) == expected(rows_of(1, "en"))
    assert query(spark, tmp_path / "none", []) == []


def test_equal_rows(spark, tmp_path):
    """Rows that are equal in everything stand next to each other; every one has a proof of its own place."""
    rows = rows_of(10, "en") + rows_of(1, "en") * 9
    assert query(spark, tmp_path, rows) == expected(rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb(spark, name):
    assert sparked(registry.QUERIES[name](spark, "/root/testdata/sf0.001")) == duck(registry.ORACLES[name], "/root/testdata/sf0.001")
