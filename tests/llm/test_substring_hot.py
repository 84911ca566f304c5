"""Passages that very many documents share, long documents over several parts, and the query against brute force."""

import hashlib
import random

import pytest

from lectern.llm import substring_dedup as sd

DATA = "/root/testdata/sf0.001"


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256 of what is kept) for (doc_id, bytes)."""
    first, out = {}, []
    for i, b in sorted(rows):
        for p in range(len(b) - sd.SPAN + 1):
            first.setdefault(b[p : p + sd.SPAN], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - sd.SPAN + 1):
            if first[b[p : p + sd.SPAN]] < i:
                gone[p : p + sd.SPAN] = b"\1" * sd.SPAN
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def crowd(seed=2):
    r = random.Random(seed)
    own = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, other = own(300), own(90)
    texts = [own(r.randint(0, 90)) + (passage if i % 3 else other) + own(r.randint(0, 90)) for i in range(160)]
    return [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(2000, passage + other), (2001, other * 3), (2002, "ab" * 400)]


@pytest.mark.parametrize("hot", [3, 10**9])
def test_split_anchors_give_the_same(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    answer = sd.answer_anchors

    def told(rows):  # workers import the module anew, so the bound goes with the function
        sd.HOT = hot
        return answer(rows)

    monkeypatch.setattr(sd, "answer_anchors", told)
    d = spark.createDataFrame(crowd(), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sd.without_repeats(d).collect())
    assert got == brute([(i, t.encode()) for i, t in crowd()])


def test_parts_of_a_long_document(monkeypatch):
    import pyarrow as pa

    rows = crowd(3)
    table = lambda ids, texts: pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})
    whole = sd.Chunk(table([i for i, _ in rows], [t for _, t in rows]))
    monkeypatch.setattr(sd, "PART", 64)
    parts = sd.Chunk(table([i for i, _ in rows], [t for _, t in rows]))
    cover = lambda c: {(int(s) + k, int(a), int(d)) for s, w, a, d in zip(c.start, c.windows, c.anchor, c.doc) for k in range(int(w))}
    assert cover(whole) == cover(parts)
    assert len(cover(whole)) == sum(max(0, len(t) - sd.SPAN + 1) for _, t in rows)


def test_query_over_the_whole_table(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op1_suffix_dedup(spark, DATA).collect())
    assert got == brute(docs)
