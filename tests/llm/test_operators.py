"""The operators against brute force or the libraries, with nulls, empty and long texts, repeated rows and extra columns."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_personal_data import base

from lectern.llm import byte_pairs, decontaminate, main_text, personal_data, quality, simhash, substring_dedup, suffix_arrays, token_counts, token_files, weighted_samples

SCHEMA = "doc_id long, text string, chunk string, shard string, fp string, n string"


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    shared = " ".join(word() for _ in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "𝔘𝔫𝔦 日本 ▁ \x1c <|endoftext|> it's"), (6, "x" * 9000), (7, shared), (8, "pre " + shared + " post"), (9, shared), (9, shared), (9, "other " + shared), (10, "ab " * 500), (11, "ab " * 501), (None, "a text without an id " + shared), (None, None)]
    rows += [(20 + i, " ".join(word() for _ in range(r.randint(1, 200))) + "\n" * r.randint(0, 2) + " ".join(word() for _ in range(20))) for i in range(30)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "c", "s", "f", "n") for i, t in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(i, t or "") for i, t in corpus()]


def test_token_counts(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((str(i), len(t.encode()), len(sp.encode(t))) for i, t in texts())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs).collect()) == want
    assert token_counts.token_counts(empty).count() == 0
    counter = token_counts.TokenCounter(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(1)
    for _ in range(500):
        t = "".join(r.choice("ab  \n\t'é日²s.!0▁\x00") for _ in range(r.randint(0, 60)))
        assert counter.count(t, 7) == counter.count(t) == len(sp.encode(t)), t


def test_byte_pairs(docs, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(i), np.array(lib.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in texts())
    assert sorted((str(r.doc_id), bytes(r.token_ids), bytes(r.decoded)) for r in byte_pairs.byte_pair_round_trip(docs).collect()) == want
    assert byte_pairs.byte_pair_round_trip(empty).count() == 0


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    token_files.write_token_files(docs, f"file://{tmp_path}/a")
    got = token_files.read_token_files(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    assert sorted((str(r.doc_id), bytes(r.token_ids)) for r in got) == sorted((str(i), np.array(lib.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in texts())
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    token_files.write_token_files(empty, f"file://{tmp_path}/b")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/b").count() == 0
    codes = np.array([0, 255, 256, 70000, 2**31, 5], np.uint32)
    assert [token_files.Codes(token_files.pack_codes(codes)).get(i) for i in range(6)] == codes.tolist()
    assert zlib.crc32(b"") == 0


def test_suffix_arrays():
    r = random.Random(3)
    for n, letters in itertools.product((1, 2, 30, 300), (1, 2, 5, 250)):
        s = np.array([r.randint(1, letters) for _ in range(n)] + [0], np.uint16)
        assert suffix_arrays.suffix_array(s, 258).tolist() == sorted(range(n + 1), key=lambda i: tuple(s[i:]))


def test_substring_dedup(docs, empty):
    rows = [(math.inf if i is None else i, t.encode()) for i, t in texts()]
    first = {}
    for i, b in sorted(rows):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    want = []
    for i, b in rows:
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want.append((str(None if i == math.inf else i), len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup.without_repeats(docs).collect()]
    assert sorted(got) == sorted(want)
    assert substring_dedup.without_repeats(empty).count() == 0


def test_simhash(spark, docs, empty):
    from xxhash import xxh64_intdigest

    def fingerprint(t):
        w = t.encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(i, fingerprint(t)) for i, t in texts() if i is not None]
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.simhash_groups(docs).collect()]
    assert sorted((i, f) for i, f, _ in got if i is not None) == sorted(rows)
    assert {(i, c) for i, _, c in got if i is not None} == components(rows)
    assert simhash.simhash_groups(empty).count() == 0
    r = random.Random(9)
    base = r.getrandbits(64)
    crowd = {base}
    while len(crowd) < 60:
        crowd.add(r.choice(sorted(crowd)) ^ 1 << r.randrange(64) ^ (1 << r.randrange(64) if r.random() < 0.5 else 0))
    crowd |= {r.getrandbits(64) for _ in range(40)}
    rows = list(enumerate(sorted(crowd, key=lambda x: x * 2654435761 % 997)))
    reps = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in rows], "fp long, rep long")
    for group in (1, 8, 1000):
        linked = {(x.node, x.component) for x in simhash.connected_components(simhash.near_links(reps, group)).collect()}
        assert linked == {(i, c) for i, c in components(rows) if sum(c == d for _, d in components(rows)) > 1}


def components(rows):
    """(id, smallest id reachable) of every row; rows with one id are linked by their fingerprints alone."""
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (j, (_, f)), (k, (_, g)) in itertools.combinations(enumerate(rows), 2):
        if (f ^ g).bit_count() <= 2:
            parent[root(j)] = root(k)
    least = collections.defaultdict(lambda: math.inf)
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least[root(k)], i)
    return {(i, least[root(k)]) for k, (i, _) in enumerate(rows)}


def test_weighted_samples(docs, empty):
    rows = [(i, t) for i, t in texts() if i is not None]
    order = sorted({i for i, _ in rows}, reverse=True)
    got = weighted_samples.weighted_fingerprints(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t)) for i, t in texts())
    once = dict(rows)
    for r in got:
        if r.doc_id in (None, 9):
            continue
        below = order[order.index(r.doc_id) + 1] if r.doc_id != order[-1] else None
        if below in (None, 9):
            continue
        t, nxt = once[r.doc_id], once[below]
        m = len(t) // 3
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert weighted_samples.weighted_fingerprints(empty).count() == 0


def test_quality(spark, docs, empty):
    r = random.Random(4)
    clean = lambda: " ".join(r.choice(["the", "river", "runs", "past", "old", "mills", "slowly"]) for _ in range(80)) + "."
    rows = [(i, clean() if i % 3 else clean().upper().replace(" ", "!! ")) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 0), (500, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(d, labels)
    got = {x.doc_id: x.score for x in quality.quality_scores(d, model).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.3) == (i % 3 > 0) for i in held)
    assert quality.keep_good(d, model).count() == sum(s >= 0.3 for s in got.values())
    assert all(0 <= x.score <= 1 for x in quality.quality_scores(docs, model).collect())
    assert quality.quality_scores(empty, model).count() == 0
    one = quality.fit_quality(d, labels.where("quality = 1"))
    assert quality.quality_scores(d, one).agg(F.min("score")).first()[0] > 0.9


def test_decontaminate(spark, docs, empty):
    masks = decontaminate.MASKS
    for bad in itertools.combinations(range(decontaminate.WINDOW), 2):
        assert any(not set(bad) & {o + i for i in m} for m in masks for o in range(decontaminate.WINDOW - m[-1]))
    item = " ".join(f"w{i}" for i in range(30))
    swapped = " ".join("zz" if i in (5, 18) else f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, "x y " + item + " z"), (2, swapped), (3, "w1 w2 w3 nothing else"), (4, None), (5, ""), (6, item.upper() + "!"), (6, item), (7, "tiny one here")], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "tiny one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(d, b).collect()}
    assert got == {(1, 1), (2, 1), (6, 1), (7, 4)}
    assert {(r.item_id, r.class_id) for r in decontaminate.item_classes(b).collect()} == {(1, 1), (2, 1), (4, 4)}
    assert decontaminate.contamination(empty, b).count() == 0 and decontaminate.contamination(d, b.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.without_contaminated(d, b).collect()} == {3, 4, 5}


def test_personal_data(spark, empty):
    d = spark.createDataFrame([(1, "mail a.b@c.org_d@e.fr or +1 (017) 555-7713, 10.0.0.256 1.2.3.4.5.6.7.8"), (2, "card 4111 1111 1111 1111 and 4111111111111112"), (3, None), (4, ""), (5, "𝔘 x@y.de " + "9 " * 4000), (5, "𝔘 x@y.de"), (6, "a" * 50000 + "@")], "doc_id long, text string")
    rows = {r.doc_id: r for r in personal_data.personal_spans(d).where("doc_id <> 5").collect()}
    kinds = lambda r: [(personal_data.KINDS[x.kind], x.start, x.stop) for x in r["_base"]]
    assert kinds(rows[1]) == base("mail a.b@c.org_d@e.fr or +1 (017) 555-7713, 10.0.0.256 1.2.3.4.5.6.7.8")
    assert kinds(rows[2]) == [("card", 5, 24)]
    assert kinds(rows[3]) == kinds(rows[4]) == kinds(rows[6]) == []
    out = {r.doc_id: r.text for r in personal_data.masked(d).where("doc_id < 5").collect()}
    assert "<EMAIL>" in out[1] and "555-7713" not in out[1] and out[2].startswith("card <CARD> and") and out[3] is None
    assert personal_data.personal_spans(empty).count() == 0


def test_main_text():
    page = """<html><head><title>t</title><script>x("<p>no</p>")</script></head><body><header>Site</header><nav><a>Menu</a></nav>
    <div class="cookie-notice">We use cookies and so on, a long notice that has many words in it.</div>
    <div id="content"><h1>Head</h1><p>First &amp; <b>bold</b>  part.<p>Second part of the text, which is longer.</p><div class="ad">Buy</div><ul><li>one</li><li>two</li></ul></div>
    <aside>side</aside><section class="comments"><p>A reader says something long and of no matter here.</p></section><form>f</form><footer>foot</footer></body></html>"""
    assert main_text.main_text(page) == "Head First & bold part. Second part of the text, which is longer. one two"
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<nav>x</nav>") == ""


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = {r.doc_id for r in got.collect()}
    assert 0 < len(ids) < 200 and got.columns == ["doc_id", "n_tokens", "token_ids", "decoded_sha256"]
    assert collections.Counter(re.sub(r"\d", "", str(type(i))) for i in ids)
