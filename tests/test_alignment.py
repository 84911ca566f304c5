"""Matching blocks against a plain search for longest common runs; times, error rates and files on top of them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import alignment, scoring, segmenting
from lectern.plans import registry
from lectern.sources import fixtures, transcripts

DATA = "/root/testdata/sf0.001"


def blocks(a, b):
    """(i, j, size): the longest common run, the first in a, then in b; then left and right of it; neighbours joined."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i1, i2, j1, j2 = todo.pop()
        best = (0, 0, 0)
        lengths = {}
        for i in range(i1, i2):
            row = {}
            for j in range(j1, j2):
                if a[i] == b[j]:
                    k = row[j] = lengths.get(j - 1, 0) + 1
                    best = max(best, (k, -(i - k + 1), -(j - k + 1)))
            lengths = row
        k, i, j = best[0], -best[1], -best[2]
        if k:
            out.append((i, j, k))
            todo += [(i1, i, j1, j), (i + k, i2, j + k, j2)]
    joined = []
    for i, j, k in sorted(out):
        if joined and (joined[-1][0] + joined[-1][2], joined[-1][1] + joined[-1][2]) == (i, j):
            joined[-1] = (*joined[-1][:2], joined[-1][2] + k)
        else:
            joined.append((i, j, k))
    return joined


def regions(a, b):
    out, i, j = [], 0, 0
    for x, y, k in [*blocks(a, b), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append(("delete" if j == y else "insert" if i == x else "replace", i, x, j, y))
        if k:
            out.append(("equal", x, x + k, y, y + k))
        i, j = x + k, y + k
    return out


def rows():
    r = random.Random(3)
    out = [(1, None, None), (2, [], ["a"]), (3, ["a"], []), (4, ["a", "b"], ["a", "b"]), (None, ["a"], ["b"])]
    for k in range(60):
        a = [r.choice("abcdef") for _ in range(r.randrange(40))]
        b = [x for x in a if r.random() < 0.8]
        for _ in range(r.randrange(4)):
            b.insert(r.randrange(len(b) + 1), r.choice("abcxyz"))
        out.append((10 + k, a, b))
    return out


def test_edit_regions_and_error_rate(spark):
    data = rows()
    df = spark.createDataFrame(data, "id long, ref array<string>, hyp array<string>")
    got = {}
    for x in alignment.edit_regions(df).collect():
        got.setdefault(x.id, []).append((x.kind, x.i1, x.i2, x.j1, x.j2))
        a, b = next((a or [], b or []) for i, a, b in data if i == x.id)
        assert (x.spoken, x.heard) == (" ".join(a[x.i1 : x.i2]), " ".join(b[x.j1 : x.j2]))
    assert got == {i: regions(a or [], b or []) for i, a, b in data if (a or b)}
    rates = {x.id: (x.edits, x.n, x.lost) for x in alignment.error_rate(df.where("id IS NOT NULL"), lost_at=3).collect()}
    want = {}
    for i, a, b in data:
        if i is not None:
            other = [r for r in regions(a or [], b or []) if r[0] != "equal"]
            want[i] = (sum(max(r[2] - r[1], r[4] - r[3]) for r in other), len(a or []), sum(r[2] - r[1] for r in other if r[0] == "delete" and r[2] - r[1] >= 3))
    assert rates == want | {None: tuple(map(sum, zip(*want.values())))}
    assert alignment.edit_regions(df.limit(0)).count() == 0


def test_blocks_of_repeats_and_odd_tokens(spark):
    r = random.Random(8)
    odd = ["\u0001", "\\", "\\0", "", "a", "a\u0001", "\u0001a"]
    pairs = [(["a"] * 90, ["a"] * 61), (["a", "b"] * 40, ["b", "a"] * 33), ([None, "a", "\\0"], ["\\0", None, "a"]), ([], [""]), ([""], [])]
    pairs += [([r.choice(odd) for _ in range(r.randrange(30))], [r.choice(odd) for _ in range(r.randrange(30))]) for _ in range(60)]
    pairs += [([r.choice("ab") for _ in range(80)], [r.choice("ab") for _ in range(80)]) for _ in range(20)]
    long = [str(r.randrange(50)) for _ in range(3000)]
    pairs += [(long, long[:1000] + long[1400:]), (long, long)] + pairs[:3]
    df = spark.createDataFrame([(k % 7, a, b, "x") for k, (a, b) in enumerate(pairs)], "id long, ref array<string>, hyp array<string>, blocks_of string")
    found = alignment.matching_blocks(df)
    assert found.columns == ["id", "ref", "hyp", "blocks_of", "blocks"]
    got = sorted((str(x.ref), str(x.hyp), [tuple(b) for b in x.blocks]) for x in found.collect())
    exact = {}
    for a, b in pairs:
        want = [(0, 0, 1000), (1400, 1000, 1600)] if (len(a), len(b)) == (3000, 2600) else [(0, 0, 3000)] if a is b else blocks(a, b)
        exact[str(a), str(b)] = [*want, (len(a), len(b), 0)]
    assert got == sorted((str(a), str(b), exact[str(a), str(b)]) for a, b in pairs)


def test_align_text_to_words(spark):
    chunks = spark.createDataFrame([(1, 0, "A b.", ["a", "b"]), (1, 1, "C d.", ["c", "d"]), (1, 2, "E", ["e"]), (1, 3, "g h", ["g", "h"]), (2, 0, "x", ["x"])], "doc_id long, chunk_id int, text string, words array<string>")
    words = spark.createDataFrame([(1, 0, "A", 1.0, 1.5), (1, 1, "b,", 1.5, 2.0), (1, 2, "zzz", 2.0, 9.0), (1, 3, "D", None, None), (1, 4, "e", 0.1, 0.2), (1, 5, "G", 3.0, 4.0)], "doc_id long, pos int, word string, start double, end double")
    got = [tuple(x) for x in alignment.align_text_to_words(chunks, words).orderBy("doc_id", "chunk_id").collect()]
    assert got == [(1, 0, "A b.", 1.0, 2.0, 2), (1, 1, "C d.", None, None, 0), (1, 2, "E", None, None, 0), (1, 3, "g h", 3.0, 4.0, 1), (2, 0, "x", None, None, 0)]


def test_queries_on_whole_texts(spark):
    texts = {r.doc_id: (r.text or "").split() for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.id: (r.edits, r.n) for r in registry.QUERIES["error_rate"](spark, DATA).collect() if r.id is not None}
    assert got.keys() == texts.keys()
    for i, a in sorted(texts.items(), key=lambda x: len(x[1]))[:80]:
        b = ["zzz" if k % 23 == 7 else w for k, w in enumerate(a) if k % 17 != 5 and not 40 <= k <= 47]
        assert got[i] == (sum(max(r[2] - r[1], r[4] - r[3]) for r in regions(a, b) if r[0] != "equal"), len(a))


def test_times_on_whole_texts(spark):
    """The query's rows of the shorter texts against the plain search, times that go backwards dropped."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    chunks, heard = {}, {}
    for r in segmenting.chunk_text(docs, "sentence").orderBy("doc_id", "chunk_id").collect():
        chunks.setdefault(r.doc_id, []).append(r.words)
    for r in fixtures.heard(spark, DATA).withColumn("w", text.normalise_token(F.col("word"))).orderBy("doc_id", "pos").collect():
        heard.setdefault(r.doc_id, []).append((r.w, r.pos * 2 / 5, r.pos * 2 / 5 + 0.25))
    got = {(r.doc_id, r.chunk_id): (r.start, r.end, r.matched) for r in registry.QUERIES["align_text_to_words"](spark, DATA).collect()}
    assert got.keys() == {(i, k) for i, cs in chunks.items() for k in range(len(cs))}
    checked = 0
    for i, cs in sorted(chunks.items(), key=lambda x: sum(map(len, x[1])))[:120]:
        said, told = heard.get(i, []), [(k, w) for k, c in enumerate(cs) for w in c]
        times = {}
        for x, y, size in blocks([w for _, w in told], [w for w, _, _ in said]):
            for k in range(size):
                times.setdefault(told[x + k][0], []).append(said[y + k][1:])
        latest = 0.0
        for k in range(len(cs)):
            want = (None, None, 0)
            if k in times and min(t[0] for t in times[k]) >= latest - 0.5:
                latest = max(latest, min(t[0] for t in times[k]))
                want = (min(t[0] for t in times[k]), max(t[1] for t in times[k]), len(times[k]))
            assert got[i, k] == want
            checked += want[2] > 0
    assert checked > 100


def test_json_there_and_back(spark, tmp_path):
    segments = spark.createDataFrame([(1, 0, 0.12345, 1.0, " Hi. "), (1, 1, 1.0, 2.0, " "), (1, 2, 2.0, 3.0, 'a "b"')], "doc_id long, seg_id long, start double, end double, text string")
    docs = spark.createDataFrame([(1, "a.mp3", "en", 3.0, "sentence"), (2, "b.mp3", None, None, "sentence")], "doc_id long, source string, language string, duration double, granularity string")
    made = {r.doc_id: json.loads(r.body) for r in transcripts.transcript_json(segments, docs).collect()}
    assert made[1]["segments"] == [{"id": 0, "start": 0.123, "end": 1.0, "text": "Hi."}, {"id": 2, "start": 2.0, "end": 3.0, "text": 'a "b"'}]
    assert made[2] == {"version": 1, "kind": "transcription", "source": "b.mp3", "language": None, "duration": None, "segments": []}
    chunks = segments.select("doc_id", segments.seg_id.alias("chunk_id"), "text", segments.start.alias("start"), "end")
    aligned = json.loads(transcripts.alignment_json(chunks, docs).where("doc_id = 1").first().body)
    assert aligned["summary"] == {"granularity": "sentence", "chunks": 3, "timed": 3, "unmatched": 0}
    for name, body in (("a", made[1]), ("b", aligned), ("c", {"version": 9})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "d.json").write_text("{broken")
    back = transcripts.read_transcript_json(spark, str(tmp_path))
    assert [(r.seg_id, r.text, r.kind) for r in back["segments"].collect()] == [(0, "Hi.", "transcription"), (2, 'a "b"', "transcription")]
    assert back["chunks"].count() == 3
    assert sorted(r.path[-6:] for r in back["refused"].collect()) == ["c.json", "d.json"]


def test_texts_in_and_out(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"\xef\xbb\xbfone\ntwo\xff")
    assert [r.text for r in transcripts.read_text_corpus(spark, str(tmp_path / "x.txt")).collect()] == ["one\ntwo�"]
    segments = spark.createDataFrame([(1, 0, "One. Two"), (1, 1, "three."), (2, 0, None)], "doc_id long, seg_id long, text string")
    txt = transcripts.render_txt(segments)
    assert {r.doc_id: r.body for r in txt.collect()} == {1: "One.\nTwo three.\n", 2: ""}
    transcripts.write_outputs({"txt": txt}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("format = 'txt'").count() == 2
    again = txt.where("doc_id = 1")
    transcripts.write_outputs({"txt": again}, str(tmp_path / "out"))
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
    broken = txt.select("doc_id", F.raise_error(F.lit("no")).alias("body"))
    with pytest.raises(Exception, match="no"):
        transcripts.write_outputs({"txt": broken}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_missing_citations_within_missing_stretches(spark):
    rows = [(1, "第三章第五節第五节", "", ["说第三章"]), (2, "第三章", None, None), (3, "第三章", "第三张", ["x"])]
    df = spark.createDataFrame(rows, "id long, spoken string, heard string, gone array<string>")
    plain = {(r.id, r.citation, r.short) for r in scoring.missing_citations(df).collect()}
    assert plain == {(1, "第三章", 1), (1, "第五节", 2), (2, "第三章", 1)}
    assert {(r.id, r.citation) for r in scoring.missing_citations(df, stretches="gone").collect()} == {(1, "第五节"), (2, "第三章")}
