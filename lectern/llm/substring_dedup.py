"""Removal of passages that stand in an earlier document: suffix arrays over shards of shared contexts.

Every window of SPAN bytes belongs to its smallest hash of GRAM bytes (the anchor, leftmost among equals), so equal
windows have equal anchors; neighbouring windows with one anchor form a context of SPAN bytes and a few more.

1. Each chunk of documents sends its distinct anchors to shards; a shard answers which ones other chunks have too.
2. Chunks send the distinct contexts of shared anchors (with their smallest doc_id) to the shard of the anchor.
3. A shard sorts the suffixes of its contexts by induced sorting and reads the permuted common prefixes: neighbours
   that share SPAN bytes are equal windows, and the smallest doc_id of such a group is the first document that holds
   the window. An anchor with one context only needs no sorting. It answers which windows of which context stand in a
   smaller document.
4. Chunks mark the covered bytes and cut them out.

A chunk sends an anchor or a context once however many of its documents repeat it, so a passage in a third of all
documents costs a shard one record for each chunk. At the passage's edges every document has a context of its own under
the same anchor. An anchor with more than HOT contexts is therefore split: its windows are dealt to the shards by their
own 64-bit hash, each once for a chunk with its smallest document, and a shard takes the minimum of each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored_bytes, table, tasks_for, whole_texts
from .pieces import binary_array
from .suffix_arrays import permuted_prefixes, suffix_array

SPAN = 50
GRAM = 24
PART = 1 << 20  # bytes hashed at once
CHUNK_BYTES = 4 << 20  # stored bytes of a chunk
SHARD_BYTES = 4 << 20  # stored input bytes for each shard
HOT = 256  # contexts of one anchor, summed over the chunks
LAST = 2**63 - 1
_P = [pow(0x9E3779B97F4A7C15, 2**k, 1 << 64) for k in range(6)]
LOW40 = np.uint64((1 << 40) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def _grams(data: np.ndarray):
    """Hashes of the 24, 32 and 8 bytes at each position (rolled up by doubling)."""
    h, kept = data.astype(np.uint64) + np.uint64(1), {}
    for k in range(5):
        w = 1 << k
        h = h[:-w] * np.uint64(_P[k]) + h[w:]
        kept[2 * w] = h
    g24 = kept[16][: len(data) - 23] * np.uint64(_P[3]) + kept[8][16:]
    return _mixed(g24), kept[32], kept[8]


def _all_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32 and 8 bytes at each position of `data` (32 bytes or more), PART positions at once. The last
    block may hold 8-byte grams only."""
    blocks = [_grams(data[a : a + PART + 64]) for a in range(0, len(data) - 31, PART)]
    g32, g8 = (np.concatenate([g[k][:PART] for g in blocks]) for k in (1, 2))
    at = len(g8)  # at the end of a whole block up to 24 grams are left
    if at < len(data) - 7:
        left = data[at:].astype(np.uint64) + np.uint64(1)
        for k in range(3):
            left = left[: -(1 << k)] * np.uint64(_P[k]) + left[1 << k :]
        g8 = np.concatenate([g8, left])
    return g32, g8


def _first_least(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest (by its upper 44 bits) of `width` neighbours from each position, the leftmost among
    equals. Up to 2^20 positions ride in the lower bits, so that one minimum finds both."""
    if len(g) <= 1 << 20:
        low = np.uint64((1 << 20) - 1)
        value, w = (g & ~low) | np.arange(len(g), dtype=np.uint64), 1
        while w < width:
            step = min(w, width - w)
            value = np.minimum(value[:-step], value[step:])
            w += step
        return (value & low).astype(np.int32)
    value, at, w = g >> np.uint64(20), np.arange(len(g), dtype=np.int32), 1
    while w < width:
        step = min(w, width - w)
        right = value[step:] < value[:-step]
        value, at = np.where(right, value[step:], value[:-step]), np.where(right, at[step:], at[:-step])
        w += step
    return at


class Chunk:
    """The documents of a chunk by doc_id, and the runs of windows that share an anchor."""

    def __init__(self, rows):
        import pyarrow as pa

        ids = rows.column("doc_id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)
        texts = rows.column("text").cast(pa.large_binary()).combine_chunks()
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
        digest = [hash_bytes(x.as_py()) for x in texts] if len(set(ids.tolist())) < len(ids) else [0] * len(ids)
        order = np.lexsort((digest, ids)) if len(ids) else np.zeros(0, np.int64)
        self.ids, self.sizes = ids[order], sizes[order]
        taken = texts.take(pa.array(order))
        start = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset] if len(taken) else 0
        self.data = np.frombuffer(taken.buffers()[2] or b"", np.uint8)[start : start + int(self.sizes.sum())]
        self.ends = np.cumsum(self.sizes)
        self.rank = np.unique(self.ids, return_inverse=True)[1] if len(ids) else np.zeros(0, np.int64)
        parts = [self._runs(base) for base in range(0, max(0, len(self.data) - SPAN + 1), PART)]
        joined = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2
        self.start, self.windows, self.anchor, self.content, self.offset, self.doc = joined

    def _runs(self, base: int):
        """Runs of the windows that begin in the part from `base`; long documents go over several parts."""
        data = self.data[base : base + PART + SPAN - 1]
        none = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2
        g24, g32, _ = _grams(data)
        least = _first_least(g24, SPAN - GRAM + 1)[: len(data) - SPAN + 1]
        lo, hi = np.searchsorted(self.ends, [base, base + len(least)], "right")
        ends = self.ends[lo : hi + 1] - base
        end_of = np.repeat(ends, np.diff(np.minimum(ends, len(least)), prepend=0))
        valid = np.arange(SPAN, SPAN + len(least)) <= end_of
        fresh = np.concatenate([[True], (least[1:] != least[:-1]) | ~valid[:-1]])
        start = np.flatnonzero(valid & fresh)
        if not len(start):
            return none
        last = np.flatnonzero(valid & np.concatenate([fresh[1:] | ~valid[1:], [True]]))
        size = last - start + SPAN
        return start + base, last - start + 1, g24[least[start]], _contents(g32, start, size), least[start] - start, lo + np.searchsorted(ends, start, "right")

    def distinct_anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, whether more than one document of the chunk has them, and how many runs have."""
        if not len(self.anchor):
            return self.anchor, np.zeros(0, bool), np.zeros(0, np.int64)
        order = np.argsort(self.anchor, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(self.anchor[order]) != 0]))
        rank = self.rank[self.doc[order]]
        return self.anchor[order][first], np.minimum.reduceat(rank, first) != np.maximum.reduceat(rank, first), np.diff(np.append(first, len(order)))

    def contexts(self, answers, hot, shards: int):
        """(runs of shared anchors, number of the distinct context of each, run that stands for each context): the one
        in the smallest document. Runs of hot anchors are left to `single_windows`."""
        anchors, many, _ = self.distinct_anchors()
        key = key_of(anchors, shards)
        known = (np.isin(key, answers) | many) & ~np.isin(key, hot)
        runs = np.flatnonzero(np.isin(self.anchor, anchors[known]))
        order = np.lexsort((runs, self.content[runs], self.anchor[runs]))
        a, c = self.anchor[runs[order]], self.content[runs[order]]
        fresh = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(c) != 0)]) if len(runs) else np.zeros(0, bool)
        number = np.zeros(len(runs), np.int64)
        number[order] = np.cumsum(fresh) - 1
        return runs, number, runs[order[fresh]]  # runs are in doc_id order, so the first is the smallest document's


    def single_windows(self, hot, shards: int):
        """The windows of the runs of hot anchors: (where each begins, its document, number of the distinct window,
        first place of each distinct window, their hashes)."""
        runs = np.flatnonzero(np.isin(key_of(self.anchor, shards), hot)) if len(hot) else np.zeros(0, np.int64)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for a in range(0, len(runs), 1 << 14):
            part = runs[a : a + (1 << 14)]
            windows, size = self.windows[part], self.windows[part] + SPAN - 1
            at = _ragged(np.cumsum(size) - size, windows)
            g32, _ = _all_grams(self.data[_ragged(self.start[part], size)])
            parts.append((_ragged(self.start[part], windows), np.repeat(self.doc[part], windows), _contents(g32, at, np.full(len(at), SPAN))))
        place, doc, hashes = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((place, hashes))
        fresh = np.concatenate([[True], np.diff(hashes[order]) != 0]) if len(order) else np.zeros(0, bool)
        number = np.zeros(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        return place, doc, number, order[fresh], hashes[order[fresh]]


def _contents(g32: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the `size` (50 to 76) bytes from each start."""
    return _mixed(g32[start] * np.uint64(3) + _mixed(g32[start + np.minimum(32, size - 32)]) * np.uint64(5) + g32[start + size - 32] * np.uint64(7) + size.astype(np.uint64))


def hash_bytes(b: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b) >> 1


def key_of(anchor: np.ndarray, shards: int) -> np.ndarray:
    """Shard and 40 bits of an anchor in one number; a rare chance agreement only adds contexts to compare."""
    return (anchor % np.uint64(shards)) << np.uint64(40) | (anchor // np.uint64(shards)) & LOW40


def _pack5(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack5(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _spread(shard: np.ndarray):
    """Rows of each shard: (shard, indexes)."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    return [(int(shard[x[0]]), x) for x in np.split(order, cuts)] if len(order) else []


def send_anchors(rows, shards: int):
    import pyarrow as pa
    import zstandard

    chunk = rows.column("chunk")[0].as_py()
    anchors, many, runs = Chunk(rows).distinct_anchors()
    key, press = key_of(anchors, shards), zstandard.ZstdCompressor(level=1).compress
    out = [(s, chunk, _pack5(key[x]), np.packbits(many[x]).tobytes(), press(np.minimum(runs[x], 255).astype(np.uint8).tobytes())) for s, x in _spread((key >> np.uint64(40)).astype(np.int64))]
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "chunk", "keys", "many", "runs"])


def answer_anchors(rows):
    """To each chunk: which of its anchors other chunks have too, and which ones are hot (their bits)."""
    import pyarrow as pa
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    shard, chunks = rows.column("shard")[0].as_py(), rows.column("chunk").to_pylist()
    keys = [_unpack5(b) for b in rows.column("keys").to_pylist()]
    many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[: len(k)] for b, k in zip(rows.column("many").to_pylist(), keys)]).astype(bool)
    runs = np.concatenate([np.frombuffer(open_(b), np.uint8) for b in rows.column("runs").to_pylist()])
    sizes = [len(k) for k in keys]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    fresh = np.concatenate([[True], np.diff(every[order]) != 0])
    group = np.cumsum(fresh) - 1
    shared = (np.bincount(group) > 1) | (np.bincount(group, many[order]) > 0)
    crowded = shared & (np.bincount(group, runs[order]) > HOT)
    tell, hot = np.zeros(len(every), bool), np.zeros(len(every), bool)
    tell[order], hot[order] = shared[group], crowded[group]
    tell &= ~many | hot
    cuts = np.cumsum([0, *sizes])
    out = [(c, shard, _pack5(every[a:b][tell[a:b]]), np.packbits(hot[a:b][tell[a:b]]).tobytes()) for c, a, b in zip(chunks, cuts[:-1], cuts[1:])]
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["chunk", "shard", "keys", "hot"])


def _answers(rows) -> tuple[np.ndarray, np.ndarray]:
    """Keys of shared anchors, and those of hot ones among them."""
    keys = [_unpack5(b) | np.uint64(s << 40) for s, b in zip(rows.column("shard").to_pylist(), rows.column("keys").to_pylist())]
    hot = [np.unpackbits(np.frombuffer(b, np.uint8))[: len(k)].astype(bool) for b, k in zip(rows.column("hot").to_pylist(), keys)]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(keys), np.concatenate(keys)[np.concatenate(hot)]


def send_contexts(rows, answers, shards: int):
    import pyarrow as pa
    import zstandard

    names = ["shard", "chunk", "number", "anchor", "first", "size", "offset", "bytes"]
    types = [pa.int32(), pa.int32()] + [pa.binary()] * 6
    if not rows.num_rows:
        return pa.table([pa.array([], t) for t in types], names)
    chunk, own = rows.column("chunk")[0].as_py(), Chunk(rows)
    known, hot = _answers(answers)
    _, _, stands = own.contexts(known, hot, shards)
    press, out = zstandard.ZstdCompressor(level=1).compress, []
    anchor, size = own.anchor[stands], own.windows[stands] + SPAN - 1
    first, start = own.ids[own.doc[stands]], own.start[stands]
    for s, x in _spread((anchor % np.uint64(shards)).astype(np.int64)):
        text = own.data[_ragged(start[x], size[x])].tobytes()
        out.append((s, chunk, press(np.diff(x, prepend=0).astype("<i4").tobytes()), _pack5(anchor[x] // np.uint64(shards) & LOW40), press(_columns(first[x])), size[x].astype(np.uint8).tobytes(), own.offset[stands[x]].astype(np.uint8).tobytes(), press(text)))
    place, doc, _, stands, hashes = own.single_windows(hot, shards)
    for s, x in _spread((hashes % np.uint64(shards)).astype(np.int64)):  # no bytes: a hash names the window
        out.append((s, chunk, press(np.diff(x, prepend=0).astype("<i4").tobytes()), hashes[x].tobytes(), press(_columns(own.ids[doc[stands[x]]])), None, None, None))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def _columns(ids: np.ndarray) -> bytes:
    """Ids byte by byte: the first bytes of all, then the second ones (which compresses well)."""
    return ids.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_columns(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<i8")[:, 0]


def answer_windows(rows) -> list:
    """(chunk, ranges) for the windows of hot anchors: those that a smaller document has, by negative numbers."""
    import zstandard

    if not rows.num_rows:
        return []
    open_ = zstandard.ZstdDecompressor().decompress
    hashes = np.concatenate([np.frombuffer(b, np.uint64) for b in rows.column("anchor").to_pylist()])
    number = [np.cumsum(np.frombuffer(open_(b), "<i4")) for b in rows.column("number").to_pylist()]
    first = np.concatenate([_from_columns(open_(b)) for b in rows.column("first").to_pylist()])
    order = np.argsort(hashes, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
    least = np.zeros(len(first), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(first[order], head), np.diff(np.append(head, len(order))))
    covered, at, out = least < first, 0, []
    for chunk, n in zip(rows.column("chunk").to_pylist(), number):
        told = -1 - n[covered[at : at + len(n)]]
        at += len(n)
        if len(told):
            out.append((chunk, np.stack([told, 0 * told, 0 * told], axis=1).astype("<i4").tobytes()))
    return out


def _first_documents(data: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every window of every context (one after the other): the smallest doc_id among equal windows."""
    n, gaps = len(start), np.arange(len(start))
    text = np.ones(int(size.sum()) + n + 1, np.uint16)  # 1 ends a context, 0 the text
    at = np.cumsum(size) - size + gaps
    text[_ragged(at, size)] = data[_ragged(start, size)].astype(np.uint16) + 2
    text[-1] = 0
    order = suffix_array(text, 258)
    plcp = permuted_prefixes(text, order, 1, SPAN)
    windows = size - SPAN + 1
    places = _ragged(at, windows)
    of = np.full(len(text), -1, np.int32)
    of[places] = np.repeat(gaps, windows)
    order = order[of[order] >= 0]  # windows in suffix order; between equal ones stands no other suffix
    head = np.flatnonzero(plcp[order] < SPAN)
    head = head if len(head) and head[0] == 0 else np.concatenate([[0], head])
    least = np.minimum.reduceat(first[of[order]], head)
    out = np.zeros(len(text), np.int64)
    out[order] = np.repeat(least, np.diff(np.concatenate([head, [len(order)]])))
    return out[places]


def _may_share(anchor, start, size, offset, g8) -> np.ndarray:
    """Contexts that may have an equal window with another one of their anchor: a window has SPAN - GRAM bytes beside
    the anchor, so equal ones agree on half of them just left or just right of it."""
    half, out = (SPAN - GRAM) // 2, np.zeros(len(anchor), bool)
    for at, ok in ((start + offset - half, offset >= half), (start + offset + GRAM, size - offset - GRAM >= half)):
        x = np.flatnonzero(ok)
        side = _mixed(g8[at[x]] * np.uint64(3) + g8[at[x] + half - 8] * np.uint64(5) + anchor[x] * np.uint64(7))
        _, group, count = np.unique(side, return_inverse=True, return_counts=True)
        out[x] |= count[group] > 1
    return out


def answer_contexts(rows):
    import pyarrow as pa
    import pyarrow.compute as pc
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    single = pa.array([b is None for b in rows.column("bytes").to_pylist()], pa.bool_())
    told, rows = answer_windows(rows.filter(single)), rows.filter(pc.invert(single))
    if not rows.num_rows:
        return pa.table([pa.array([r[0] for r in told], pa.int32()), pa.array([r[1] for r in told], pa.binary())], ["chunk", "ranges"])
    size = [np.frombuffer(b, np.uint8).astype(np.int64) for b in rows.column("size").to_pylist()]
    counts = [len(x) for x in size]
    size = np.concatenate(size)
    anchor = np.concatenate([_unpack5(b) for b in rows.column("anchor").to_pylist()])
    number = np.concatenate([np.cumsum(np.frombuffer(open_(b), "<i4")) for b in rows.column("number").to_pylist()])
    first = np.concatenate([_from_columns(open_(b)) for b in rows.column("first").to_pylist()])
    data = np.frombuffer(b"".join(open_(b) for b in rows.column("bytes").to_pylist()), np.uint8)
    start = np.cumsum(size) - size
    g32, g8 = _all_grams(data)
    content = _contents(g32, start, size)
    order = np.lexsort((first, content, anchor))
    fresh = np.concatenate([[True], (np.diff(anchor[order]) != 0) | (np.diff(content[order]) != 0)])
    context = np.zeros(len(order), np.int64)
    context[order] = np.cumsum(fresh) - 1
    stands = order[fresh]  # of each distinct context, the record of the smallest document
    offset = np.concatenate([np.frombuffer(b, np.uint8) for b in rows.column("offset").to_pylist()]).astype(np.int64)
    alone = ~_may_share(anchor[stands], start[stands], size[stands], offset[stands], g8)
    windows = size[stands] - SPAN + 1
    at = np.cumsum(windows) - windows
    least = np.repeat(first[stands], windows)
    sort = np.flatnonzero(~alone)
    if len(sort):
        least[_ragged(at[sort], windows[sort])] = _first_documents(data, start[stands[sort]], size[stands[sort]], first[stands[sort]])
    w = windows[context]
    flat = _ragged(at[context], w)
    covered = least[flat] < np.repeat(first, w)
    edge = np.cumsum(w) - w  # each record's first window
    step = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    begins = covered & ((step[:-1] == 1) | np.isin(np.arange(len(covered)), edge))
    stops = covered & ((step[1:] == -1) | np.isin(np.arange(len(covered)), edge + w - 1))
    a, b = np.flatnonzero(begins), np.flatnonzero(stops)
    record = np.searchsorted(edge, a, "right") - 1
    triples = np.stack([number[record], a - edge[record], b - edge[record]], axis=1).astype("<i4")
    cuts = np.searchsorted(record, np.cumsum([0, *counts]))
    out = [(c, triples[x:y].tobytes()) for c, x, y in zip(rows.column("chunk").to_pylist(), cuts[:-1], cuts[1:]) if y > x] + told
    return pa.table([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], ["chunk", "ranges"])


def cut_out(rows, answers, shards: int):
    import pyarrow as pa

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    if not rows.num_rows:
        return pa.table([pa.array([], t) for t in types], names)
    own = Chunk(rows)
    is_range = np.array([s is None for s in answers.column("shard").to_pylist()], bool)
    known, hot = _answers(answers.filter(pa.array(~is_range)))
    runs, number, stands = own.contexts(known, hot, shards)
    # runs of a context in a larger document than its smallest are covered whole
    later = own.rank[own.doc[runs]] > own.rank[own.doc[stands]][number] if len(runs) else np.zeros(0, bool)
    begin, end = [own.start[runs[later]]], [own.start[runs[later]] + own.windows[runs[later]] + SPAN - 1]
    blobs = answers.filter(pa.array(is_range)).column("keys").to_pylist()
    told = np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 3).astype(np.int64)
    told, singles = told[told[:, 0] >= 0], -1 - told[told[:, 0] < 0, 0]
    # what a shard says holds for all runs of the context in its smallest document
    order = np.argsort(number[~later], kind="stable")
    smallest, of = runs[~later][order], number[~later][order]
    lo, hi = np.searchsorted(of, told[:, 0], "left"), np.searchsorted(of, told[:, 0], "right")
    each = _ragged(lo, hi - lo)
    rep = np.repeat(np.arange(len(told)), hi - lo)
    begin.append(own.start[smallest[each]] + told[rep, 1])
    end.append(own.start[smallest[each]] + told[rep, 2] + SPAN)
    # and likewise for the windows of hot anchors
    place, doc, number, stands, _ = own.single_windows(hot, shards)
    gone = np.zeros(len(stands), bool)
    gone[singles] = True
    taken = place[gone[number] | (own.rank[doc] > own.rank[doc[stands]][number])] if len(place) else place
    begin.append(taken)
    end.append(taken + SPAN)
    begin, end = _united(np.concatenate(begin), np.concatenate(end), own.ends)
    of = np.searchsorted(own.ends, begin, "right")
    removed = np.bincount(of, end - begin, len(own.ids)).astype(np.int64)
    count = np.bincount(of, minlength=len(own.ids))
    edge = np.zeros(len(own.data) + 1, np.int8)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    kept, ends = own.data[np.cumsum(edge[:-1], dtype=np.int8) == 0], np.append(0, np.cumsum(own.sizes - removed))
    body = binary_array(kept, ends).cast(pa.binary())
    ids = pa.array([None if i == LAST else i for i in own.ids.tolist()], pa.int64())
    return pa.table([ids, pa.array(own.sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), body], names)


def _united(begin: np.ndarray, end: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes that the ranges cover; none goes on from one document into the next."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    reach = np.maximum.accumulate(end)
    of = np.searchsorted(ends, begin, "right")
    head = np.flatnonzero(np.concatenate([[True], (begin[1:] > reach[:-1]) | (of[1:] != of[:-1])])) if len(begin) else np.zeros(0, np.int64)
    return begin[head], reach[np.append(head[1:], len(begin)) - 1] if len(head) else end


def without_repeats(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every (doc_id, text).

    Each byte covered by SPAN bytes that also start in a document with a smaller doc_id is cut out. Null and empty
    texts and texts shorter than SPAN stay as they are; rows with one doc_id don't count as earlier than each other; a
    null doc_id counts as the largest; repeats within a document stay; other columns are not read; an empty table gives
    no rows. The texts cross one exchange, which the three steps over chunks share.
    """
    size = stored_bytes(df)
    chunks, shards = max(8, -(-size // CHUNK_BYTES)), max(8, -(-size // SHARD_BYTES))
    tasks = tasks_for(df)
    docs = whole_texts(df).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    docs = docs.repartition(max(tasks, chunks), "chunk")
    anchors = docs.groupBy("chunk").applyInArrow(lambda t: send_anchors(t, shards), "shard int, chunk int, keys binary, many binary, runs binary")
    shared = anchors.groupBy("shard").applyInArrow(answer_anchors, "chunk int, shard int, keys binary, hot binary").where("length(keys) > 0")
    contexts = docs.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(lambda t, a: send_contexts(t, a, shards), "shard int, chunk int, number binary, anchor binary, first binary, size binary, offset binary, bytes binary")
    ranges = contexts.groupBy("shard").applyInArrow(answer_contexts, "chunk int, ranges binary")
    both = shared.unionByName(ranges.select("chunk", F.lit(None).cast("int").alias("shard"), F.col("ranges").alias("keys"), F.lit(None).cast("binary").alias("hot")))
    return docs.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(lambda t, a: cut_out(t, a, shards), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
