"""Pieces of a text that a byte-level tokenizer treats on their own, and a memo of their ids.

The public pattern ends a match at certain places whatever stands around them: between letters, digits and marks,
before white space, and beside its last character. A text is cut at such places (found for a whole buffer at once), so
that most pieces are bare words, and every distinct piece is encoded once. Where the kind of a character isn't certain
from its bytes there is no cut; the pieces are longer then, and the library or the pattern itself cuts them.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)

#: Bytes of text that are cut at once.
BLOCK_BYTES = 4 << 20
#: Bounds of a memo: bytes of its keys and ids, and the longest piece that it remembers.
MEMO_BYTES, MEMO_PIECE = 64 << 20, 64

UNSURE, LETTER, DIGIT, MARK, SPACE, OTHER = range(6)
_KIND = np.full(256, UNSURE, np.uint8)
_KIND[33:127], _KIND[128:] = MARK, OTHER
_KIND[48:58], _KIND[65:91], _KIND[97:123] = DIGIT, LETTER, LETTER
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8 text: of all bytes of a character that of the character. Latin letters and common
    marks beyond ASCII are known; white space beyond ASCII is unsure, and the rest is something that isn't white space."""
    out = _KIND[data]
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[lead < len(data) - 1]
    first, second = data[lead], data[lead + 1]
    latin = (first >= 0xC4) & (first <= 0xC8) | (first == 0xC3) & (second != 0x97) & (second != 0xB7)
    at = lead[latin]
    out[at] = out[at + 1] = LETTER
    two = lead[first == 0xC2]
    for kind, values in ((UNSURE, (0x85, 0xA0)), (MARK, (0xA1, 0xAB, 0xBB, 0xBF))):
        at = two[np.isin(data[two + 1], values)]
        out[at] = out[at + 1] = kind
    wide = lead[(first >= 0xE1) & (first <= 0xEF)]
    wide = wide[wide < len(data) - 2]
    code = data[wide].astype(np.int32) << 16 | data[wide + 1].astype(np.int32) << 8 | data[wide + 2]
    general = (code >= 0xE28080) & (code <= 0xE281BF)
    marks = (code >= 0xE28090) & (code <= 0xE280A7)
    odd = general & ~marks | (code == 0xE19A80) | (code == 0xE1A08E) | (code == 0xE38080) | (code == 0xEFBBBF)
    for kind, at in ((MARK, wide[marks]), (UNSURE, wide[odd])):
        out[at] = out[at + 1] = out[at + 2] = kind
    return out


def borders(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of a buffer of texts begin (`starts`: where the texts do)."""
    n, kind = len(data), kinds(data)
    cut = np.zeros(n + 1, bool)
    left, right = kind[:-1], kind[1:]
    word = (left != SPACE) & (left != UNSURE)
    cut[1:n] = (right == SPACE) & word  # before a run of white space
    known = (left >= LETTER) & (left <= MARK) & (right >= LETTER) & (right <= MARK)
    cut[1:n] |= known & (left != right) & (data[:-1] != 39)  # an apostrophe may begin a contraction
    fresh = np.zeros(n + 1, bool)
    fresh[starts] = True
    cut |= fresh
    # the run's last character stands apart from those before it, and joins a word only if it is a space
    last = np.flatnonzero((left == SPACE) & (right != SPACE) & (right != UNSURE) & ~fresh[1:n])
    cut[last[(last > 0) & (kind[last - 1] == SPACE)]] = True
    own = last[(data[last] != 32) & cut[last]]
    cut[own + 1] = True
    return np.flatnonzero(cut[:n])


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ids[start : start + size] one after the other, and where each begins in the result (and its end)."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    return ids[np.repeat(starts - before[:-1], sizes) + np.arange(before[-1])], before


def flat_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow array of strings (null: empty), and where each begins in them (and the end)."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def binary_array(data: np.ndarray, ends: np.ndarray):
    """An Arrow array of binaries from bytes one after the other and where each begins (and the end)."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(of: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(of)
    return np.multiply.accumulate(out)


def run_hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes (`ends`: where each begins, and the end): a polynomial in 64 bits, mixed."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _powers(_FACTOR, len(data)), out=total[1:])
    h = (total[ends[1:]] - total[ends[:-1]]) * _powers(_INVERSE, len(data) + 1)[ends[:-1]]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class PieceMemo:
    """Ids of the pieces met so far, all in flat arrays. `encode_new` gives the ids of an Arrow array of distinct
    pieces, one after the other, and their sizes. What goes beyond the bound is forgotten and encoded again."""

    def __init__(self, encode_new, most_bytes: int = MEMO_BYTES):
        self.encode_new, self.most_bytes = encode_new, most_bytes
        self.forget()

    def forget(self) -> None:
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of the keys, by hash
        self.text, self.ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _find(self, data: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where it isn't known; equal hashes are compared byte by byte."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return out
        order = np.argsort(hashes)
        at = np.minimum(np.searchsorted(self.hashes, hashes[order]), len(self.hashes) - 1)
        out[order] = np.where(self.hashes[at] == hashes[order], self.number[at], -1)
        sizes = np.diff(ends)
        known = np.flatnonzero(out >= 0)
        known = known[np.diff(self.ends)[out[known]] == sizes[known]]
        mine, _ = gathered(data, ends[known], sizes[known])
        other, _ = gathered(self.text, self.ends[out[known]], sizes[known])
        wrong = np.zeros(len(known), bool)
        wrong[np.repeat(np.arange(len(known)), sizes[known])[mine != other]] = True
        found = np.full(len(hashes), -1, np.int64)
        found[known[~wrong]] = out[known[~wrong]]
        return found

    def _remember(self, data, starts, lengths, hashes, ids, sizes) -> None:
        short = lengths <= MEMO_PIECE
        kept, text = ids[np.repeat(short, sizes)], gathered(data, starts[short], lengths[short])[0]
        every = np.concatenate([self.hashes, hashes[short]])
        order = np.argsort(every, kind="stable")
        self.number = np.concatenate([self.number, len(self.ends) - 1 + np.arange(short.sum())])[order]
        self.hashes = every[order]
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths[short])])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes[short])])
        self.text, self.ids = np.concatenate([self.text, text]), np.concatenate([self.ids, kept])
        if sum(x.nbytes for x in (self.hashes, self.number, self.ends, self.starts, self.text, self.ids)) > self.most_bytes:
            self.forget()

    def _block(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a block, where its pieces begin (and its end), and the ids before each of these places."""
        import pyarrow as pa

        cuts = np.append(borders(data, starts), len(data))
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        names, ends = flat_bytes(pieces.dictionary)
        hashes = run_hashes(names, ends)
        of = self._find(names, ends, hashes)
        ids, at, sizes, fresh = self.ids, self.starts[:-1], np.diff(self.starts), of < 0
        if fresh.any():
            more, more_sizes = self.encode_new(pieces.dictionary.filter(pa.array(fresh)))
            of[fresh] = len(at) + np.arange(len(more_sizes))
            at = np.concatenate([at, len(ids) + np.cumsum(more_sizes) - more_sizes])
            sizes, ids = np.concatenate([sizes, more_sizes]), np.concatenate([ids, more])
            self._remember(names, ends[:-1][fresh], np.diff(ends)[fresh], hashes[fresh], more, more_sizes)
        of = of[pieces.indices.to_numpy()]
        flat, before = gathered(ids, at[of], sizes[of])
        return flat, cuts, before

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of texts one after the other (unsigned 32-bit), and where each text's begin (and the
        end)."""
        data, ends = flat_bytes(texts)
        parts, marks, lo, total = [], np.zeros(len(ends), np.int64), 0, 0
        while lo < len(data):
            hi = self._cut(data, ends, lo)
            a, b = np.searchsorted(ends, lo, "left"), np.searchsorted(ends, hi, "left")
            inside = ends[a:b]  # texts that begin in the block
            flat, cuts, before = self._block(data[lo:hi], np.append(inside - lo, 0))
            marks[a:b] = total + before[np.searchsorted(cuts, inside - lo)]
            parts.append(flat)
            total += len(flat)
            lo = hi
        marks[np.searchsorted(ends, len(data), "left") :] = total
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), marks

    @staticmethod
    def _cut(data: np.ndarray, ends: np.ndarray, lo: int) -> int:
        """Where the block from `lo` ends: the end of a text, or a single space between two ASCII letters."""
        goal = lo + BLOCK_BYTES
        if goal >= len(data):
            return len(data)
        text = int(ends[np.searchsorted(ends, goal, "right") - 1])
        if text > lo + BLOCK_BYTES // 2:
            return text
        at = goal
        while at < len(data):
            window = _KIND[data[at : at + (1 << 16)]]
            found = np.flatnonzero((data[at + 1 : at + len(window) - 1] == 32) & (window[:-2] == LETTER) & (window[2:] == LETTER)) if len(window) > 2 else []
            if len(found):
                return at + 1 + int(found[0])
            at += max(1, len(window) - 2)
        return len(data)


def arrow_slices(batch, size: int = BLOCK_BYTES):
    """Parts of an Arrow batch of (doc_id, text) with about `size` bytes each: (doc_ids, texts) as Arrow arrays."""
    import pyarrow.compute as pc

    n = batch.num_rows
    ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.column("doc_id").slice(at, end - at), batch.column("text").slice(at, end - at)
        at = end


def text_slices(batch, size: int = BLOCK_BYTES):
    """The same as Python lists."""
    for ids, texts in arrow_slices(batch, size):
        yield ids.to_pylist(), texts.to_pylist()
