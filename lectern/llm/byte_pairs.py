"""Byte-level BPE by ranks, with a segment tree over byte positions.

Leaf i of a word's tree holds the rank of the pair that begins at live position i (or NONE). Inner nodes hold the
minimum, so the root names the smallest rank and walking down to the left gives its leftmost position. A merge
changes the pairs of at most three live positions: the merged one, its left neighbour, and the one that vanishes;
each is a point update of logarithmic length. Words of about the same length are worked on together, one row of a
numpy matrix each.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import give_back, table, tidy, whole_texts
from .pieces import PATTERN, PieceMemo, arrow_slices, binary_array, gathered

RANKS = "byte_bpe_50k.tiktoken"
NONE = np.int32(2**31 - 1)


class BytePairs:
    """Encoder and decoder for a file of (base64 bytes, rank) lines."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = dict(sorted((r, t) for t, r in self.rank.items()))
        self.text = np.frombuffer(b"".join(tokens.values()), np.uint8)
        self.text_size = np.zeros(max(tokens) + 1, np.int64)
        self.text_size[list(tokens)] = list(map(len, tokens.values()))
        self.text_at = np.cumsum(self.text_size) - self.text_size
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        keys, ranks = array("q"), array("i")  # every way to make a token of two
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(r)
        order = np.argsort(np.frombuffer(keys, np.int64))
        self.pair_keys, self.pair_ranks = np.frombuffer(keys, np.int64)[order], np.frombuffer(ranks, np.int32)[order]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; a word is one match of the pattern."""
        out: list = [None] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            whole = self.rank.get(w)
            if whole is not None or not w:
                out[i] = [whole] if w else []
            else:
                groups.setdefault((len(w) - 1).bit_length(), []).append(i)
        for bits, members in groups.items():
            rows = max(1, (1 << 19) >> bits)
            for k in range(0, len(members), rows):
                part = members[k : k + rows]
                for i, ids in zip(part, self._merge([words[i] for i in part], 1 << bits)):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], leaves: int) -> list[np.ndarray]:
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        text = np.zeros((n, leaves), np.uint8)
        live = np.arange(leaves)[None, :] < sizes[:, None]
        text[live] = np.frombuffer(b"".join(words), np.uint8)
        token = self.byte[text]
        after = np.broadcast_to(np.arange(1, leaves + 1), (n, leaves)).copy()  # next live position
        before = after - 2
        tree = np.full((n, 2 * leaves), NONE, np.int32)
        both = live[:, 1:]
        first = np.full((n, leaves), NONE, np.int32)
        first[:, :-1][both] = self.pair_rank(token[:, :-1][both], token[:, 1:][both])
        tree[:, leaves:] = first
        level = leaves
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        work = np.flatnonzero(tree[:, 1] != NONE)
        while len(work):
            best = tree[work, 1]
            node = np.ones(len(work), np.int64)
            for _ in range(leaves.bit_length() - 1):  # leftmost leaf that holds the minimum
                node = 2 * node
                node += tree[work, node] != best
            at = node - leaves
            gone = after[work, at]
            token[work, at] = best
            live[work, gone] = False
            right = after[work, gone]
            after[work, at] = right
            has_right = right < sizes[work]
            before[work[has_right], right[has_right]] = at[has_right]
            left = before[work, at]
            has_left = left >= 0
            value = np.full(len(work), NONE, np.int32)
            value[has_right] = self.pair_rank(token[work[has_right], at[has_right]], token[work[has_right], right[has_right]])
            self._update(tree, work, gone, np.full(len(work), NONE, np.int32), leaves)
            self._update(tree, work, at, value, leaves)
            rows, l = work[has_left], left[has_left]
            self._update(tree, rows, l, self.pair_rank(token[rows, l], token[rows, at[has_left]]), leaves)
            work = work[tree[work, 1] != NONE]
        return np.split(token[live], np.cumsum(live.sum(axis=1))[:-1])

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, leaves: int) -> None:
        node = at + leaves
        tree[rows, node] = value
        while leaves > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            leaves //= 2

    def encode_pieces(self, pieces) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of pieces one after the other, and how many each has; the pattern cuts them first."""
        words, counts = [], []
        for p in pieces.to_pylist():
            found = PATTERN.findall(p)
            words += [w.encode("utf-8") for w in found]
            counts.append(len(found))
        ids = self.encode_words(words)
        of_word = np.fromiter(map(len, ids), np.int64, len(ids))
        total = np.concatenate([[0], np.cumsum(of_word)])
        ends = np.cumsum(counts)
        return np.fromiter((i for x in ids for i in x), np.uint32, int(total[-1])), total[ends] - total[ends - np.array(counts, np.int64)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids one after the other, and where each id's begin (and the end)."""
        return gathered(self.text, self.text_at[ids], self.text_size[ids])


_codecs: dict[str, tuple[BytePairs, PieceMemo]] = {}


def _codec(path: str) -> tuple[BytePairs, PieceMemo]:
    if path not in _codecs:
        codec = BytePairs(path)
        _codecs[path] = codec, PieceMemo(codec.encode_pieces)
    return _codecs[path]


def byte_pair_round_trip(df: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, token_ids (binary, little-endian unsigned 32-bit), decoded (binary) for every (doc_id, text).

    Null and empty texts have no ids and decode to nothing; repeated rows are coded each; an empty table gives no
    rows; a null doc_id stays null; other columns are not read. One pass over the scan's partitions, no shuffle.
    """
    ranks = ranks or public_tokenizers.path(RANKS)

    def run(batches):
        import pyarrow as pa

        codec, memo = _codec(ranks)
        memo.forget()  # a task's own pieces only
        for batch in batches:
            for docs, texts in arrow_slices(batch, 1 << 20):
                ids, ends = memo.encode(texts)
                text, at = codec.decode(ids)
                yield pa.RecordBatch.from_arrays([docs, pa.array(np.diff(ends), pa.int64()), binary_array(ids.astype("<u4").view(np.uint8), 4 * ends).cast(pa.binary()), binary_array(text, at[ends]).cast(pa.binary())], ["doc_id", "n_tokens", "token_ids", "decoded"])
                del ids, ends, text, at
                give_back()  # freed arrays of many sizes would pile up beside the memo
        memo.forget()

    return whole_texts(df).mapInArrow(tidy(run), "doc_id long, n_tokens long, token_ids binary, decoded binary")


def byte_pair_digests(df: DataFrame, ranks: str | None = None) -> DataFrame:
    """The same with SHA-256 digests in place of the ids and bytes, taken by Spark's own sha2."""
    from pyspark.sql import functions as F

    coded = byte_pair_round_trip(df, ranks)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pair_digests(table(spark, sf_dir, "documents"))


__all__ = ["BytePairs", "byte_pair_round_trip", "byte_pair_digests", "op5_byte_pairs"]
