"""The grams of a shard at the borders of its blocks."""

import numpy as np
import pytest

from lectern.llm import substring_dedup


@pytest.mark.parametrize("blocks", [1, 2])
def test_all_grams(monkeypatch, blocks):
    monkeypatch.setattr(substring_dedup, "PART", 128)
    r = np.random.default_rng(2)
    for extra in range(41):
        data = r.integers(0, 256, 128 * blocks + extra, np.uint8)
        g32, g8 = substring_dedup._all_grams(data)
        _, want32, want8 = substring_dedup._grams(data)
        assert len(g8) == len(data) - 7
        assert np.array_equal(g32, want32) and np.array_equal(g8, want8)


def test_answer_contexts_at_a_border(monkeypatch):
    import pyarrow as pa
    import zstandard

    monkeypatch.setattr(substring_dedup, "PART", 128)
    press = zstandard.ZstdCompressor(level=1).compress
    r = np.random.default_rng(3)
    for extra in range(41):
        last = 128 + extra - 60  # two contexts whose bytes end `extra` after the block
        size = np.array([60, last])
        offset = np.minimum(size - 24, 26)
        offset[1] = size[1] - 37  # 13 bytes right of the anchor
        cells = [0, 7, press(np.diff(np.arange(2), prepend=0).astype("<i4").tobytes()), substring_dedup._pack5(np.array([5, 5], np.uint64)), press(np.array([1, 2], "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()), size.astype(np.uint8).tobytes(), offset.astype(np.uint8).tobytes(), press(r.integers(0, 256, int(size.sum()), np.uint8).tobytes())]
        names = ["shard", "chunk", "number", "anchor", "first", "size", "offset", "bytes"]
        types = [pa.int32(), pa.int32()] + [pa.binary()] * 6
        got = substring_dedup.answer_contexts(pa.table([pa.array([c], t) for c, t in zip(cells, types)], names))
        assert got.num_rows == 0
