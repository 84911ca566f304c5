"""Token-id files made of directly addressable codes.

An id is split into chunks of eight bits. Level k holds the k-th chunk of every id that has one, beside a bitmap that
says which of them go on to level k+1 and a rank directory (ones before every block of 512 bits). Access to id i reads
one byte per level and one rank per step: nothing before i is decoded.

The files are Parquet files of segments (one row: a run of whole documents in doc_id order, its codes, where each
document begins), written by Spark's committer to the shared folder, so any store and any lost task is fine.
"""

from __future__ import annotations

import struct

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, tasks_for, whole_texts
from .pieces import PieceMemo, arrow_slices, binary_array, gathered

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SEGMENT_IDS, SLICE_BYTES = 1 << 19, 2 << 20
BLOCK = 512
#: Parts summed together, and most parts (16 bytes each) whose totals are sent to every executor.
GROUP, BROADCAST_PARTS = 1024, 500_000
MAGIC = b"DAC1"
SCHEMA = "part int, segment int, first_in_part long, n_ids long, doc_ids array<long>, ends binary, codes binary"


def pack_codes(ids: np.ndarray) -> bytes:
    """Levels, bitmaps and rank directories of unsigned 32-bit ids."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        chunk, more = (rest & 255).astype(np.uint8), rest > 255
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(blocks)])[:-1].astype("<u4") if len(blocks) else np.zeros(0, "<u4")
        levels.append((chunk, bits, ranks))
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = MAGIC + struct.pack("<IB", len(ids), len(levels)) + b"".join(struct.pack("<I", len(x[0])) for x in levels)
    return head + b"".join(a.tobytes() for x in levels for a in x)


class Codes:
    """Random access to packed codes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a code segment")
        self.n, depth = struct.unpack_from("<IB", data, 4)
        sizes = struct.unpack_from(f"<{depth}I", data, 9)
        at, self.levels = 9 + 4 * depth, []
        for n in sizes:
            level = []
            for kind, count in ((np.uint8, n), (np.uint8, -(-n // 8)), (np.dtype("<u4"), -(-n // BLOCK))):
                level.append(np.frombuffer(data, kind, count, at))
                at += count * np.dtype(kind).itemsize
            self.levels.append(level)

    def get(self, i: int) -> int:
        """The id at position i: a rank per level, no decoding of what stands before."""
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            start = i // BLOCK * BLOCK
            i = int(ranks[i // BLOCK]) + int(np.unpackbits(bits[start >> 3 : (i >> 3) + 1], bitorder="little")[: i - start].sum())
        return value

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of the level's bitmap before each position: the directory, and at most a block of bits after it."""
        _, bits, ranks = self.levels[level]
        if not len(bits):
            return np.zeros(len(at), np.int64)
        block = np.minimum(at // BLOCK, len(ranks) - 1)
        left = at - block * BLOCK
        byte = np.arange(BLOCK // 8)
        own = np.append(bits, np.zeros(1, np.uint8))[np.minimum(block[:, None] * (BLOCK // 8) + byte, len(bits))]
        keep = np.clip(left[:, None] - 8 * byte, 0, 8)
        return ranks[block].astype(np.int64) + np.bitwise_count(own & ((1 << keep) - 1).astype(np.uint8)).sum(axis=1, dtype=np.int64)

    def slices(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Ids of the ranges start .. stop-1 one after the other. On each level the ones of a range that go on are
        neighbours too, from the rank of its start."""
        sizes = stops - starts
        of = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        out, where = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, (chunk, bits, _) in enumerate(self.levels):
            if not len(at):
                break
            out[where] |= chunk[at].astype(np.uint32) << np.uint32(8 * k)
            more = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            starts, where, of = self._rank(k, starts), where[more], of[more]
            count = np.bincount(of, minlength=len(starts))
            at = np.arange(len(of)) - (np.cumsum(count) - count)[of] + starts[of]
        return out


#: A piece without white space but a space before it (what else there may be goes to the library alone).
PLAIN = r"^ ?[^\x00-\x20\x7f-\x{a0}\p{Z}\x{180e}\x{feff}]+$"
JOINED = 256


def _library_encoder(path: str):
    """Ids of pieces by the tokenizers library. Plain pieces are joined by newlines, which the pattern sets apart, and
    cut again at the newline's id; other pieces, or in case of doubt all, go one by one."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import pyarrow as pa
    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    newline = library.encode("\n", add_special_tokens=False).ids

    def one_by_one(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes

    def joined(pieces) -> tuple[np.ndarray, np.ndarray] | None:
        groups = pa.LargeListArray.from_arrays(np.append(np.arange(0, len(pieces), JOINED), len(pieces)), pieces)
        ids: list[int] = []
        for x in library.encode_batch_fast(pc.binary_join(groups, pa.scalar("\n", pa.large_string())).to_pylist(), add_special_tokens=False):
            ids += x.ids
            ids += newline
        flat = np.array(ids, np.uint32)
        cuts = np.flatnonzero(flat == newline[0])
        if len(newline) > 1 or len(cuts) != len(pieces):
            return None
        return np.delete(flat, cuts), np.diff(cuts, prepend=-1) - 1

    def encode(pieces) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(pieces, PLAIN)
        found = joined(pieces.filter(plain)) if pc.any(plain).as_py() else None
        if found is None:
            return one_by_one(pieces.to_pylist())
        (ids, sizes), (more, more_sizes) = found, one_by_one(pieces.filter(pc.invert(plain)).to_pylist())
        of = plain.to_numpy(zero_copy_only=False)
        starts, lengths = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        starts[of], lengths[of] = np.cumsum(sizes) - sizes, sizes
        starts[~of], lengths[~of] = len(ids) + np.cumsum(more_sizes) - more_sizes, more_sizes
        return gathered(np.concatenate([ids, more]), starts, lengths)[0], lengths

    memo, specials = PieceMemo(encode), [t.content for t in library.get_added_tokens_decoder().values()]

    def encoder(texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of texts, and where each text's begin (and the end). Texts that hold the string of a
        special token go to the library whole."""
        held = np.zeros(len(texts), bool)
        for s in specials:
            held |= pc.match_substring(texts, s).fill_null(False).to_numpy(zero_copy_only=False)
        ids, ends = memo.encode(texts)
        if not held.any():
            return ids, ends
        own, sizes = one_by_one(texts.filter(pa.array(held)).to_pylist())
        starts, lengths = ends[:-1].copy(), np.diff(ends)
        starts[held], lengths[held] = len(ids) + np.cumsum(sizes) - sizes, sizes
        return gathered(np.concatenate([ids, own]), starts, lengths)

    return encoder


_encoders: dict[str, object] = {}


def write_token_files(df: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = END_ID, tasks: int | None = None) -> None:
    """Writes the ids of every (doc_id, text) in ascending doc_id order (null doc_ids first) to `folder`.

    Null and empty texts hold the end id alone (nothing without one); equal doc_ids stay next to each other; an empty
    table writes no segment. The texts cross one range exchange; the ids do not.
    """
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        if tokenizer not in _encoders:
            _encoders[tokenizer] = _library_encoder(tokenizer)
        encode = _encoders[tokenizer]
        part, number, first, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def segment():
            docs, ids, ends = zip(*held)
            before, docs = np.cumsum([0, *map(len, ids)]), pa.concat_arrays(docs)
            ends = np.concatenate([x[1:] + b for x, b in zip(ends, before)]).astype("<i8")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.ListArray.from_arrays([0, len(docs)], docs), pa.array([ends.tobytes()], pa.binary()), pa.array([pack_codes(np.concatenate(ids))], pa.binary())], ["part", "segment", "first_in_part", "n_ids", "doc_ids", "ends", "codes"])

        for batch in batches:
            for docs, texts in arrow_slices(batch, SLICE_BYTES):
                ids, ends = encode(texts)
                if end_id is not None:
                    ids = np.insert(ids, ends[1:], np.uint32(end_id))
                    ends = ends + np.arange(len(ends))
                held.append((docs, ids, ends))
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield segment()
                    first, number, held, size = first + size, number + 1, [], 0
        if held:
            yield segment()

    texts = whole_texts(df)
    ordered = texts.repartitionByRange(tasks or tasks_for(df), F.col("doc_id")).sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, SCHEMA).write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, token_ids (binary, little-endian unsigned 32-bit).

    The totals of the parts are summed by groups of GROUP parts, then over the groups. They are sent to every executor
    up to BROADCAST_PARTS of them, beyond that joined.
    """
    from pyspark.sql import Window

    segments = spark.read.schema(SCHEMA).parquet(folder)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("ids")).withColumn("group", F.expr(f"part div {GROUP}"))
    up = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy("group").agg(F.sum("ids").alias("ids"))
    groups = groups.select("group", F.coalesce(F.sum("ids").over(up.orderBy("group")), F.lit(0)).alias("before_group"))
    inside = F.coalesce(F.sum("ids").over(up.partitionBy("group").orderBy("part")), F.lit(0))
    before = totals.withColumn("inside", inside).join(groups, "group").select("part", (F.col("inside") + F.col("before_group")).alias("before_part"))
    last = segments.agg(F.max("part")).first()[0]
    before = F.broadcast(before) if (last or 0) < BROADCAST_PARTS else before

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                codes, docs = Codes(batch.column("codes")[i].as_buffer().to_pybytes()), batch.column("doc_ids")[i].values
                ends = np.frombuffer(batch.column("ends")[i].as_buffer(), "<i8")
                starts = np.concatenate([[0], ends[:-1]])
                ids = codes.slices(starts, ends).astype("<u4")
                base = batch.column("before_part")[i].as_py() + batch.column("first_in_part")[i].as_py()
                yield pa.RecordBatch.from_arrays([docs, pa.array(starts + base, pa.int64()), pa.array(ends - starts, pa.int64()), binary_array(ids.view(np.uint8), np.append(0, 4 * ends)).cast(pa.binary())], ["doc_id", "start", "n_tokens", "token_ids"])

    placed = segments.join(before, "part").select("before_part", "first_in_part", "doc_ids", "ends", "codes")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, token_ids binary")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


__all__ = ["Codes", "pack_codes", "write_token_files", "read_token_files", "op4_token_files"]
