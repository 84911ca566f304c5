"""Exact self join of shingle sets on Jaccard similarity, by skipping over index lists and deriving answers from answers.

A similarity of (q - 1) / (q + 1) or more (q = 19: 0.9, q = 9: 0.8) is the same as q * D <= |x| + |y|, where D counts
the shingles that only one set has. Equal sets are one node. The first shingles of every set in one common order (rare
ones first) are its entries in the index: two sets at the threshold share an entry.

* A list of up to GROUP sets falls into blocks of equal size and position. A pair of blocks whose sizes are too far
  apart, or whose sets have too little left behind their positions, is skipped whole; the others give candidates.
* A longer list has its sets compared with one of them, the pivot r, which gives the differences x / r and r / x of each.
  Sets that link with r leave the list. What can still link with such a set, but not with r, lies near r too (D is a
  metric), and what x and y share is known from their differences to r: linked sets then share a difference. So the two
  kinds meet in lists of (r, difference). A list goes round ROUNDS times; what is left of it and the lists of
  differences are cut into blocks that meet two by two, where sketches decide what becomes a candidate: first the likeliest
  partner of each set alone, then every pair that no links found so far connect.

Every candidate is checked on the whole sets, so no order, no count and no bound above changes the result. Shingles are
known by 64-bit hashes.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as hash_of

from .common import checkpointed, stored, tidy
from .components import connected_components
from .pieces import text_slices

GROUP = 128
ROUNDS = 3
CELL = 1024  # sets of two blocks that meet
PER_TASK = 32  # pairs that one copy of a shared partner's set serves
HEAVY = 1 << 16  # shingles, and words, with a known frequency, some 100 bytes each; the others count as rare
SLICE_BYTES = 1 << 20
BITS = 1024  # of a sketch at least
SHORT = 8  # lists of up to so many sets are looked at together, length by length
BROADCAST_ROWS = 200_000  # names of wanted texts or pairs, 16 bytes each; more are joined
BROADCAST_BYTES = 16 << 20  # of partners' sets; larger ones are joined
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Words of a slice, numbered as they come."""

    def __missing__(self, w: bytes) -> int:
        self[w] = number = len(self)
        return number


class _Slice:
    """The shingles of some texts, one text after the other: ASCII lower case, white-space words; a text of fewer words is
    one shingle, a blank one none. Every distinct word is hashed once; a shingle's hash is mixed from those of its words."""

    def __init__(self, texts: list[str], words: int):
        lists, numbers = [text.encode("utf-8").lower().split() for text in texts], _Numbers()
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.at = np.fromiter(map(numbers.__getitem__, chain.from_iterable(lists)), np.int64, int(counts.sum()))
        self.names = np.fromiter((hash_of(w, 7) for w in numbers), np.uint64, len(numbers))
        self.words, long = words, counts >= words
        self.sizes = np.where(long, counts - words + 1, counts > 0)
        self.ends = np.cumsum(self.sizes)
        first = np.cumsum(counts) - counts
        self.first = (np.arange(self.sizes.sum()) + np.repeat(first - (self.ends - self.sizes), self.sizes))[np.repeat(long, self.sizes)]
        self.full, self.short = np.repeat(long, self.sizes), np.flatnonzero(~long & (counts > 0))
        self.hashes = np.zeros(len(self.full), np.uint64)
        mixed = self.names[self.at[self.first]]
        for i in range(1, words):
            mixed = (mixed ^ mixed >> np.uint64(29)) * _ODD + self.names[self.at[self.first + i]]
        mixed = (mixed ^ mixed >> np.uint64(32)) * _ODD
        self.hashes[self.full] = mixed ^ mixed >> np.uint64(29)
        self.hashes[self.ends[self.short] - 1] = [hash_of(b" ".join(lists[k]), 9) for k in self.short.tolist()]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each shingle the sum of the weights (by number) of its words; 0 for a text of fewer words."""
        out = np.zeros(len(self.full), np.int64)
        out[self.full] = sum(weights[self.at[self.first + i]] for i in range(self.words))
        return out

    def sets(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct `keys` (one for each shingle) of each text in ascending order, the text of each, and how many each
        text has."""
        keys, of = keys.copy(), np.repeat(np.arange(len(self.sizes)), self.sizes)
        for s, e in zip((self.ends - self.sizes).tolist(), self.ends.tolist()):
            keys[s:e].sort()
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
        return keys[first], of[first], np.bincount(of[first], minlength=len(self.sizes))


def _nodes(hashes: np.ndarray, sizes: np.ndarray) -> list[int | None]:
    """A hash of each set; None for an empty one."""
    ends = np.cumsum(sizes).tolist()
    return [hash_of(hashes[e - n : e].tobytes()) - (1 << 63) if n else None for n, e in zip(sizes.tolist(), ends)]


def _signed(hashes: np.ndarray) -> np.ndarray:
    """Unsigned hashes as longs in the same order."""
    return (hashes ^ np.uint64(1 << 63)).view(np.int64)


def sketches(hashes: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of the texts' sets one after the other in longs, and the length of each: the parities of the hashes by what
    their upper halves leave modulo a power of two, two times as many as the set has shingles, BITS at least. Sets differ in at least
    as many shingles as their sketches in bits; of two lengths, the halves of the longer are laid over each other."""
    bits = np.int64(BITS) << np.ceil(np.log2(np.maximum(2 * sizes, BITS) / BITS)).astype(np.int64)
    ends = np.cumsum(bits)
    out, s = [np.zeros(0, np.int64)], 0
    while s < len(sizes):
        e = max(s + 1, int(np.searchsorted(ends, ends[s] + (1 << 20))))
        lo, hi = np.searchsorted(of, (s, e))
        begin = ends[s] - bits[s]
        at = (ends - bits)[of[lo:hi]] - begin + ((hashes[lo:hi] >> np.uint64(32)).astype(np.int64) & (bits[of[lo:hi]] - 1))
        odd = np.bincount(at, minlength=int(ends[e - 1] - begin)) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"))
        s = e
    return np.concatenate(out), bits // 64


def _lists(values: np.ndarray, sizes: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int64()))


def set_marks(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, node (a hash of the set; null where it is empty) and sketch for every (doc_id, text); and, with `docs`
    not null, how many texts of a slice have a frequent shingle, or with `uses` how often a slice has a frequent word."""
    kinds = ["doc_id", "n", "node", "name", "docs", "uses", "sketch"]

    def run(batches):
        import pyarrow as pa

        def rows(length, **columns):
            none = lambda k: pa.nulls(length, pa.list_(pa.int64()) if k == "sketch" else pa.int64())
            return pa.RecordBatch.from_arrays([columns[k] if k in columns else none(k) for k in kinds], kinds)

        for batch in batches:
            for ids, texts in text_slices(batch, SLICE_BYTES):
                cut = _Slice(texts, words)
                hashes, of, sizes = cut.sets(cut.hashes)
                bits, longs = sketches(hashes, of, sizes)
                yield rows(len(ids), doc_id=pa.array(ids, pa.int64()), n=pa.array(sizes, pa.int64()), node=pa.array(_nodes(hashes, sizes), pa.int64()), sketch=_lists(bits, longs))
                shingles, counts = np.unique(hashes, return_counts=True)
                often, used = counts >= 4, np.bincount(cut.at, minlength=len(cut.names))
                yield rows(int(often.sum()), name=pa.array(_signed(shingles[often])), docs=pa.array(counts[often], pa.int64()))
                often = used >= 16
                yield rows(int(often.sum()), name=pa.array(_signed(cut.names[often])), uses=pa.array(used[often], pa.int64()))

    return docs.mapInArrow(tidy(run), "doc_id long, n long, node long, name long, docs long, uses long, sketch array<long>")


def _known(marks: DataFrame, counted: str) -> dict[int, int]:
    """The most frequent shingles or words (names) with their counts; a bounded number."""
    often = marks.where(f"{counted} IS NOT NULL").groupBy("name").agg(F.sum(counted).alias("c")).orderBy(F.desc("c"), "name").limit(HEAVY)
    return {r["name"]: r["c"] for r in often.collect()}


def _looked_up(names: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The value of each of `names` in `known` (names in ascending order, values), 0 where it isn't there."""
    of, values = known
    if not len(of):
        return np.zeros(len(names), np.int64)
    at = np.minimum(np.searchsorted(of, names), len(of) - 1)
    return np.where(of[at] == names, values[at], 0)


def _entries(docs: DataFrame, words: int, q: int, heavy: dict[int, int], used: dict[int, int]) -> DataFrame:
    """key, node, n, pos for the first shingles of every set: frequent ones last, before them the others by how frequent
    their words are. A key is 12 bits of this order and 52 of the hash, so that it can be sorted by itself; shingles that
    fell together would only shorten the list of a set, and no pair would be lost."""

    def table(counts: dict[int, int], scale: int):
        names = np.sort(np.array(list(counts), np.int64))
        return names, np.array([round(scale * float(np.log2(counts[x]))) for x in names.tolist()], np.int64)

    half = 1 << 11
    frequent = docs.sparkSession.sparkContext.broadcast((table(heavy, half // 32), table(used, half)))

    def run(batches):
        import pyarrow as pa

        often_of, weight_of = frequent.value
        for batch in batches:
            for _, texts in text_slices(batch, SLICE_BYTES):
                cut = _Slice(texts, words)
                if not len(cut.hashes):
                    continue
                hashes, _, n = cut.sets(cut.hashes)
                nodes = np.array([x or 0 for x in _nodes(hashes, n)], np.int64)
                often = _looked_up(_signed(cut.hashes), often_of)
                level = np.where(often > 0, half + often, cut.sums(_looked_up(_signed(cut.names), weight_of)) // (32 * words))
                keys, of, sizes = cut.sets(np.clip(level, 0, 2 * half - 1).astype(np.uint64) << np.uint64(52) | cut.hashes >> np.uint64(12))
                pos = np.arange(len(keys)) - (np.cumsum(sizes) - sizes)[of]
                few = pos <= n[of] - -(-(q - 1) * n[of] // (q + 1))
                of = of[few]
                yield pa.RecordBatch.from_arrays([pa.array(keys[few].view(np.int64)), pa.array(nodes[of]), pa.array(n[of].astype(np.int64)), pa.array(pos[few].astype(np.int64))], ["key", "node", "n", "pos"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "key long, node long, n long, pos long")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """node, n, shingles for every (doc_id: node, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, part in text_slices(batch, SLICE_BYTES):
                cut = _Slice(part, words)
                hashes, _, sizes = cut.sets(cut.hashes)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes.astype(np.int64)), _lists(hashes.view(np.int64), sizes)], ["node", "n", "shingles"])

    return texts.mapInArrow(tidy(run), "node long, n long, shingles array<long>")


def _apart(role: np.ndarray, side: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((role[x] == 0) | (role[x] != role[y])) & ((side[x] == 0) | (side[x] != side[y]))


def pairs_of_list(n: np.ndarray, pos: np.ndarray, role: np.ndarray, side: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the candidate pairs of one list. Blocks of equal (n, pos) are skipped two by two: at its first shared
    entry a pair has no more in common than what lies behind it. `role` 0 meets all, 1 only 2; `side` 0 meets all, 1 only 2."""
    order = np.lexsort((pos, n))
    n, pos, role, side = n[order], pos[order], role[order], side[order]
    begins = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])])
    ends = np.append(begins[1:], len(n))
    bn, bp = n[begins], pos[begins]
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(begins)):
        for j in np.flatnonzero(_fit(bn[i], bp[i], bn[i:], bp[i:], q)) + i:
            a, b = np.arange(begins[i], ends[i]), np.arange(begins[j], ends[j])
            if i == j:
                x, y = np.triu_indices(len(a), 1)
                x, y = a[x], a[y]
            else:
                x, y = np.repeat(a, len(b)), np.tile(b, len(a))
            apart = _apart(role, side, x, y)
            out_a.append(x[apart])
            out_b.append(y[apart])
    return order[np.concatenate(out_a)], order[np.concatenate(out_b)]


def _fit(n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """Whether sets of n and m shingles that first meet at these positions can reach the threshold."""
    fits = np.minimum(n, m) * (q + 1) >= np.maximum(n, m) * (q - 1)
    return fits & (np.minimum(n - pos, m - at) * 2 * q >= (n + m) * (q - 1))


@lru_cache(GROUP)
def _two_of(length: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(length, 1)


def _packed(sized: DataFrame, group: int) -> DataFrame:
    """Lists of up to `group` sets in one row each, longer ones in rows of some `group` sets, packed in the tasks that the
    exchange of their entries brought them to."""
    part = F.when(F.col("length") > group, F.pmod(F.xxhash64("node", F.lit(4)), F.ceil(F.col("length") / group)))
    return sized.withColumn("part", part).groupBy("key", "length", "pivot", "part").agg(*(F.collect_list(c).alias(c) for c in ("node", "n", "pos", "role"))).drop("part")


def _unpacked(packed: DataFrame) -> DataFrame:
    columns = ["node", "n", "pos", "role"]
    return packed.select("key", "length", "pivot", F.inline(F.arrays_zip(*columns))).select("key", *columns, "length", "pivot")


def _candidates(packed: DataFrame, q: int) -> DataFrame:
    """a > b for the candidate pairs of packed lists of bounded length."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            offsets = columns[0].offsets.to_numpy()
            node, n, pos, role = (c.values.to_numpy() for c in columns)
            side = np.zeros_like(role)
            found, lengths = [], np.diff(offsets)
            for length in range(2, SHORT + 1):
                starts = offsets[:-1][lengths == length]
                for i in range(length if len(starts) else 0):
                    for j in range(i):
                        x, y = starts + i, starts + j
                        meet = _fit(n[x], pos[x], n[y], pos[y], q) & _apart(role, side, x, y)
                        found.append(np.stack([node[x[meet]], node[y[meet]]]))
            long = lengths > SHORT
            for s, e in zip(offsets[:-1][long].tolist(), offsets[1:][long].tolist()):
                x, y = _two_of(e - s)
                x, y = x + s, y + s
                meet = _fit(n[x], pos[x], n[y], pos[y], q) & _apart(role, side, x, y)
                found.append(np.stack([node[x[meet]], node[y[meet]]]))
            both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both.max(0)), pa.array(both.min(0))], ["a", "b"])

    return packed.select("node", "n", "pos", "role").mapInArrow(tidy(run), "a long, b long").where("a <> b")


def _shared(entries: DataFrame) -> DataFrame:
    """The entries in whose list another one stands, those of equal sets once."""
    order = Window.partitionBy("key").orderBy("node")
    beside = entries.withColumns({"before": F.lag("node").over(order), "after": F.lead("node").over(order)})
    return beside.where("(before IS NOT NULL OR after IS NOT NULL) AND NOT before <=> node").drop("before", "after")


def _sized(lists: DataFrame) -> DataFrame:
    """The rows of lists of two sets or more with the `length` of their list and its `pivot`."""
    whole = Window.partitionBy("key")
    sized = lists.withColumns({"length": F.count("*").over(whole), "p": F.min(F.struct(F.xxhash64("node"), "node")).over(whole)})
    return sized.where("length > 1").withColumn("pivot", F.col("p.node")).drop("p")


def _where_kinds_meet(lists: DataFrame) -> DataFrame:
    """The rows of lists (key, node, n, pos, role, group) in which two groups can meet, with the `length` of their list and, if
    it has two roles only, how many `ones` there are of role 1."""
    whole = Window.partitionBy("key")
    ones = F.when(F.min("role").over(whole) > 0, F.count_if(F.col("role") == 1).over(whole))
    told = {"length": F.count("*").over(whole), "ones": ones} | {f"{f.__name__}_{c}": f(c).over(whole) for f in (F.min, F.max) for c in ("role", "group")}
    return lists.withColumns(told).where("(min_role = 0 OR min_role < max_role) AND min_group < max_group").select(*lists.columns, "length", "ones")


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) with both sets, x and y; a partner of very many is copied for the join. Few pairs go to
    the sets of their first node, so that these cross one exchange only."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    if wanted.count() <= BROADCAST_ROWS:  # else every set crosses the exchanges, wanted or not
        sets = sets.join(F.broadcast(wanted), "node", "left_semi")
    partners = sets.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
    if (partners.agg(F.sum("n")).first()[0] or 0) * 8 <= BROADCAST_BYTES:
        x = sets.select(F.col("node").alias("a"), F.struct("n", "shingles").alias("x"))
        return pairs.join(x, "a").join(F.broadcast(partners.select(F.col("node").alias("b"), F.struct("n", "shingles").alias("y"))), "b")
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_TASK).alias("s"))
    dealt = pairs.join(shares.where("s > 1"), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("s", F.lit(1))).alias("salt"))
    x = sets.select(F.col("node").alias("a"), F.struct("n", "shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.struct("n", "shingles").alias("y")).join(shares, "b")
    y = y.select("b", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("salt"))
    return (F.broadcast(dealt) if pairs.count() <= BROADCAST_ROWS else dealt).join(x, "a").join(y, ["b", "salt"])


def _differ() -> Column:
    """At least how many shingles differ between the sets of x and y (structs of n and sketch)."""
    bits = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: F.bit_count(p.bitwiseXOR(r))), F.lit(0), lambda total, n: total + n)

    def half(x):
        k = F.floor(F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), k), F.slice(x, k + 1, k), lambda p, r: p.bitwiseXOR(r))

    x, y = F.col("x.sketch"), F.col("y.sketch")
    of = F.when(F.size(x) == F.size(y), bits(x, y)).when(F.size(x) == 2 * F.size(y), bits(half(x), y)).when(2 * F.size(x) == F.size(y), bits(x, half(y)))
    return F.greatest(F.abs(F.col("x.n") - F.col("y.n")), F.coalesce(of, F.lit(0)).cast("long"))


def _sketched(pairs: DataFrame, sketches: DataFrame, pivots: bool = False) -> DataFrame:
    """`pairs` (a, b) with x and y, both sides' structs of n and sketch. Of few pairs or nodes only the sketches that they
    want cross the exchanges. With `pivots` the partners are few for their pairs, and where their sketches are small, they
    go to the others'."""
    few = pairs.count() <= BROADCAST_ROWS
    wanted = pairs.select(F.col("b").alias("node")) if few else pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    wanted = wanted.distinct()
    own = sketches.join(F.broadcast(wanted), "node", "left_semi") if few or wanted.count() <= BROADCAST_ROWS else sketches
    one = (sketches if few else own).select(F.col("node").alias("a"), F.struct("n", "sketch").alias("x"))
    other = own.select(F.col("node").alias("b"), F.struct("n", "sketch").alias("y"))
    if pivots:
        partners = sketches.join(F.broadcast(pairs.select(F.col("b").alias("node")).distinct()), "node", "left_semi")
        if (partners.agg(F.sum(F.size("sketch"))).first()[0] or 0) * 8 <= BROADCAST_BYTES:
            other = F.broadcast(partners.select(F.col("node").alias("b"), F.struct("n", "sketch").alias("y")))
    return (F.broadcast(pairs) if few else pairs).join(one, "a").join(other, "b")


def _likely(pairs: DataFrame, sketches: DataFrame, q: int) -> DataFrame:
    """The pairs that their sketches leave."""
    return _sketched(pairs, sketches).where(_differ() * q <= F.col("x.n") + F.col("y.n")).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, q: int) -> DataFrame:
    both = F.size(F.array_intersect("x.shingles", "y.shingles"))
    total = F.col("x.n") + F.col("y.n")
    return _met(pairs, sets).where((total - 2 * both) * q <= total).select("a", "b")


def _linking(pairs: DataFrame, sets: DataFrame, q: int) -> DataFrame:
    """Links with the components of all links among the pairs (a > b): of each a its smallest b is checked first, then the
    pairs that no links found so far connect in a few steps."""
    pairs = checkpointed(pairs.withColumn("least", F.min("b").over(Window.partitionBy("a"))))
    found = checkpointed(_linked(pairs.where("b = least").select("a", "b"), sets, q))
    tops = found.select(F.col("a").alias("node"), F.col("b").alias("top"))
    for _ in range(2):
        above = tops.select(F.col("node").alias("top"), F.col("top").alias("higher"))
        tops = checkpointed(tops.join(above, "top", "left").select("node", F.coalesce("higher", "top").alias("top")))
    top = lambda c: tops.select(F.col("node").alias(c), F.col("top").alias(f"top_{c}"))
    rest = pairs.where("b > least").join(top("a"), "a", "left").join(top("b"), "b", "left")
    rest = checkpointed(rest.where(F.coalesce("top_a", "a") != F.coalesce("top_b", "b")).select("a", "b"))
    return found if rest.isEmpty() else found.unionByName(checkpointed(_linked(rest, sets, q)))


def _texts_of(own: DataFrame) -> DataFrame:
    """node, rep (the text that stands for it) and whether several rows have that text."""
    counted = own.groupBy("node", "doc_id").count()
    rep = counted.groupBy("node").agg(F.min(F.struct("doc_id", (F.col("count") > 1).alias("repeated"))).alias("r"))
    return stored(rep.select("node", F.col("r.doc_id").alias("rep"), "r.repeated"), "reps")


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs (of two columns)."""
    a, b = pairs.columns
    return pairs.select(F.col(a).alias("node")).union(pairs.select(b))


def _with_sets(sets: DataFrame | None, nodes: DataFrame, docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """`sets` and those of the `nodes` that it lacks, each from one text that has it. Names of up to BROADCAST_ROWS texts are
    sent to the tasks."""
    nodes = nodes.distinct()
    nodes = checkpointed(nodes if sets is None else nodes.join(sets.select("node"), "node", "left_anti"))
    count = nodes.count()
    if sets is not None and not count:
        return sets
    few = F.broadcast if count <= BROADCAST_ROWS else lambda df: df
    wanted = checkpointed(few(nodes).join(reps, "node"))
    texts = docs.join(few(wanted), docs["doc_id"] == F.col("rep")).select(F.col("node").alias("doc_id"), "text", "repeated")
    once = texts.where("NOT repeated").drop("repeated")
    if not wanted.where("repeated").isEmpty():
        once = once.unionByName(texts.where("repeated").drop("repeated").dropDuplicates(["doc_id"]))
    more = stored(_sets(once, words), "sets")
    return more if sets is None else sets.unionByName(more)


def _reach(n: str, q: int) -> Column:
    """In how many shingles a set of `n` can differ from a pivot, if it links with one that links with the pivot."""
    t = (q - 1) / (q + 1)
    return F.col(n) * (2 / (q - 1) + (1 / t + 1 / t**2) / q) + 1


def _near_pivot(pairs: DataFrame, sketches: DataFrame, q: int) -> DataFrame:
    """The pairs (node, pivot) that `_around` can keep, as their sketches tell."""
    met = _sketched(pairs.select(F.col("node").alias("a"), F.col("pivot").alias("b")), sketches, pivots=True)
    near = (_differ() * q <= F.col("x.n") + F.col("y.n")) | (_differ() <= _reach("x.n", q))
    return met.where(near).select(F.col("a").alias("node"), F.col("b").alias("pivot"))


def _around(pairs: DataFrame, sets: DataFrame, q: int) -> DataFrame:
    """node, pivot, n, linked, and the differences of the node to its pivot: first what it has more, then what it lacks; of
    the nodes that link with it, or lie so near that they can link with one that does."""
    more, less = F.array_except("x.shingles", "y.shingles"), F.array_except("y.shingles", "x.shingles")
    met = _met(pairs.select(F.col("node").alias("a"), F.col("pivot").alias("b")), sets)
    met = met.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.col("x.n").alias("n"), F.col("y.n").alias("pivot_n"), F.concat(F.sort_array(more), F.sort_array(less)).alias("apart"))
    return met.withColumn("linked", F.size("apart") * q <= F.col("n") + F.col("pivot_n")).where(F.col("linked") | (F.size("apart") <= _reach("n", q)))


def _difference_lists(around: DataFrame, q: int) -> DataFrame:
    """The lists of (pivot, difference) in which a set that links with the pivot meets all that it can link with and
    that don't link with the pivot themselves."""
    d, reach = F.size("apart"), F.floor(2 * F.col("n") / (q - 1)) + 1
    first = F.when(F.col("linked"), d - F.floor((q - 1) * d / (2 * q))).otherwise(F.least(d, reach)).cast("int")
    role = F.when(F.col("linked"), 1).otherwise(2).cast("long")
    rows = around.where(d > 0).select("node", "n", "pivot", role.alias("role"), F.explode(F.slice("apart", F.lit(1), first)).alias("token"))
    return rows.select(F.xxhash64("pivot", "token", F.lit(1)).alias("key"), "node", "n", F.lit(0).cast("long").alias("pos"), "role")


def _met_in_blocks(lists: DataFrame, sketches: DataFrame, q: int, cell: int, all_pairs: bool = True) -> DataFrame:
    """a > b for the pairs of lists (key, node, n, pos, role, group, length, ones) of any length that sketches leave, but for
    those of one group. A long list is cut into blocks of some `cell` / 2 sets; every two blocks meet once, and where each
    role meets only the other, so do the blocks of one with those of the other. Without `all_pairs` only
    the likeliest pair of each set there (where roles differ, of each one of role 2); the ends of the other pairs come as
    a (b: null) with the key of their `list`, so that only these meet again."""
    blocks = lambda n: F.when(F.col("length") <= cell, 1).otherwise(F.ceil(2 * n / cell))
    one, two, first = F.col("ones"), F.col("length") - F.col("ones"), F.col("role") == 1
    own = F.when(one.isNull(), blocks(F.col("length"))).when(first, blocks(one)).otherwise(blocks(two))
    across = F.when(one.isNull(), blocks(F.col("length"))).when(first, blocks(two)).otherwise(blocks(one))
    cut = lists.withColumns({"across": across, "block": F.pmod(F.xxhash64("node", F.lit(2)), own)})
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)))
    side = F.when(one.isNotNull() | (F.col("block") == F.col("other")), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).cast("long")
    turned = F.when(one.isNull(), F.col("block") > F.col("other")).otherwise(~first)
    key = F.xxhash64("key", F.when(turned, F.col("other")).otherwise(F.col("block")), F.when(turned, F.col("block")).otherwise(F.col("other")), F.lit(3))
    cut = cut.select(key.alias("key"), F.col("key").alias("list"), "node", "n", "pos", "role", side.alias("side"), "group")
    if (lists.agg(F.sum(across)).first()[0] or 0) <= BROADCAST_ROWS:
        dealt = F.broadcast(cut).join(sketches.select("node", "sketch"), "node")
    else:
        wanted = lists.select("node").distinct()
        own = sketches.join(F.broadcast(wanted), "node", "left_semi") if wanted.count() <= BROADCAST_ROWS else sketches
        dealt = cut.join(own.select("node", "sketch"), "node")
    grouped = dealt.groupBy("key", "list").agg(*(F.collect_list(c).alias(c) for c in ("node", "n", "pos", "role", "side", "group", "sketch")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                node, n, pos, role, side, group = (batch.column(i)[k].values.to_numpy() for i in range(2, 8))
                x, y = pairs_of_list(n, pos, role, side, q)
                apart = group[x] != group[y]
                x, y = x[apart], y[apart]
                bits, found = batch.column(8)[k].values, [np.zeros((3, 0), np.int64)]
                longs, flat = np.diff(bits.offsets.to_numpy()), bits.flatten().to_numpy().view(np.uint64)
                begins, least = np.cumsum(longs) - longs, np.minimum(longs[x], longs[y])
                for length in np.unique(least).tolist():  # sets that fit have sketches of the same length or of two times it
                    folded = np.zeros((len(node), length), np.uint64)
                    of = np.flatnonzero((longs == length) | (longs == 2 * length))
                    folded[of] = flat[begins[of, None] + np.arange(length)]
                    of = np.flatnonzero(longs == 2 * length)
                    folded[of] ^= flat[begins[of, None] + length + np.arange(length)]
                    own, step = np.flatnonzero((least == length) & (np.maximum(longs[x], longs[y]) <= 2 * length)), max(1, (1 << 21) // length)
                    for s in range(0, len(own), step):
                        a, b = x[own[s : s + step]], y[own[s : s + step]]
                        over = np.bitwise_count(folded[a] ^ folded[b]).sum(1, dtype=np.int64) * q - n[a] - n[b]
                        near = over <= 0
                        found.append(np.stack([a[near], b[near], over[near]]))
                a, b, over = np.concatenate(found, axis=1)
                others = np.zeros(0, np.int64)
                if not all_pairs:
                    ends = np.concatenate([a, b])
                    ends[np.concatenate([(role[a] == 1), (role[b] == 1)])] = -1
                    order = np.lexsort((np.tile(over, 2), ends))
                    first = order[np.r_[True, np.diff(ends[order]) != 0][: len(order)]]
                    chosen = np.unique(first[ends[first] >= 0] % max(len(a), 1))
                    others = np.unique(np.concatenate([np.delete(a, chosen), np.delete(b, chosen)]))
                    a, b = a[chosen], b[chosen]
                both = np.stack([node[a], node[b]])
                key = batch.column(1)[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([None] * len(a), pa.int64()), pa.array(both.max(0)), pa.array(both.min(0))], ["list", "a", "b"])
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(others), pa.int64()), pa.array(node[others]), pa.nulls(len(others), pa.int64())], ["list", "a", "b"])

    met = grouped.mapInArrow(tidy(run), "list long, a long, b long").where("b IS NULL OR a <> b").distinct()
    return met.select("a", "b") if all_pairs else met


def _contracted(links: DataFrame, leaders: DataFrame) -> DataFrame:
    """Links between leaders, and of each node with its own: the same components in fewer links."""
    first = checkpointed(leaders.groupBy("node").agg(F.min("pivot").alias("leader")))
    of = lambda c: first.select(F.col("node").alias(c), F.col("leader").alias(f"of_{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct()
    return between.unionByName(leaders.select(F.col("node").alias("a"), F.col("pivot").alias("b")))


def set_links(docs: DataFrame, marks: DataFrame, words: int, q: int, group: int = GROUP, rounds: int = ROUNDS, cell: int = CELL) -> DataFrame:
    """Links (a, b) between the sets (node) of `docs` (doc_id, text), each doc_id one text's; `marks` are theirs. Their
    components are those of all pairs at the threshold; pairs of sets that others connect may be left out."""
    entries = _entries(docs, words, q, _known(marks, "docs"), _known(marks, "uses"))
    lists = _shared(entries).withColumn("role", F.lit(0).cast("long"))
    own = marks.where("node IS NOT NULL")
    sketches, reps = stored(own.select("node", "n", "sketch").dropDuplicates(["node"]), "sketches"), _texts_of(own)
    links, apart, sets, leaders = None, None, None, None
    for k in range(rounds + 1):
        met = stored(_packed(_sized(lists), group), "lists")
        many = stored(_unpacked(met.where(F.col("length") > group)), "long")
        pairs = checkpointed(_likely(checkpointed(_candidates(met.where(F.col("length") <= group), q).distinct()), sketches, q))
        left = many.drop("length", "pivot")
        last = k == rounds or many.isEmpty()
        if last:
            rest = (left if apart is None else left.unionByName(apart.dropDuplicates(["key", "node"]))).withColumn("group", F.col("node"))
            rest = stored(_where_kinds_meet(rest), "rest")
            blocks = checkpointed(_met_in_blocks(rest, sketches, q, cell, all_pairs=False))
            pairs = checkpointed(pairs.unionByName(blocks.where("b IS NOT NULL").select("a", "b")).distinct())
            again = blocks.where("b IS NULL").select(F.col("list").alias("key"), F.col("a").alias("node"))
            rest = rest.join(again, ["key", "node"], "left_semi")
        wanted = _ends(pairs)
        if not last:
            near = checkpointed(many.where("node <> pivot").select("node", "pivot").distinct())
            near = checkpointed(_near_pivot(near, sketches, q))
            wanted = wanted.union(_ends(near))
        sets = _with_sets(sets, wanted, docs, reps, words)  # only of what the sketches leave
        found = _linking(pairs, sets, q)
        links = found if links is None else links.unionByName(found)
        if last and not again.isEmpty():  # what the likeliest pairs have not linked yet
            known = connected_components(links if leaders is None else links.unionByName(leaders.select(F.col("node").alias("a"), F.col("pivot").alias("b"))))
            grouped = rest.drop("group", "length", "ones").join(known, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
            grouped = checkpointed(_where_kinds_meet(grouped))
            pairs = checkpointed(_met_in_blocks(grouped, sketches, q, cell))
            sets = _with_sets(sets, _ends(pairs), docs, reps, words)
            links = links.unionByName(_linking(pairs, sets, q))
        if last:
            return links if leaders is None else _contracted(links, leaders)
        around = stored(_around(near, sets, q), "around")
        linked = around.where("linked").select("node", "pivot")
        leaders = linked if leaders is None else leaders.unionByName(linked)
        lists = many.where("node <> pivot").join(linked, ["node", "pivot"], "left_anti").select("key", "node", "n", "pos", "role")
        apart = _difference_lists(around, q) if apart is None else apart.unionByName(_difference_lists(around, q))
    return links
