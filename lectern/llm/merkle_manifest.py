"""A manifest of a table as hash trees, one for each language under a common root, with a proof for every row.

Time-forward processing: nodes carry labels in which children come before parents, and a priority queue ordered by
label brings the digests of children to their parent. A task holds the queue of one segment, 8^LEVELS nodes next to each
other in one tree, of which at most a run for each level is open; the digests of whole segments are messages to nodes of
the next round, which Spark's exchange orders by label (the part of the queue that is outside memory). A round takes
LEVELS levels, so there are few. The sweep back goes from the root down: every node gives each child the digests beside
it and what it has been given itself, until the leaves hold their proofs.
"""

from __future__ import annotations

import heapq
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, stored, table, tasks_for, tidy

ARITY = 8
LEVELS = 3
SEGMENT = ARITY**LEVELS
BROADCAST_ROWS = 100_000  # counts of parts, some 40 bytes each; more are joined
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest_of_row(columns: list[Column]) -> Column:
    """Hex SHA-256 of the columns one after the other: `-` for null, else UTF-8 bytes, `:`, value."""
    return F.sha2(F.concat(*map(_field, columns)), 256)


def _hash(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode("ascii")).hexdigest()


def swept(leaves: list[str], levels: int) -> list[tuple[int, int, list[str], str]]:
    """(level, index, digests of the children, digest) of the nodes above `leaves`, children before parents."""
    queue, done, n = [], [], len(leaves)

    def send(level: int, index: int, digest: str) -> None:
        parent = index // ARITY
        last = min((parent + 1) * ARITY ** (level + 1), n) - 1  # the last leaf below the parent
        heapq.heappush(queue, (last, level + 1, parent, index, digest))

    for i, leaf in enumerate(leaves):
        if levels:
            send(0, i, leaf)
        while queue and queue[0][0] <= i:
            label, children = queue[0][:3], []
            while queue and queue[0][:3] == label:
                children.append(heapq.heappop(queue)[4])
            _, level, index = label
            done.append((level, index, children, _hash(children)))
            if level < levels:
                send(level, index, done[-1][3])
    return done


def swept_back(leaves: list[str], levels: int, above: str):
    """(place, proof) of every leaf: for each level from the leaf up, what stands left and right of it; then `above`."""
    if not levels:
        yield from ((i, above) for i in range(len(leaves)))
        return
    given = {(levels, 0): above}
    for level, index, children, _ in reversed(swept(leaves, levels)):
        own = given.pop((level, index))
        run = "".join(children)
        for k in range(len(children)):
            proof = f"{run[: 64 * k]}/{run[64 * (k + 1) :]}" + ("," + own if own else "")
            if level == 1:
                yield index * ARITY + k, proof
            else:
                given[level - 1, index * ARITY + k] = proof


def folded(digest: str, proof: str) -> str:
    """The root that a leaf's digest and its proof give."""
    for level in filter(None, proof.split(",")):
        left, _, right = level.partition("/")
        digest = _hash([left, digest, right])
    return digest


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """`nodes` with `pos`, their place within their `tree` by `order`, and the tree's `size`. Rows that are equal in all of
    `order` stand in any order; a tree's rows lie in many parts, whose counts are summed."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            local = []
            for tree in batch.column("tree").to_pylist():
                last, seen = tree, (seen + 1 if tree == last else 0)
                local.append(seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64())], [*batch.schema.names, "part", "local"])

    by = ["tree", *order, "salt"]
    salted = nodes.withColumn("salt", F.monotonically_increasing_id())
    ordered = salted.repartitionByRange(tasks_for(nodes), *by).sortWithinPartitions(*by).drop("salt")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    path = new_path(nodes.sparkSession, "ordered")
    ordered.mapInArrow(tidy(run), f"{schema}, part int, local long").write.parquet(path)
    ordered = nodes.sparkSession.read.parquet(path)
    parts = ordered.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    up = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "part", F.coalesce(F.sum("rows").over(up), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("tree")).alias("size"))
    parts = stored(parts, "parts")
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    return ordered.join(parts, ["tree", "part"]).withColumn("pos", F.col("before") + F.col("local")).drop("part", "local", "before")


def _height(size: Column) -> Column:
    """Levels above `size` leaves."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(20)), F.struct(size.alias("n"), F.lit(0).alias("h")), lambda s, _: F.when(s["n"] > 1, F.struct(F.ceil(s["n"] / ARITY).alias("n"), (s["h"] + 1).alias("h"))).otherwise(s))["h"]


def _segments(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """tree, seg, height and `nodes` (structs of `columns` in order) of (tree, pos, height, ...)."""
    held = F.struct("pos", *columns)
    grouped = nodes.groupBy("tree", F.expr(f"pos div {SEGMENT}").alias("seg")).agg(F.first("height").alias("height"), F.sort_array(F.collect_list(held)).alias("nodes"))
    return grouped


def _up(segments: DataFrame) -> DataFrame:
    """tree, pos, height, digest: a node for each segment."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            digests = []
            for nodes, height in zip(batch.column("nodes"), batch.column("height").to_pylist()):
                leaves, levels = [x["digest"] for x in nodes.as_py()], min(LEVELS, height)
                digests.append(swept(leaves, levels)[-1][3] if levels else leaves[0])
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("seg"), pa.array([max(0, h - LEVELS) for h in batch.column("height").to_pylist()], pa.int32()), pa.array(digests)], ["tree", "pos", "height", "digest"])

    return segments.select("tree", "seg", "height", F.transform("nodes", lambda x: F.struct(x["digest"].alias("digest"))).alias("nodes")).mapInArrow(tidy(run), "tree string, pos long, height int, digest string")


def _forest(leaves: DataFrame, columns: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The segments of every round, from the leaves up, and (tree, digest) of the roots."""
    rounds, nodes = [], leaves.withColumn("height", _height(F.col("size")))
    while True:
        rounds.append(stored(_segments(nodes, columns), "segments"))
        nodes, columns = stored(_up(rounds[-1]), "nodes"), ["digest"]
        if nodes.where("pos > 0 OR height > 0").isEmpty():
            return rounds, nodes.select("tree", "digest")


def _down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, pos, proof, subroot, root of the leaves' segments; `above` has them (pos: 0) for the roots."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                leaves = [x["digest"] for x in row["nodes"]]
                places, proofs = zip(*swept_back(leaves, min(LEVELS, row["height"]), row["proof"]))
                n = len(places)
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * n, pa.string()), pa.array([row["seg"] * SEGMENT + p for p in places], pa.int64()), pa.array(proofs), pa.array([row["subroot"]] * n, pa.string()), pa.array([row["root"]] * n, pa.string())], ["tree", "pos", "proof", "subroot", "root"])

    for segments in rounds[:0:-1]:
        joined = segments.join(above.withColumnRenamed("pos", "seg"), ["tree", "seg"])
        above = stored(joined.mapInArrow(tidy(run), "tree string, pos long, proof string, subroot string, root string"), "proofs")
    return rounds[0].join(above.withColumnRenamed("pos", "seg"), ["tree", "seg"])


def _leaf_rows(segments: DataFrame) -> DataFrame:
    """A row for each leaf: its proof's digest, the root that the tampered leaf folds to."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                nodes = row["nodes"]
                found = {k: [] for k in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
                for i, proof in swept_back([x["digest"] for x in nodes], min(LEVELS, row["height"]), row["proof"]):
                    x = nodes[i]
                    root = folded(x["tampered"] or x["digest"], proof)
                    siblings = proof.replace("/", "").replace(",", "")
                    for k, v in zip(found, (x["doc_id"], x["digest"], row["subroot"], row["root"], _hash([siblings]), root, root == row["root"])):
                        found[k].append(v)
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), kinds)], list(found))

    return segments.mapInArrow(tidy(run), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def merkle_manifest(df: DataFrame, tampered: DataFrame | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of `df`.

    A row's leaf holds doc_id, source, lang, n_chars and text, nulls told apart from empty values. Leaves ascend by
    doc_id in their language (null first; equal doc_ids by leaf, equal rows in any order); null is a language of its own,
    the first. `df` may have a column `tampered`, the digest of the row as it was found later (null: as it was): folded_root
    is what that gives with the old siblings. An empty table gives no rows.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), digest_of_row([F.col(c) for c in FIELDS]).alias("digest"), (F.col("tampered") if "tampered" in df.columns else F.lit(None)).cast("string").alias("tampered"))
    trees, subroots = _forest(_placed(rows, ["doc_id", "digest"]), ["doc_id", "digest", "tampered"])
    tops, roots = _forest(_placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest"), ["lang"]), ["lang", "digest"])
    start = roots.select("tree", F.lit(0).cast("long").alias("pos"), F.lit("").alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    last = _down(tops, start)

    def to_trees(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                found = [(row["nodes"][i]["lang"], 0, proof, row["nodes"][i]["digest"], row["root"]) for i, proof in swept_back([x["digest"] for x in row["nodes"]], min(LEVELS, row["height"]), row["proof"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), *[pa.string()] * 3))], ["tree", "pos", "proof", "subroot", "root"])

    above = stored(last.mapInArrow(tidy(to_trees), "tree string, pos long, proof string, subroot string, root string"), "tree-proofs")
    return _leaf_rows(_down(trees, above))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' manifest; every third one, by the CRC of its id, is looked at again with its text in lower case."""
    docs = table(spark, sf_dir, "documents")
    lowered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    due = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle_manifest(docs.select(*FIELDS, F.when(due, digest_of_row(lowered)).alias("tampered")))
