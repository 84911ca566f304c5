"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of PASSAGE bytes. An encoder maps a passage's measures to a hidden vector, a gated
attention (tanh times sigmoid) weighs the passages, and a logistic unit scores the weighted sum. All weights are
learned together from document labels, on a bounded sample of labelled rows; the scoring pass covers every text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, tidy, whole_texts
from .pieces import text_slices

PASSAGE = 512
#: Bounds of the fit alone: most labelled documents, and most bytes of them all (a document counts whole or not at all).
FIT_DOCUMENTS, FIT_BYTES = 4000, 32 << 20
FIT_TEXT = FIT_BYTES // 16  # bytes of one text
FOLDS = 5
CUT = 0.3
HIDDEN, GATE, STEPS, RATE, DECAY = 16, 8, 400, 0.03, 1e-4

_CLASS = np.zeros(256, np.uint8)
for _k, _set in enumerate((range(65, 91), range(97, 123), range(128, 256), range(48, 58), b" ", b"\n\r\t", b"|", b"!?", b"%$*#&@^~=+<>{}[]\\/_", b".,;:'\"()-"), 1):
    for _b in _set:
        _CLASS[_b] = _k
COUNTED, GRAMS = 10 + 7, 64  # measures of a passage: counted by hand, and hashed byte trigrams
MEASURES = COUNTED + GRAMS


def passages(text: str) -> np.ndarray:
    """Measures of every passage of a text, one row each (one row for an empty text): shares of byte classes, word
    variety and repetition, word length, size; and root shares of its byte trigrams by hash, whose weights are learned."""
    data = text.encode("utf-8")
    n = max(1, (len(data) + PASSAGE // 2) // PASSAGE)
    cuts = [i * PASSAGE for i in range(n)] + [len(data)]
    out = np.zeros((n, MEASURES), np.float32)
    if not data:
        return out
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    for i in range(n):
        a, b = cuts[i], cuts[i + 1]
        out[i, :10] = np.bincount(kinds[a:b], minlength=11)[1:11] / (b - a)
        w = data[a:b].split()
        if w:
            size = len(w)
            seen = len(set(w))
            out[i, 10] = seen / size
            out[i, 11] = sum(map(bytes.__eq__, w, w[1:])) / size
            out[i, 12] = len(set(zip(w, w[1:], w[2:]))) / max(1, size - 2)
            out[i, 13] = min(3.0, (b - a) / size / 10)
            out[i, 14] = sum(map(len, set(w))) / (b - a)
        out[i, 15] = np.log1p(b - a) / 10
    out[:, 16] = np.log1p(len(data)) / 20
    if len(data) >= 3:
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        gram = (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int64)
        of = np.minimum(np.arange(len(gram)) // PASSAGE, n - 1)
        counts = np.bincount(of * GRAMS + gram, minlength=n * GRAMS).reshape(n, GRAMS)
        out[:, COUNTED:] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
    return out


class AttentionModel:
    """Gated attention over passages; plain arrays, so it travels with the tasks."""

    def __init__(self, measures: int = MEASURES, seed: int = 7):
        r = np.random.default_rng(seed)
        scale = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": scale(measures, HIDDEN), "b": np.zeros(HIDDEN), "V": scale(HIDDEN, GATE), "U": scale(HIDDEN, GATE), "w": scale(GATE, 1)[:, 0], "c": scale(HIDDEN, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.std = np.zeros(measures), np.ones(measures)

    def _forward(self, x, starts, sizes):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return h, t, s, a, z, 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        sizes = np.array([len(x) for x in bags])
        x = (np.concatenate(bags) - self.mean) / self.std
        return self._forward(x, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)[-1]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray) -> "AttentionModel":
        """Full-batch Adam on the mean log loss; the same input gives the same weights."""
        sizes = np.array([len(x) for x in bags])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x = np.concatenate(bags)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        x = ((x - self.mean) / self.std).astype(np.float32)
        self.p = {k: w.astype(np.float32) for k, w in self.p.items()}
        m, v = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for step in range(1, STEPS + 1):
            p = self.p
            h, t, s, a, z, y = self._forward(x, starts, sizes)
            dy = (y - labels) / len(labels)
            dz = np.repeat(dy[:, None] * p["c"], sizes, axis=0)
            da = (dz * h).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
            dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
            dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
            grads = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ dy, "d": np.array([dy.sum()])}
            for k, g in grads.items():
                g = g + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit_quality(df: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> AttentionModel:
    """The model learned from at most `most` labelled rows (those with the smallest hash of their doc_id) outside the
    held-out fold, as far as FIT_BYTES go, each with all its passages; a text over FIT_TEXT bytes is left out alone. Rows with a null or other label, or without a
    document, teach nothing; of several labels of a document the largest counts, of several texts the first in order.
    Without both classes every score is the share of label 1 (0.5 without labels)."""
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("_label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for doc, label, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_label", "text"))):
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([label], pa.float64()), pa.array([passages(text).astype("<f4").tobytes()], pa.binary())], ["doc_id", "label", "x"])

    held = whole_texts(df).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("_label").alias("_label"), F.min("text").alias("text"))
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # at most `most` sizes
    within = stored(held, "labelled").withColumn("_size", F.octet_length("text"))
    chosen = within.where(F.col("_size") <= FIT_TEXT).select("doc_id", F.sum("_size").over(so_far).alias("_sum")).where(F.col("_sum") <= FIT_BYTES).select("doc_id")
    rows = within.join(F.broadcast(chosen), "doc_id").select("doc_id", "_label", "text").mapInArrow(tidy(run), "doc_id long, label double, x binary").collect()
    if not rows and not within.isEmpty():
        raise ValueError(f"every labelled text is longer than {FIT_TEXT} bytes")
    rows.sort(key=lambda r: (r.doc_id, r.x))
    bags, y = [np.frombuffer(r.x, "<f4").reshape(-1, MEASURES) for r in rows], np.array([r.label for r in rows])
    model = AttentionModel()
    if len(set(y.tolist())) == 2:
        return model.fit(bags, y)
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 0.5
    model.p |= {"c": np.zeros(HIDDEN), "d": np.array([np.log(share / (1 - share))])}
    return model


def quality_scores(df: DataFrame, model: AttentionModel) -> DataFrame:
    """doc_id, score for every (doc_id, text): the only inputs of a score are the bytes of the text.

    Null and empty texts are scored as one empty passage; a null doc_id stays null; repeated rows are scored each; an
    empty table gives no rows. One pass, no shuffle.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, texts in text_slices(batch, 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(model.score([passages(t) for t in texts]), pa.float64())], ["doc_id", "score"])

    return whole_texts(df).mapInArrow(tidy(run), "doc_id long, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(df: DataFrame, model: AttentionModel, cut: float = CUT) -> DataFrame:
    """The rows of `df` with a score of at least `cut`, all columns, in one pass."""
    schema = df.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text")
            keep = []
            for at in range(0, batch.num_rows, 16):
                part = ["" if t is None else t for t in texts.slice(at, 16).to_pylist()]
                keep += (model.score([passages(t) for t in part]) >= cut).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(tidy(run), schema)
