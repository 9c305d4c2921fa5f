"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words, and the first four and five bytes of longer words, hashed into a
fixed number of buckets.  The score is a logistic function of a bias, a weight for each term, and the
inner products of the factors of every pair of terms: a pair (an insult with a group's name) can weigh
more, or less, than the sum of the two.

Defined results: null and empty texts have no terms and get the bias alone; a learning set without both
classes gives every text the share of ones (0 if it is empty); repeated label rows of a document count as
one, toxic if any is; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin.llm.common import U64, crc_fold, pieces, read, text_buffer, word_hashes, words

#: Buckets are 2^BITS; a document outside the bounded learning sample never shapes the model.
BITS, FACTORS, SAMPLE = 18, 4, 16_000
EPOCHS, BATCH, RATE, L1, SEEN = 8, 256, 0.1, 1.5e-3, 4
#: A toxic text of the sample counts as so many, and after each pass from the second on, terms at zero are given up.
WEIGHT, L1_FACTORS = 4.0, 1e-2

APART = np.ones(256, bool)
APART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of every text, and the first of each text (one more at the end)."""
    data, off = text_buffer(array)
    starts, ends, first = words(data, off, APART)
    rows = np.repeat(np.arange(len(off) - 1), np.diff(first))
    keys = []
    for k in (0, 4, 5):
        some = np.flatnonzero(ends - starts > k) if k else slice(None)
        stop = starts[some] + k if k else ends
        h = word_hashes(data, starts[some], stop) * U64(2 * k + 1)
        keys.append((rows[some].astype(np.int64) << BITS) | (h >> U64(64 - BITS)).astype(np.int64))
    key = np.unique(np.concatenate(keys))
    return key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(len(off), dtype=np.int64) << BITS)


class Machine:
    """Weights of a factorization machine; fitted in memory on a bounded sample, applied in tasks."""

    def __init__(self, bias: float = -20.0):
        self.bias = bias
        self.w = np.zeros(1 << BITS, np.float32)
        self.v = np.zeros((1 << BITS, FACTORS), np.float32)

    def raw(self, idx: np.ndarray, first: np.ndarray):
        """Score of each text before the logistic function, and the sums of factors."""
        n = len(first) - 1
        rows = np.repeat(np.arange(n), np.diff(first))
        live = np.flatnonzero(self.live[idx]) if hasattr(self, "live") else np.arange(len(idx))
        idx, rows = idx[live], rows[live]
        sums = np.stack([np.bincount(rows, self.v[idx, f], n) for f in range(FACTORS)], axis=1) if len(idx) else np.zeros((n, FACTORS))
        squares = np.bincount(rows, (self.v[idx] ** 2).sum(axis=1), n) if len(idx) else np.zeros(n)
        linear = np.bincount(rows, self.w[idx], n) if len(idx) else np.zeros(n)
        return self.bias + linear + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums

    def score(self, idx: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(idx, first)[0], -30, 30)))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> "Machine":
        """Proximal AdaGrad on logistic loss; a term seen in fewer than SEEN texts stays at zero."""
        share = labels.mean() if len(labels) else 0.0
        self.bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        if share in (0.0, 1.0):
            self.live = np.zeros(1 << BITS, bool)
            return self
        rng = np.random.default_rng(seed)
        seen = np.zeros(1 << BITS, np.int64)
        for x in texts:
            seen[x] += 1                   # terms of a text are distinct
        self.live = seen >= SEEN
        texts = [x[self.live[x]] for x in texts]
        self.v[self.live] = rng.normal(0, 0.01, (int(self.live.sum()), FACTORS))
        gw, gv, gb = np.full(1 << BITS, 1e-4), np.full((1 << BITS, FACTORS), 1e-2), 1e-4
        for epoch in range(EPOCHS):
            if epoch > 1:
                self.live = (self.w != 0) | (self.v != 0).any(axis=1)
                texts = [x[self.live[x]] for x in texts]
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                some = order[at:at + BATCH]
                idx = np.concatenate([texts[i] for i in some])
                size = np.array([len(texts[i]) for i in some])
                first = np.concatenate([[0], np.cumsum(size)])
                rows = np.repeat(np.arange(len(some)), size)
                z, sums = self.raw(idx, first)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) * np.where(labels[some] > 0, WEIGHT, 1.0) / len(some)
                used, at_used = np.unique(idx, return_inverse=True)
                grad = np.bincount(at_used, g[rows])
                gw[used] += grad ** 2
                step = RATE / np.sqrt(gw[used])
                w = self.w[used] - step * grad
                self.w[used] = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
                for f in range(FACTORS):
                    grad = np.bincount(at_used, g[rows] * (sums[rows, f] - self.v[idx, f]))
                    gv[used, f] += grad ** 2
                    step = RATE / np.sqrt(gv[used, f])
                    v = self.v[used, f] - step * grad
                    self.v[used, f] = np.sign(v) * np.maximum(np.abs(v) - step * L1_FACTORS, 0)
                gb += g.sum() ** 2
                self.bias -= float(RATE / np.sqrt(gb) * g.sum())
        self.live = (self.w != 0) | (self.v != 0).any(axis=1)
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, text, label: all labelled documents, or about `bound` of them chosen by a hash of the id."""
    labels = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label")))
    n = labels.count()
    if n > bound:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    return docs.select("doc_id", "text").join(labels, "doc_id")


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Machine:
    """A machine fitted on a sample of at most about `bound` documents, whatever the size of the tables."""
    def extract(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                idx, first = terms(piece.column("text"))
                raw = idx.astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id").cast(pa.int64()), "label": piece.column("label").cast(pa.int64()),
                                                  "terms": pa.array([raw[4 * a:4 * b] for a, b in zip(first, first[1:])], pa.binary())})
    rows = labelled_sample(docs, labels, bound).mapInArrow(extract, "doc_id long, label long, terms binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["terms"]))
    texts, labels_ = [np.frombuffer(r["terms"], "<u4") for r in rows], np.array([r["label"] for r in rows], float)      # views: nothing is copied
    del rows
    return Machine().fit(texts, labels_)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score of every text.  The machine has a fixed size of a few MB."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def apply(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "score": pa.array(model.value.score(*terms(piece.column("text"))), pa.float64())})
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns; nothing is shuffled.

    Only texts go to Python and only scores come back; the rows themselves stay in the JVM."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def scores(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        parts = [model.value.score(*terms(piece.column("text"))) for piece in pieces(batch, "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
    return docs.where(scores(F.col("text").cast("string")) < threshold)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of documents whose checksum modulo 5 is not 0 teach."""
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels")
    machine = learn(docs, labels.where(crc_fold("doc_id", 5) != 0))
    return score(docs, machine).select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score",
                                       (F.col("score") >= 0.5).cast("int").alias("predicted"))
