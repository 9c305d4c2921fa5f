"""Language-model scoring: cross-entropy difference between a target and a background bigram model.

Both models are counted over whole corpora with the same order, the same smoothing and one vocabulary of V
words (all words of the background): P(w | v) = (count(v w) + K / V) / (count(v) + K).  A document's score
is the mean over its words of the target's loss less the background's: the lower, the more like the target.

One exchange carries counts and documents: every document's distinct bigrams and contexts travel with their
number to the bucket of their hash, so that a bucket knows the whole corpus's counts of what it holds and can
answer each document's part of the sum.  The sums of parts come back by chunk.  Within a document a bigram
travels once, and within a chunk of documents its key travels once, followed by two bytes for each document.

Defined results: null text and text without words have no words and no score (null); repeated ids are rows
of their own; without target documents the target model is uniform; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin.llm.common import U64, materialise, mix, pieces, read, text_buffer, unique_id, word_hashes, words

#: Weight of the uniform part of a model, in counts.
K = 50.0
#: Text and documents of a chunk, entries (a bigram or context of a document) in a bucket, bits of a key.
CHUNK_BYTES, CHUNK_DOCS, BUCKET_ENTRIES, KEY_BITS = 8 << 20, 1 << 16, 3_000_000, 48
_START, _CONTEXT, _BIGRAM = U64(0x1F83D9ABFB41BD6B), U64(0x5BE0CD19137E2179), U64(0x510E527FADE682D1)


def word_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of every text in order, and the first of each text."""
    data, off = text_buffer(column)
    starts, ends, first = words(data, off)
    return word_hashes(data, starts, ends), first


def vocabulary_size(docs: DataFrame, buckets: int) -> int:
    """Distinct words of the corpus, exactly: each task sends its distinct words once."""
    def distinct(batches):
        held = [np.zeros(0, np.uint64)]
        for batch in batches:
            for piece in pieces(batch, "text"):
                held.append(np.unique(word_rows(piece.column("text"))[0]))
                if sum(map(len, held[1:])) > max(len(held[0]), 1 << 20):
                    held = [np.unique(np.concatenate(held))]
        every = np.unique(np.concatenate(held))
        bucket = (every % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(i, every[order[a:b]].tobytes()) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "words": pa.array([r[1] for r in rows], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        return pa.table({"n": [len(np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()])))]})
    sent = docs.select("text").mapInArrow(distinct, "bucket int, words binary")
    return int(sent.groupBy("bucket").applyInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0)


def entries(h: np.ndarray, first: np.ndarray):
    """(hash, row, count) of every row's distinct bigrams and contexts; a row begins after a start mark."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1][np.diff(first) > 0]] = _START
    key = np.concatenate([mix(before * _BIGRAM + h), mix(before ^ _CONTEXT) | U64(1)])
    key[:len(h)] &= ~U64(1)                        # the last bit tells a context from a bigram
    row = np.concatenate([rows, rows])
    order = np.argsort(key)
    order = order[np.argsort(row[order], kind="stable")]
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return key[at], row[at], np.diff(np.append(at, len(key)))


def _packed(key, row, count) -> bytes:
    """Entries: each distinct key once (48 bits, as the difference from the one before), the number of its rows
    if more than one, the rows (16 bits), and the counts above one.  More than 255 rows repeat the key, counts
    above 255 the row."""
    if len(count) and count.max() > 255:
        times = -(-count // 255)
        at = np.repeat(np.arange(len(count)), times)
        left = count[at] - 255 * (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times))
        key, row, count = key[at], row[at], np.minimum(left, 255)
    key = key & U64((1 << KEY_BITS) - 1)
    order = np.argsort(key, kind="stable")
    key, row, count = key[order], row[order], count[order]
    at = np.arange(len(key))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % 255 == 0
    begin = np.flatnonzero(new)
    step = np.diff(key[begin], prepend=U64(0))
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    steps = np.ascontiguousarray(step.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    times, many = np.diff(np.append(begin, len(key))), count > 1
    return b"".join([np.array([len(begin), len(key), int((times > 1).sum()), width], "<u4").tobytes(), steps.tobytes(), np.packbits(times > 1).tobytes(),
                     times[times > 1].astype(np.uint8).tobytes(), row.astype("<u2").tobytes(), np.packbits(many).tobytes(), count[many].astype(np.uint8).tobytes()])


def _unpacked(raw: bytes):
    keys, n, several, width = np.frombuffer(raw, "<u4", 4).tolist()
    at = 16

    def part(kind, size):
        nonlocal at
        out = np.frombuffer(raw, kind, size, at)
        at += out.nbytes
        return out
    step = np.zeros((keys, 8), np.uint8)
    step[:, :width] = part(np.uint8, keys * width).reshape(keys, width)
    times = np.ones(keys, np.int64)
    more = np.unpackbits(part(np.uint8, -(-keys // 8)), count=keys).astype(bool)
    times[more] = part(np.uint8, several)
    row = part("<u2", n).astype(np.int32)
    many = np.unpackbits(part(np.uint8, -(-n // 8)), count=n).astype(bool)
    count = np.ones(n, np.float32)
    count[many] = part(np.uint8, -1)
    return np.repeat(np.cumsum(step.view("<u8")[:, 0], dtype=np.uint64), times), row, count


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: float = K) -> DataFrame:
    """id, n_words, target_loss, background_loss, difference (means over words) of every document.

    `target` holds the ids of the documents that the target model is counted on; all documents are the background."""
    marks = target.select(F.col(id_col).cast("long").alias("doc_id")).distinct().withColumn("in_target", F.lit(True))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, int(size / 5 * 1.3 / BUCKET_ENTRIES) + 1)
    vocabulary = max(vocabulary_size(docs, buckets), 1)
    # the marks grow with the input: the plan is that of a large table at every size
    docs = docs.join(marks.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("in_target", F.lit(False)).alias("in_target"))

    def send(batches):
        keys, rows, counts, ids, marked, sizes, held = [], [], [], [], [], [], 0

        def chunk():
            key, row_, count = (np.concatenate(x) for x in (keys, rows, counts))
            bucket = ((key >> U64(1)) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            name, flags = unique_id(), np.packbits(np.array(marked, bool)).tobytes()
            head = (np.array([0 if i is None else i for i in ids], "<i8").tobytes(), np.array(sizes, "<i8").tobytes(), np.packbits([i is None for i in ids]).tobytes())
            # a chunk's own ids and sizes pass through one of the buckets
            for i, (a, b) in enumerate(zip(cut, cut[1:])):
                if b > a or i == 0:
                    row = (name, i, _packed(key[order[a:b]], row_[order[a:b]], count[order[a:b]]), flags, *(head if i == 0 else (None, None, None)))
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), *[pa.binary()] * 5))], names=["chunk", "bucket", "data", "flags", "ids", "sizes", "nulls"])
        for batch in batches:
            for piece in pieces(batch, "text"):
                if len(ids) and (held >= CHUNK_BYTES or len(ids) + piece.num_rows > CHUNK_DOCS):
                    yield from chunk()
                    keys, rows, counts, ids, marked, sizes, held = [], [], [], [], [], [], 0
                h, first = word_rows(piece.column("text"))
                key, row, count = entries(h, first)
                keys.append(key)
                rows.append(row + len(ids))
                counts.append(count)
                ids += piece.column("doc_id").to_pylist()
                marked += piece.column("in_target").to_pylist()
                sizes += np.diff(first).tolist()
                held += piece.nbytes
        if ids:
            yield from chunk()

    def answer(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x) for x in table.column("data").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in table.column("flags").to_pylist()]
        names = table.column("chunk").to_pylist()
        where = np.concatenate([[0], np.cumsum([len(x) for x in flags])])
        key, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        row = np.concatenate([p[1] + w for p, w in zip(parts, where)])
        del parts
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        group = np.empty(len(key), np.int32)
        group[order] = np.cumsum(new) - 1
        context = (key[order[new]] & U64(1)).astype(bool)
        del order
        own = np.concatenate([*flags, np.zeros(0, bool)])[row]
        loss = []
        for weight in (count * own, count):
            total = np.bincount(group, weight)
            value = np.where(context, np.log(total + k), -np.log(total + k / vocabulary))
            loss.append(np.bincount(row, value[group] * count, where[-1]).astype("<f4"))
        return pa.table({"chunk": pa.array(names, pa.int64()), "target": pa.array([loss[0][a:b].tobytes() for a, b in zip(where, where[1:])], pa.binary()),
                         "background": pa.array([loss[1][a:b].tobytes() for a, b in zip(where, where[1:])], pa.binary()), **{c: table.column(c) for c in ("ids", "sizes", "nulls")}})

    def total(table: pa.Table) -> pa.Table:
        head = next(r for r in table.select(["ids", "sizes", "nulls"]).to_pylist() if r["ids"] is not None)
        ids, sizes = np.frombuffer(head["ids"], "<i8"), np.frombuffer(head["sizes"], "<i8")
        sums = [sum(np.frombuffer(x, "<f4")[:len(ids)].astype(float) for x in table.column(c).to_pylist()) for c in ("target", "background")]
        absent, none = np.unpackbits(np.frombuffer(head["nulls"], np.uint8))[:len(ids)].astype(bool), sizes == 0
        mean = [s / np.maximum(sizes, 1) for s in sums]
        return pa.table({id_col: pa.array(ids, mask=absent), "n_words": pa.array(sizes), "target_loss": pa.array(mean[0], mask=none),
                         "background_loss": pa.array(mean[1], mask=none), "difference": pa.array(mean[0] - mean[1], mask=none)})
    parts = (docs.mapInArrow(send, "chunk long, bucket int, data binary, flags binary, ids binary, sizes binary, nulls binary")
             .groupBy("bucket").applyInArrow(answer, "chunk long, target binary, background binary, ids binary, sizes binary, nulls binary"))
    return parts.groupBy("chunk").applyInArrow(total, f"`{id_col}` long, n_words long, target_loss double, background_loss double, difference double")


def op9_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more `documents` read like those labelled good (quality 1) than like all documents."""
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score(read(spark, sf_dir, "documents"), good)
