"""Token-id output: documents as ids in patched frame-of-reference blocks.

A segment is a run of consecutive documents.  Its ids are cut into blocks of 128; a block stores its
minimum, the differences packed at the width that nine tenths of them need, and a list of exceptions
(place and whole difference) for the rest.  The starts of all blocks stand before the packed words, so
that any block is read without the others.  Segments are rows of a Parquet table in the shared folder,
beside the documents' lengths; the id position of every segment comes from sums per partition.

Defined results: null text is empty and holds the end id alone; equal doc_ids are kept as separate
rows in either order; an empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dunlin.llm.common import PIECE_BYTES, pieces, read, scratch_path

BLOCK = 128
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PERCENTILE = 0.9
#: Ids after which a segment ends; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 18
_HEAD = struct.Struct("<4sIII")
_MAGIC = b"PFR1"


# ---------------------------------------------------------------- blocks

def pack(ids: np.ndarray) -> bytes:
    """Ids (below 2^32) as patched frame-of-reference blocks."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return _HEAD.pack(_MAGIC, 0, BLOCK, 0)
    rows = np.full(blocks * BLOCK, ids[-1], np.uint32)
    rows[:n] = ids
    rows = rows.reshape(blocks, BLOCK)
    base = rows.min(axis=1)
    delta = (rows - base[:, None]).astype(np.uint64)
    at = int(BLOCK * PERCENTILE)
    width = np.ceil(np.log2(np.partition(delta, at, axis=1)[:, at].astype(np.float64) + 1)).astype(np.uint8)
    out = delta >> width.astype(np.uint64)[:, None] != 0
    low = delta & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None]
    start = np.zeros(blocks + 1, np.uint32)
    np.cumsum(2 * width, out=start[1:], dtype=np.uint32)          # 128 values of w bits fill 2w words of 64 bits
    body = np.zeros(int(start[-1]), np.uint64)
    for w in np.unique(width):
        if w:
            of = np.flatnonzero(width == w)
            cols = np.ascontiguousarray(low[of].T)
            packed = np.zeros((2 * int(w), len(of)), np.uint64)
            for i in range(BLOCK):
                word, shift = divmod(i * int(w), 64)
                packed[word] |= cols[i] << np.uint64(shift)
                if shift + w > 64:
                    packed[word + 1] |= cols[i] >> np.uint64(64 - shift)
            body[start[of][:, None] + np.arange(2 * int(w))] = packed.T
    where = np.nonzero(out)
    return b"".join([
        _HEAD.pack(_MAGIC, n, BLOCK, blocks), base.tobytes(), width.tobytes(), out.sum(axis=1).astype(np.uint8).tobytes(),
        start.tobytes(), body.tobytes(), where[1].astype(np.uint8).tobytes(), delta[where].astype(np.uint32).tobytes()])


def unpack(data: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Ids lo..hi of a packed run; only the blocks that hold them are decoded."""
    magic, n, block, blocks = _HEAD.unpack_from(data)
    if magic != _MAGIC or block != BLOCK:
        raise ValueError("not a packed run of ids")
    hi = n if hi is None else min(hi, n)
    if lo >= hi:
        return np.zeros(0, np.uint32)
    p = _HEAD.size

    def part(kind, count):
        nonlocal p
        out = np.frombuffer(data, kind, count, p)
        p += out.nbytes
        return out
    base, width, odd = part(np.uint32, blocks), part(np.uint8, blocks), part(np.uint8, blocks)
    start = part(np.uint32, blocks + 1)
    body = part(np.uint64, int(start[-1]))
    odd_at = np.zeros(blocks + 1, np.int64)
    np.cumsum(odd, out=odd_at[1:])
    place, whole = part(np.uint8, int(odd_at[-1])), part(np.uint32, int(odd_at[-1]))
    b0, b1 = lo // BLOCK, -(-hi // BLOCK)
    rows = np.zeros((b1 - b0, BLOCK), np.uint64)
    for w in np.unique(width[b0:b1]):
        if w:
            of = np.flatnonzero(width[b0:b1] == w)
            packed = np.ascontiguousarray(body[start[b0:b1][of][:, None] + np.arange(2 * int(w))].T)
            mask, cols = np.uint64((1 << int(w)) - 1), np.zeros((BLOCK, len(of)), np.uint64)
            for i in range(BLOCK):
                word, shift = divmod(i * int(w), 64)
                v = packed[word] >> np.uint64(shift)
                if shift + w > 64:
                    v = v | packed[word + 1] << np.uint64(64 - shift)
                cols[i] = v & mask
            rows[of] = cols.T
    x0, x1 = odd_at[b0], odd_at[b1]
    rows[np.repeat(np.arange(b1 - b0), odd[b0:b1]), place[x0:x1]] = whole[x0:x1]
    flat = (rows.astype(np.uint32) + base[b0:b1, None]).reshape(-1)
    return flat[lo - b0 * BLOCK:hi - b0 * BLOCK]


# ---------------------------------------------------------------- tokens

class Encoder:
    """The tokenizers library behind two memos: of white-space pieces, and of the words in them.

    White space never enters a token of this vocabulary, so a text's ids are those of its pieces in
    turn.  A piece of letters below U+0250 in composed form is cut into words by the vocabulary's own
    pattern; new words go to the library in one text, and the ids that close a word tell where each
    ends.  Every other piece is left to the library whole."""

    MEMO, LONG = 600_000, 40
    #: Fixed value: the vocabulary's pre-tokenizer pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.closes = np.array([x.endswith("</w>") for x, _ in sorted(self.library.get_vocab().items(), key=lambda x: x[1])])
        self.find = regex.compile(self.PATTERN).findall
        self.simple = regex.compile(r"[!-~\xA1-\u024F]*").fullmatch
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def raw(self, text: str) -> bytes:
        (found,) = self.library.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, "<u4").tobytes()

    def learn_words(self, new: list[str]) -> dict[str, bytes]:
        raw = self.raw(" ".join(new))
        ends = 4 * (np.flatnonzero(self.closes[np.frombuffer(raw, "<u4")]) + 1)
        if len(ends) != len(new):
            return {x: self.raw(x) for x in new}
        ends = ends.tolist()
        return dict(zip(new, [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def learn(self, new: list[str]) -> dict[str, bytes]:
        out, cut = {}, {}
        single = [x for x in new if x.isascii() and x.isalpha()]      # one word each
        lower = " ".join(single).lower().split(" ")
        for x in new:
            if x.isascii():
                if x.isalpha():
                    continue
                plain = x.isprintable()
            else:
                plain = self.simple(x)
            if plain and "<|" not in x:
                core = x.strip(MARKS)
                if core.isalpha() and core.isascii():      # a word between marks, as the pattern cuts it
                    at = x.index(core)
                    cut[x] = [y for y in (x[:at], core.lower(), x[at + len(core):]) if y]
                else:
                    cut[x] = self.find(x.lower())
            else:
                out[x] = self.raw(x)
        held = set(lower if single else ()).union(*cut.values())
        words = self.words
        unknown = [x for x in held if x not in words]
        if unknown:
            if len(words) + len(unknown) > self.MEMO:
                words = {x: words[x] for x in held if x in words}
            words |= self.learn_words(unknown)
            self.words = words if sum(map(len, unknown)) < self.LONG * len(unknown) else {k: v for k, v in words.items() if len(k) <= self.LONG}
        if single:
            out.update(zip(single, map(words.__getitem__, lower)))
        for x, y in cut.items():
            out[x] = words[y[0]] if len(y) == 1 else b"".join([words[z] for z in y])
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Arrow cuts the texts and numbers their different pieces; only these are looked up, and numpy lays out their ids."""
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        one = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string()))      # no piece has a blank
        held, number = pc.binary_join(one, " ")[0].as_py().split(" "), coded.indices.to_numpy(zero_copy_only=False)
        memo = self.pieces
        new = [x for x in held if x not in memo]
        if new:
            if len(memo) + len(new) > self.MEMO:      # forget all but what this call needs
                memo = {x: memo[x] for x in held if x in memo}
            memo |= self.learn(new)
            self.pieces = memo if sum(map(len, new)) < self.LONG * len(new) else {k: v for k, v in memo.items() if len(k) <= self.LONG}
        raw = [memo[x] for x in held]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        own = size[number]                     # ids of every piece, and where they stand in the output and among the different ones
        ends = np.cumsum(own)
        at = np.repeat((np.cumsum(size) - size)[number] - (ends - own), own)
        at += np.arange(len(at))
        out = np.frombuffer(b"".join(raw), "<u4")[at].tobytes()
        first = np.append(0, 4 * ends)[parts.offsets.to_numpy()].tolist()
        return [out[i:j] for i, j in zip(first, first[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process; its memos serve all tasks that the process runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- the file

SEGMENT = "part long, seq long, n_ids long, doc_ids binary, null_ids binary, lengths binary, ids binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of whole texts in ascending id order to `path`, a folder that all executors share."""
    def segments(batches):
        part = TaskContext.get().partitionId()
        encode, end = encoder(tokenizer).encode_all, np.array([end_id], "<u4").tobytes()
        keys, ids, held, seq = [], [], 0, 0

        def flush():
            nonlocal keys, ids, held, seq
            known = np.array([k if k is not None else 0 for k in keys], "<i8")
            row = [part, seq, held, known.tobytes(), np.array([k is None for k in keys], np.uint8).tobytes(),
                   np.array([len(x) // 4 for x in ids], "<u8").tobytes(), pack(np.frombuffer(b"".join(ids), "<u4"))]
            keys, ids, held, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict({n: pa.array([v], type=t) for (n, t), v in zip(ARROW, row)})
        for batch in batches:
            for piece in pieces(batch, "text", 4 * PIECE_BYTES):      # the more words at once, the fewer different ones
                found = encode([x or "" for x in piece.column("text").to_pylist()])
                for key, x in zip(piece.column("doc_id").to_pylist(), found):
                    keys.append(key)
                    ids.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
        if keys:
            yield flush()

    ARROW = [("part", pa.int64()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()),
             ("null_ids", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())]
    (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(segments, SEGMENT).write.mode("overwrite").parquet(path))


def segment_index(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, start: how many ids stand before each segment.  Two levels: within a part, and over the parts."""
    seg = spark.read.schema(SEGMENT).parquet(path).select("part", "seq", "n_ids")
    parts = seg.groupBy("part").agg(F.sum("n_ids").alias("n"))        # one row for each written partition
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = seg.withColumn("inside", F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(before.select("part", "before"), "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document of a token file."""
    def documents(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.frombuffer(r["lengths"], "<u8").astype(np.int64)
                off = np.concatenate([[0], np.cumsum(lengths)])
                raw = unpack(r["ids"]).astype("<u4").tobytes()
                absent = np.frombuffer(r["null_ids"], np.uint8).astype(bool)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=absent),
                    "start": pa.array(off[:-1] + r["start"]), "n_tokens": pa.array(lengths),
                    "ids": pa.array([raw[4 * a:4 * b] for a, b in zip(off, off[1:])], type=pa.binary())})
    seg = spark.read.schema(SEGMENT).parquet(path)
    return (seg.join(segment_index(spark, path), ["part", "seq"]).select("start", "doc_ids", "null_ids", "lengths", "ids")
            .mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token file of `documents`, read back: position, length and checksum of every document's ids."""
    import public_tokenizers
    path = scratch_path(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
