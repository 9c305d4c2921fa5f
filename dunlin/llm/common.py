"""What the operators share: reading tables, cutting Arrow batches, words and shingles as 64-bit hashes.

Text is handled as the UTF-8 bytes of whole Arrow columns, so that one numpy call serves many documents.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin.session import materialise, scratch_path  # noqa: F401  (the lineage cut in the shared folder)

#: Bytes of text that one numpy call handles; a longer document is a piece of its own.
PIECE_BYTES = 1 << 19


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(column: str, n: int):
    """crc32 of an id written as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def unique_id() -> int:
    """A number for a chunk, distinct over all tasks and attempts."""
    return uuid.uuid4().int >> 65


# ---------------------------------------------------------------- Arrow

def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES):
    """Slices of a batch holding about `limit` bytes of the text column each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    i, n = 0, len(sizes)
    while i < n:
        base = ends[i] - sizes[i]
        j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    off = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + len(array) + 1]
    if array.buffers()[2] is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(array.buffers()[2], dtype=np.uint8)[off[0]:off[-1]], off - off[0]


def binary_rows(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


# ---------------------------------------------------------------- hashing

U64 = np.uint64
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
BYTE_LOWER = _BYTE[_LOWER]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^0 .. R^(n-1) modulo 2^64, and their inverses."""
    if len(_powers[0]) < n:
        size = max(n, 2 * PIECE_BYTES)
        for k, r in ((0, _R), (1, _RINV)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words(data: np.ndarray, off: np.ndarray, apart: np.ndarray = SPACE):
    """Words of each row: start and end bytes, and the first word of each row (one more at the end).

    `apart` marks the bytes that separate words; words never cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    word = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word
    last[:-1] &= ~last[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_LOWER) -> np.ndarray:
    """64-bit hash of each word, A-Z taken as a-z; a long text is hashed in runs of whole words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) > 16 * PIECE_BYTES and len(starts) > 1:
        half = len(starts) // 2
        cut = starts[half]
        return np.concatenate([word_hashes(data[:cut], starts[:half], ends[:half], table),
                               word_hashes(data[cut:], starts[half:] - cut, ends[half:] - cut, table)])
    p, inverse = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * p, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of a row, in order, and the first of each row.

    With `short`, a row of fewer words but one gives the hash of its whole sequence; otherwise it gives none."""
    counts = np.diff(first)
    keep = np.maximum(counts - n + 1, 0)
    if short:
        keep = np.where((counts > 0) & (counts < n), 1, keep)
    begin = np.zeros(len(first), np.int64)
    np.cumsum(keep, out=begin[1:])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], keep)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    acc = np.zeros(len(at), np.uint64)
    size = np.repeat(np.minimum(counts, n), keep)
    for j in range(n):
        acc = acc * U64(0xD6E8FEB86659FD93) + padded[at + j] if not short else np.where(j < size, acc * U64(0xD6E8FEB86659FD93) + padded[at + j], acc)
    return mix(acc + size.astype(np.uint64)), begin
