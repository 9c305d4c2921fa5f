"""Fill-in-middle documents by rotation of blocks in place.

A text is one bytearray.  The cuts are found by scanning its lead bytes, the sentinels are inserted at the cuts,
and the segments change places by rotations of three reversals each, which swap bytes through a buffer of
fixed size.  The way back finds the sentinels, rotates the other way round and takes the sentinels out.

    psm   <P>prefix<S>suffix<M>middle          spm   <S>suffix<P>prefix<M>middle

Cuts and form are drawn from a hash of the document's id, so that every run and every retry gives the same rows.

Defined results: null text is empty, an empty text is plain; a text that holds a sentinel stays plain, so the way
back is exact for every text; bytes that are no valid UTF-8 are kept (a code point is a byte that continues none);
a null id hashes as an empty one; rows that repeat an id are cut alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin.llm.common import pieces, read

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Share of documents (in hundredths) that are transformed, and of those that take the form spm.
TRANSFORMED, SPM = 90, 20
#: Bytes that a scan or a reversal handles at a time.
BLOCK = 1 << 16


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4)]


def lead_counts(data: np.ndarray) -> np.ndarray:
    """Code points that begin before each block of the text, and before its end."""
    counts = [np.count_nonzero((data[a:a + BLOCK] & 0xC0) != 0x80) for a in range(0, len(data), BLOCK)]
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)


def byte_of(data: np.ndarray, counts: np.ndarray, k: int) -> int:
    """The byte at which code point k begins; the end of the text for the number after the last."""
    if k == 0:
        return 0
    if k >= counts[-1]:
        return len(data)
    block = int(np.searchsorted(counts, k, side="right")) - 1
    leads = np.flatnonzero((data[block * BLOCK:(block + 1) * BLOCK] & 0xC0) != 0x80)
    return block * BLOCK + int(leads[k - counts[block]])


def reverse(data: np.ndarray, lo: int, hi: int) -> None:
    """Turn bytes lo..hi round where they stand."""
    while hi - lo > 1:
        k = min(BLOCK, (hi - lo) // 2)
        left = data[lo:lo + k].copy()
        data[lo:lo + k] = data[hi - k:hi][::-1]
        data[hi - k:hi] = left[::-1]
        lo, hi = lo + k, hi - k


def rotate(text: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange the neighbours lo..mid and mid..hi."""
    data = np.frombuffer(text, np.uint8)
    reverse(data, lo, mid)
    reverse(data, mid, hi)
    reverse(data, lo, hi)


def transform(raw: bytes, doc_id: int | None, seed: int = 1) -> tuple[int, str, int | None, int | None, bytearray]:
    """Code points, form, code points of prefix and middle, and the transformed text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    data = np.frombuffer(raw, np.uint8)
    counts = lead_counts(data)
    n = int(counts[-1])
    if not raw or h3 % 100 >= TRANSFORMED or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, bytearray(raw)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = byte_of(data, counts, a), byte_of(data, counts, b)
    text = bytearray(raw)
    text[second:second] = SUFFIX
    text[first:first] = MIDDLE
    text[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    form = "spm" if h4 % 100 < SPM else "psm"
    rotate(text, 0 if form == "spm" else middle, suffix, len(text))
    return n, form, a, b - a, text


def restore(raw: bytes, form: str) -> bytearray:
    """The text from which a form was made."""
    text = bytearray(raw)
    if form == "plain":
        return text
    if form == "spm":
        rotate(text, 0, text.find(PREFIX), len(text))
    else:
        rotate(text, text.find(SUFFIX), text.find(MIDDLE), len(text))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):       # from the last to the first, so that little moves
        at = text.rfind(sentinel)
        del text[at:at + len(sentinel)]
    return text


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (binary) of every row; nothing is shuffled."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        for batch in batches:
            for piece in pieces(batch, "raw"):
                ids, out = piece.column("doc_id"), []
                for i, raw in zip(ids.to_pylist(), piece.column("raw")):
                    n, form, a, m, text = transform(raw.as_py() or b"", i, seed)
                    out.append((n, form, a, m, bytes(text)))
                n, form, a, m, text = zip(*out)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64()), pa.array(m, pa.int64()),
                                                  pa.array(text, pa.binary())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return (docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
            .mapInArrow(apply, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"))


def with_restored(rows: DataFrame) -> DataFrame:
    """The rows with the text rebuilt from output and form, in column restored (binary)."""
    kind = rows.schema
    names = kind.names

    def apply(batches):
        for batch in batches:
            for piece in pieces(batch, "output"):
                text = [bytes(restore(raw.as_py() or b"", form.as_py())) for raw, form in zip(piece.column("output"), piece.column("form"))]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(text, pa.binary())], [*names, "restored"])
    return rows.mapInArrow(apply, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields) + ", restored binary")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its form, and the text rebuilt from it, as digests."""
    rows = with_restored(fill_in_middle(read(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT doc_id, t, n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS UBIGINT) FOR k IN range(4)] AS h FROM d),
c AS (SELECT doc_id, t, n, CAST(least(h[1] % (n + 1), h[2] % (n + 1)) AS BIGINT) AS a, CAST(greatest(h[1] % (n + 1), h[2] % (n + 1)) AS BIGINT) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, '<P>' || substr(t, 1, a) AS p, '<M>' || substr(t, a + 1, b - a) AS m, '<S>' || substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
