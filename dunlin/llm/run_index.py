"""Exact repeats of long strings with a run-length compressed Burrows-Wheeler index.

A byte is a repeat if a string of `least` bytes over it also begins in a document with a smaller id.

Every string of that length has an anchor, its least k-mer by hash; strings with the same anchor follow
each other and make a block.  Equal strings have equal anchors, so an exchange by anchor finds all repeats:

1.  Blocks travel as sixteen bytes (hashes of anchor and content, and where they are).  Equal content in an
    earlier document settles a block; within a chunk of documents this is done before the exchange, so that
    a passage in many documents costs a row for each chunk.
2.  Blocks that share only the anchor, the edges of repeats, are sent with their bytes.  Each bucket builds
    one index: suffixes in the order of their first `least` bytes, the transform as runs, and at the ends of
    the ranges of equal strings the smallest document.  All blocks are streamed through it from right to
    left, one LF step on the runs for each byte, and strings whose range holds a smaller document are marked.
3.  The marks meet their documents, and the bytes are cut.

Defined results: null text is empty; documents with a null id neither give nor lose bytes; rows that repeat
an id must be copies, and do not repeat each other; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin.llm.common import _BYTE, U64, materialise, mix, pieces, powers, read, text_buffer

LEAST, KMER = 50, 16
#: Text of a chunk, of a group of documents, and bytes of blocks in a bucket.
CHUNK_BYTES, CHUNK_DOCS, GROUP_BYTES, BUCKET_BYTES, ENTRY = 8 << 20, 1 << 16, 4 << 20, 6 << 20, 16
#: Strings of a text whose anchors are found at once: the places of a part are below 2^26.
PART = 8 << 20
_PLACE = (1 << 26) - 1
WHOLE = np.int64(-1)


# ---------------------------------------------------------------- blocks

def _content(data: np.ndarray, strings: int) -> np.ndarray:
    """The content hash of a block, from its bytes."""
    return mix((_BYTE[data] * powers(len(data))[0]).sum(dtype=np.uint64, keepdims=True) + U64(strings - 1))


def blocks(data: np.ndarray, off: np.ndarray, least: int = LEAST, k: int = KMER):
    """row, s0, s1 (first and last string), anchor hash, content hash of every block, in order.

    A long text goes in parts that overlap by `least` - 1 bytes.  Anchors do not depend on the cut; a block
    that the cut divides is joined."""
    n = len(data) - least + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    found = []
    for p in range(0, n, PART):
        own = data[p:min(p + PART, n) + least - 1]
        s0, s1, at, anchor, content = _part(own, np.clip(off - p, 0, len(own)), least, k)
        s0, s1, at = s0 + p, s1 + p, at + p
        last = found[-1] if found else None
        if last and len(s0) and len(last[0]) and last[1][-1] == p - 1 and s0[0] == p and last[2][-1] == at[0]:
            s0[0] = last[0][-1]
            content[:1] = _content(data[s0[0]:s1[0] + least], int(s1[0] - s0[0]) + 1)
            found[-1] = tuple(x[:-1] for x in last)
        found.append((s0, s1, at, anchor, content))
    s0, s1, _, anchor, content = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found))
    return np.searchsorted(off, s0, side="right") - 1, s0, s1, anchor, content


def _part(data: np.ndarray, off: np.ndarray, least: int, k: int):
    """s0, s1, place of the anchor, anchor hash and content hash of the blocks of a part."""
    n = len(data) - least + 1
    p, inverse = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p, out=sums[1:])
    h = mix((sums[k:] - sums[:-k]) * inverse[:len(data) - k + 1])
    low, span, w = (h & ~U64(_PLACE)) | np.arange(len(h), dtype=np.uint64), 1, least - k + 1
    while span < w:
        step = min(span, w - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    at = (low & U64(_PLACE)).astype(np.int64)
    valid = np.arange(least, n + least) <= np.repeat(off[1:], np.diff(off))[:n]
    first = valid.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    s0, s1 = np.flatnonzero(first), np.flatnonzero(last)
    content = mix((sums[s1 + least] - sums[s0]) * inverse[s0] + (s1 - s0).astype(np.uint64))
    return s0, s1, at[s0], h[at[s0]], content


def ordinals(row: np.ndarray, rows: int) -> np.ndarray:
    """The number of each block in its row."""
    begin = np.searchsorted(row, np.arange(rows + 1))
    return np.arange(len(row)) - begin[row]


# ---------------------------------------------------------------- the index of a bucket

class RunIndex:
    """Run-length compressed transform of a text, with the smallest value of each range of equal strings."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, least: int = LEAST):
        n = len(text)
        padded = np.zeros(n + 8, np.uint64)
        padded[:n] = text
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key = (key << U64(8)) | padded[j:n + j]
        rank, depth = np.unique(key, return_inverse=True)[1].astype(np.int64), 8
        while depth < least:                 # order by 8, 16, 32 .. bytes: ranks of a place and of the place behind it
            step = min(depth, least - depth)
            later = np.full(n, -1, np.int64)
            later[:n - step] = rank[step:]
            rank, depth = np.unique(rank * np.int64(n + 1) + later + 1, return_inverse=True)[1].astype(np.int64), depth + step
        order = np.argsort(rank, kind="stable")
        self.n, self.least = n, least
        # runs of the transform: their characters, where they start, and how often the character stood before
        bwt = text[order - 1].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        char, size = bwt[start], np.diff(np.append(start, n))
        by_char = np.argsort(char, kind="stable")
        total = np.cumsum(size[by_char])
        self.before = np.bincount(char, size, 257).astype(np.int64).cumsum()
        self.before = np.concatenate([[0], self.before])
        self.key = (char[by_char] << 40) | start[by_char]
        self.run_size, self.run_before = size[by_char], total - size[by_char] - self.before[char[by_char]]
        self.runs = len(start)
        # ranges of equal strings, and the smallest owner at their ends
        self.range_start = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
        self.least_owner = np.minimum.reduceat(owner[order], self.range_start)

    def occurrences(self, char: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each character stands in the transform before a place."""
        i = np.searchsorted(self.key, (char << 40) | at, side="right") - 1
        ok = (i >= 0) & (self.key[np.maximum(i, 0)] >> 40 == char)
        i = np.maximum(i, 0)
        return np.where(ok, self.run_before[i] + np.minimum(at - (self.key[i] & ((1 << 40) - 1)), self.run_size[i]), 0)

    def step(self, char: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[char] + self.occurrences(char, at)

    def ranges(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.range_start, at, side="right") - 1

    def stream(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """pattern, place in it, smallest owner of every string of `least` bytes of the patterns text[begin:end],
        all of which occur in the index.  Patterns advance together, from right to left."""
        live = np.arange(len(begin))
        at, pos = np.zeros(len(begin), np.int64), end.copy()
        for _ in range(self.least):
            pos -= 1
            at = self.step(text[pos].astype(np.int64), at)
        out = []
        while len(live):
            found = self.ranges(at)
            out.append((live, pos - begin[live], self.least_owner[found]))
            more = pos > begin[live]
            live, pos, found = live[more], pos[more] - 1, found[more]
            at = self.step(text[pos].astype(np.int64), self.range_start[found])      # the string shifted by one: its range holds the step
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


# ---------------------------------------------------------------- Spark

def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) ^ U64(0x243F6A8885A308D3)) % U64(groups)).astype(np.int64)


def _by(number: np.ndarray, count: int):
    """Rows of each number: (number, places)."""
    order = np.argsort(number, kind="stable")
    cut = np.searchsorted(number[order], np.arange(count + 1))
    return [(i, order[a:b]) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


def _first_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, ids, entries (16 bytes), settled: the blocks of each chunk by anchor, and those settled in it."""
    def run(batches):
        parts, ids, held = [], [], 0

        def chunk():
            row, number, anchor, content = (np.concatenate(x) for x in zip(*parts))
            own = np.array(ids, np.int64)
            order = np.lexsort((own[row], content, anchor))
            row, number, anchor, content = row[order], number[order], anchor[order], content[order]
            new = np.ones(len(row), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
            later = own[row] != own[row[lead]]
            entry = np.empty((len(row), ENTRY), np.uint8)
            for at, size, x in ((0, 5, anchor), (5, 5, content), (10, 2, row.astype(np.uint64)), (12, 4, number.astype(np.uint64))):
                entry[:, at:at + size] = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size]
            settled = np.stack([own[row], number], axis=1)
            out = []
            for bucket, some in _by((anchor % U64(buckets)).astype(np.int64), buckets):
                open_, done = some[~later[some]], some[later[some]]
                used, again = np.unique(row[open_], return_inverse=True)
                sent = entry[open_]
                sent[:, 10:12] = again.astype("<u2").view(np.uint8).reshape(-1, 2)
                out.append((bucket, own[used].astype("<i8").tobytes(), sent.tobytes(), settled[done].astype("<i8").tobytes()))
            for at in range(0, len(out), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at:at + 16]), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "ids", "entries", "settled"])
        for batch in batches:
            for piece in pieces(batch, "text"):
                if ids and (held >= CHUNK_BYTES or len(ids) + piece.num_rows > CHUNK_DOCS):
                    yield from chunk()
                    parts, ids, held = [], [], 0
                data, off = text_buffer(piece.column("text"))
                row, _, _, anchor, content = blocks(data, off)
                parts.append((row + len(ids), ordinals(row, piece.num_rows), anchor, content))
                ids += piece.column("doc_id").to_pylist()
                held += len(data)
        if ids:
            yield from chunk()
    return docs.mapInArrow(run, "bucket int, ids binary, entries binary, settled binary")


MARKS = "grp int, edge boolean, marks binary"


def _mark_rows(groups: int, parts) -> pa.Table:
    """Marks (id, number of block, mask of its strings) by group of documents."""
    rows = []
    for edge, marks in parts:
        for g, some in _by(_group(marks[:, 0], groups), groups):
            rows.append((g, edge, marks[some].astype("<i8").tobytes()))
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("grp", pa.int32()), ("edge", pa.bool_()), ("marks", pa.binary())))})


def _meet(groups: int):
    def meet(table: pa.Table) -> pa.Table:
        keys, contents, docs_, numbers, settled = [], [], [], [], [np.zeros((0, 2), np.int64)]
        for r in table.to_pylist():
            x = np.frombuffer(r["entries"], np.uint8).reshape(-1, ENTRY)
            wide = []
            for at, size in ((0, 5), (5, 5), (10, 2), (12, 4)):
                y = np.zeros((len(x), 8), np.uint8)
                y[:, :size] = x[:, at:at + size]
                wide.append(y.view("<u8")[:, 0])
            keys.append(wide[0])
            contents.append(wide[1])
            docs_.append(np.frombuffer(r["ids"], "<i8")[wide[2].astype(np.int64)])
            numbers.append(wide[3].astype(np.int64))
            settled.append(np.frombuffer(r["settled"], "<i8").reshape(-1, 2))
        key, content, doc, number = (np.concatenate(x) for x in (keys, contents, docs_, numbers))
        order = np.lexsort((doc, content, key))
        key, content, doc, number = key[order], content[order], doc[order], number[order]
        at = np.arange(len(key))
        new_key, new = np.ones(len(key), bool), np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new[1:] = new_key[1:] | (content[1:] != content[:-1])
        lead = np.maximum.accumulate(np.where(new, at, 0))
        later = doc != doc[lead]
        # anchors that stand in several documents with several contents: their first blocks are edges
        begin = np.flatnonzero(new_key)
        several = (np.add.reduceat(new.astype(np.int64), begin) > 1) & (np.maximum.reduceat(doc, begin) != np.minimum.reduceat(doc, begin)) if len(key) else np.zeros(0, bool)
        edge = ~later & several[np.cumsum(new_key) - 1]
        mark = lambda x: np.concatenate([x, np.full((len(x), 1), WHOLE)], axis=1)
        done = np.concatenate([*settled, np.stack([doc[later], number[later]], axis=1)])
        return _mark_rows(groups, ((False, mark(done)), (True, mark(np.stack([doc[edge], number[edge]], axis=1)))))
    return meet


def _packed_docs(docs: DataFrame, groups: int) -> DataFrame:
    """grp, ids, sizes, nulls, packed: the documents of a group, many to a row and compressed."""
    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def out():
            for g, rows in held.items():
                ids, texts = zip(*rows)
                yield pa.RecordBatch.from_pydict({
                    "grp": pa.array([g], pa.int32()), "ids": [np.array([i or 0 for i in ids], "<i8").tobytes()], "nulls": [np.array([i is None for i in ids], np.uint8).tobytes()],
                    "sizes": [np.array([len(x) for x in texts], "<i8").tobytes()], "packed": [zstandard.ZstdCompressor(3).compress(b"".join(texts))]})
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            where = _group(np.array([i or 0 for i in ids], np.int64), groups).tolist()
            for i, g, text in zip(ids, where, batch.column("text").cast(pa.binary())):
                raw = text.as_py() or b""
                held.setdefault(g, []).append((i, raw))
                size += len(raw)
            if size >= 2 * CHUNK_BYTES:
                yield from out()
                held, size = {}, 0
        yield from out()
    return docs.mapInArrow(run, "grp int, ids binary, nulls binary, sizes binary, packed binary")


def _documents(table: pa.Table):
    """ids (None if null), bytes and offsets of the documents of each packed row."""
    for r in table.to_pylist():
        sizes = np.frombuffer(r["sizes"], "<i8")
        off = np.concatenate([[0], np.cumsum(sizes)])
        raw = zstandard.ZstdDecompressor().decompress(r["packed"], max_output_size=int(off[-1])) if off[-1] else b""
        yield np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["nulls"], np.uint8).astype(bool), np.frombuffer(raw, np.uint8), off


def _marks(table: pa.Table) -> np.ndarray:
    every = np.concatenate([np.zeros((0, 3), np.int64), *[np.frombuffer(x, "<i8").reshape(-1, 3) for x in table.column("marks").to_pylist()]])
    return every[np.argsort(every[:, 0], kind="stable")]


def _marked(marks: np.ndarray, ids: np.ndarray, nulls: np.ndarray):
    """(row, its marks) of the documents that have any."""
    lo, hi = np.searchsorted(marks[:, 0], ids, "left"), np.searchsorted(marks[:, 0], ids, "right")
    return [(i, marks[lo[i]:hi[i]]) for i in np.flatnonzero((hi > lo) & ~nulls)]


def _edge_bytes(buckets: int):
    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        marks, rows = _marks(right), []
        for ids, nulls, data, off in _documents(left):
            for i, own in _marked(marks, ids, nulls):
                text = data[off[i]:off[i + 1]]
                _, s0, s1, anchor, _ = blocks(text, np.array([0, len(text)]))
                for number in np.unique(own[:, 1]).tolist():
                    rows.append((int(anchor[number] % U64(buckets)), int(ids[i]), number, text[s0[number]:s1[number] + LEAST].tobytes()))
        rows.sort(key=lambda r: r[0])
        out = {"bucket": [], "ids": [], "numbers": [], "sizes": [], "bytes": []}
        at = 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to][0] == rows[at][0]:
                to += 1
            some = rows[at:to]
            out["bucket"].append(some[0][0])
            out["ids"].append(np.array([r[1] for r in some], "<i8").tobytes())
            out["numbers"].append(np.array([r[2] for r in some], "<i4").tobytes())
            out["sizes"].append(np.array([len(r[3]) for r in some], np.uint8).tobytes())
            out["bytes"].append(b"".join(r[3] for r in some))
            at = to
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in ("ids", "numbers", "sizes", "bytes")}})
    return fetch


def _index_edges(groups: int):
    def search(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ids, numbers, sizes = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("ids", "<i8"), ("numbers", "<i4"), ("sizes", np.uint8)))
        sizes = sizes.astype(np.int64)
        end = np.cumsum(sizes + 1) - 1
        begin = end - sizes
        text = np.full(int((sizes + 1).sum()), 255, np.uint8)          # 255 stands in no UTF-8 text: it parts the blocks
        keep = np.ones(len(text), bool)
        keep[end] = False
        text[keep] = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        index = RunIndex(text, np.repeat(ids, sizes + 1))
        which, place, least = index.stream(text, begin, end)
        hit = least < ids[which]
        mask = np.zeros(len(ids), np.int64)
        np.bitwise_or.at(mask, which[hit], np.int64(1) << place[hit])
        some = mask != 0
        return _mark_rows(groups, ((False, np.stack([ids[some], numbers[some].astype(np.int64), mask[some]], axis=1)),))
    return search


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
    marks = _marks(right)
    for ids, nulls, data, off in _documents(left):
        found = dict(_marked(marks, ids, nulls))
        for i in range(len(ids)):
            text = data[off[i]:off[i + 1]]
            gone = np.zeros(len(text), bool)
            if i in found:
                _, s0, s1, _, _ = blocks(text, np.array([0, len(text)]))
                number, mask = found[i][:, 1], found[i][:, 2]
                edge = np.zeros(len(text) + 1, np.int64)
                whole = mask == WHOLE
                np.add.at(edge, s0[number[whole]], 1)
                np.add.at(edge, s1[number[whole]] + LEAST, -1)
                for b, m in zip(number[~whole].tolist(), mask[~whole].tolist()):
                    for j in range(int(s1[b] - s0[b]) + 1):
                        if m >> j & 1:
                            edge[s0[b] + j] += 1
                            edge[s0[b] + j + LEAST] -= 1
                gone = np.cumsum(edge)[:-1] > 0
            out["doc_id"].append(None if nulls[i] else int(ids[i]))
            out["n_bytes"].append(len(text))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
            out["kept"].append(text[~gone].tobytes())
    return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), **{c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}, "kept": pa.array(out["kept"], pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, or with `digest` their SHA-256) of every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = max(8, int(size / 18 * ENTRY / BUCKET_BYTES) + 1), max(8, int(size / GROUP_BYTES) + 1)
    first = materialise(_first_blocks(docs.where("doc_id is not null"), buckets).groupBy("bucket").applyInArrow(_meet(groups), MARKS), "repeats")
    packed = lambda: _packed_docs(docs, groups).groupBy("grp")
    edges = packed().cogroup(first.where("edge").select("grp", "marks").groupBy("grp")).applyInArrow(_edge_bytes(4 * buckets), "bucket int, ids binary, numbers binary, sizes binary, bytes binary")
    second = materialise(edges.groupBy("bucket").applyInArrow(_index_edges(groups), MARKS), "edges")
    marks = first.where("not edge").union(second).select("grp", "marks")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _cut(left, right)
        if digest:
            at = found.schema.get_field_index("kept")
            found = found.set_column(at, "kept", pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in found.column("kept")], pa.string()))
        return found
    return packed().cogroup(marks.groupBy("grp")).applyInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")


def op10_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of `documents` under 50-byte strings that also begin in an earlier document."""
    return remove_repeats(read(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS m FROM p GROUP BY 1),
s AS (SELECT doc_id, i FROM p JOIN f USING (g) WHERE m < doc_id),
o AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS l FROM s),
k AS (SELECT doc_id, i, sum(CASE WHEN l IS NULL OR i > l + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, k),
v AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS e FROM r),
c AS (SELECT v.doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS e, string_agg(substr(x, CAST(2 * v.e + 1 AS BIGINT), CAST(2 * (a - v.e) AS BIGINT)), '' ORDER BY a) AS h FROM v JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(from_hex(coalesce(h, '') || substr(x, CAST(2 * coalesce(e, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
"""
