"""Similarity join of documents on word n-grams (Jaccard), with rare-first prefix filtering.

A document is the set of its distinct word n-grams.  Sets are ordered by a common order, rare n-grams
first: by the logarithm of a count that a fixed table of hash buckets keeps over the whole corpus, then
by hash.  Two sets can only reach the threshold if their prefixes share an n-gram; candidates that share
one pass a length filter, a positional filter (at the first n-gram that they share, what can still follow in
both) and a suffix filter (their parities in hash classes differ in no more classes than their members
differ: a lower bound of the Hamming distance), and are verified once per pair on the sets.

Equal sets are one class.  Links inside large groups of near copies are not listed pair by pair: first
every set is verified against the leader of each shared prefix n-gram, the set that has it foremost (in a
group of near copies, the one with the fewest n-grams of its own); then, and only between sets that are not
yet connected, all remaining candidates are verified.  So components are exact.

Defined results: null text, and text without words, is an empty set, linked with nothing; fewer words
than n give one n-gram, the whole sequence; equal ids count as rows of one node; a row without an id is linked
with nothing, and has no component; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin.llm.common import U64, materialise, mix, pieces, read, shingle_hashes, text_buffer, word_hashes, words
from dunlin.llm.components import components

#: Buckets of the count table, and rows into which it is cut for the exchange.
COUNT_BITS, COUNT_ROWS = 18, 64
KEY_BYTES = 5


def sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, and the first of each text (one more at the end)."""
    data, off = text_buffer(column)
    starts, ends, first = words(data, off)
    h, begin = shingle_hashes(word_hashes(data, starts, ends), first, n, short=True)
    rows = np.repeat(np.arange(len(off) - 1), np.diff(begin))
    order = np.argsort(h)
    order = order[np.argsort(rows[order], kind="stable")]
    h, rows = h[order], rows[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[keep], rows[keep]
    return h, np.searchsorted(rows, np.arange(len(off)))


def set_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ U64(0x5851F42D4C957F2D)), out=sums[1:])
    return mix((sums[first[1:]] - sums[first[:-1]]) ^ np.diff(first).astype(np.uint64)).view(np.int64)


def parities(h: np.ndarray, first: np.ndarray) -> pa.Array:
    """For each set the parity of its members in each of a power of two of classes, about four for a member."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        classes = max(64, 1 << (4 * (b - a) - 1).bit_length()) if b > a else 64
        odd = np.bincount((h[a:b] & U64(classes - 1)).astype(np.int64), minlength=classes) & 1
        out.append(np.packbits(odd.astype(bool)).tobytes())
    return pa.array(out, pa.binary())


def differing(a: bytes, b: bytes) -> int:
    """Classes in which two parities differ; the longer is folded to the length of the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) if len(v) > n else v for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """One pass: a row for each document (id, size, set id) and, for each task, its part of the count table."""
    per = (1 << COUNT_BITS) // COUNT_ROWS

    def profile(batches):
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, first = sets(piece.column("text"), n)
                counts += np.bincount((h >> U64(64 - COUNT_BITS)).astype(np.int64), minlength=len(counts))
                size = piece.num_rows
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id").cast(pa.int64()), "n": pa.array(np.diff(first)),
                                                  "sid": set_ids(h, first), "parity": parities(h, first), "row": pa.nulls(size, pa.int32()), "counts": pa.nulls(size, pa.binary())})
        if counts.any():
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.nulls(COUNT_ROWS, pa.int64()), "n": pa.nulls(COUNT_ROWS, pa.int64()), "sid": pa.nulls(COUNT_ROWS, pa.int64()), "parity": pa.nulls(COUNT_ROWS, pa.binary()),
                "row": pa.array(np.arange(COUNT_ROWS, dtype=np.int32)),
                "counts": pa.array([counts[i * per:(i + 1) * per].astype("<u8" if counts.max() >> 32 else "<u4").tobytes() for i in range(COUNT_ROWS)], pa.binary())})
    return docs.mapInArrow(profile, "doc_id long, n long, sid long, parity binary, row int, counts binary")


def _count_classes(profile: DataFrame) -> np.ndarray:
    """The whole count table as logarithms: 2^COUNT_BITS bytes, whatever the corpus."""
    per = (1 << COUNT_BITS) // COUNT_ROWS

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(per, np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, "<u4" if len(x) == 4 * per else "<u8").astype(np.int64)
        return pa.table({"row": table.column("row")[:1], "classes": pa.array([np.ceil(2 * np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())})
    rows = profile.where("row is not null").select("row", "counts").groupBy("row").applyInArrow(add, "row int, classes binary").collect()
    out = np.zeros(1 << COUNT_BITS, np.uint8)
    for r in rows:
        out[r["row"] * per:(r["row"] + 1) * per] = np.frombuffer(r["classes"], np.uint8)
    return out


def _postings(docs: DataFrame, classes: np.ndarray, n: int, percent: int) -> DataFrame:
    """token, sid, n, pos for the prefix of every set: any partner at the threshold shares one of these."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def prefixes(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, first = sets(piece.column("text"), n)
                size = np.diff(first)
                rows = np.repeat(np.arange(len(size)), size)
                rank = (shared.value[(h >> U64(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64) << U64(57)) | (mix(h) >> U64(7))
                order = np.argsort(rank)
                order = order[np.argsort(rows[order], kind="stable")]
                length = size - (percent * size + 99) // 100 + (size > 0)
                pos = np.arange(len(h)) - first[rows]
                keep = np.flatnonzero(pos < length[rows])
                at = rows[keep]
                yield pa.RecordBatch.from_pydict({"token": h[order[keep]].view(np.int64), "sid": set_ids(h, first)[at],
                                                  "place": (size[at] << 32) | pos[keep]})
    return docs.mapInArrow(prefixes, "token long, sid long, place long")


def _members(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """sid, items: the sets of the wanted documents (sid, doc_id), as sorted 40-bit keys."""
    def members(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, first = sets(piece.column("text"), n)
                raw = np.ascontiguousarray((h >> U64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
                yield pa.RecordBatch.from_pydict({"sid": piece.column("sid"), "items": pa.array([raw[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())})
    return docs.join(wanted.hint("merge"), "doc_id").select("sid", "text").mapInArrow(members, "sid long, items binary").dropDuplicates(["sid"])


def _keys(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8")[:, 0]


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs that pass the suffix filter."""
    def suffix(batches):
        for batch in batches:
            both = (batch.column("na").to_numpy() + batch.column("nb").to_numpy())
            odd = np.array([differing(x, y) for x, y in zip(batch.column("ra").to_pylist(), batch.column("rb").to_pylist())], np.int64)
            most = (both - odd) // 2
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(100 * most >= percent * (both - most)))
    # both sides grow with the input: the plan is that of a large table at every size
    side = lambda c: classes.select(F.col("sid").alias(c), F.col("n").alias("n" + c), F.col("parity").alias("r" + c)).hint("merge")
    return materialise(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(suffix, "a long, b long"), "likely")


def _verify(likely: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs that hold, by the sets themselves; only sets that a likely pair names are built and moved."""
    def exact(batches):
        for batch in batches:
            held, out = (None, None), []
            for raw_a, raw_b in zip(batch.column("ia"), batch.column("ib")):
                raw_a = raw_a.as_py()
                if held[0] != raw_a:
                    held = (raw_a, _keys(raw_a))
                a, b = held[1], _keys(raw_b.as_py())
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(out, pa.bool_()))
    named = likely.select(F.col("a").alias("sid")).union(likely.select("b")).distinct().join(classes, "sid").select("sid", F.col("class_id").alias("doc_id"))
    items = materialise(_members(docs, named, n), "items")
    side = lambda c: items.select(F.col("sid").alias(c), F.col("items").alias("i" + c)).hint("merge")
    return likely.join(side("a"), "a").join(side("b"), "b").mapInArrow(exact, "a long, b long")


def _fits(na, ra, nb, rb, percent: int):
    """Length and positional filter: sizes of two sets, and what each has from their first common n-gram on."""
    most = F.least(ra, rb)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (100 * most >= percent * (na + nb - most))


def join(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(membership, links): id, n_shingles, class_id and component_id of every document, and the verified
    links between class representatives that connect each component.

    Links hold when 100 * intersection >= percent * union."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = materialise(_profile(docs, n), "profile")
    shared = _count_classes(profile)
    info = profile.where("row is null").select("doc_id", "n", "sid", "parity")
    # a row without an id stands for no set and links none
    classes = materialise(info.where("n > 0 and doc_id is not null").groupBy("sid").agg(F.min(F.struct("doc_id", "n", "parity")).alias("m"))
                          .select("sid", F.col("m.doc_id").alias("class_id"), F.col("m.n").alias("n"), F.col("m.parity").alias("parity")), "classes")

    post = _postings(docs.where("doc_id is not null"), shared, n, percent)
    # n-grams that stand in one set only are of no use
    shared_tokens = materialise(post.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("token"), "tokens")
    live = materialise(post.join(shared_tokens.hint("merge"), "token").groupBy("token", "sid").agg(F.first("place").alias("place"))
                       .select("token", "sid", F.shiftright("place", 32).alias("n"), (F.shiftright("place", 32) - F.col("place").bitwiseAND(0xFFFFFFFF)).alias("rest")), "live")
    # the leader has the n-gram foremost: fewest n-grams before it
    leaders = live.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("rest")).alias("pos"), F.col("sid").alias("lead"), F.col("n").alias("lead_n"), F.col("rest").alias("lead_rest"))).alias("l")).select("token", "l.*")
    tried = materialise(live.join(leaders, "token").where("sid <> lead").where(_fits(F.col("n"), F.col("rest"), F.col("lead_n"), F.col("lead_rest"), percent))
                        .select(F.least("lead", "sid").alias("a"), F.greatest("lead", "sid").alias("b")).distinct(), "tried")
    links = materialise(_verify(_likely(tried, classes, percent), docs, classes, n, percent), "links")
    label = components(links)

    # only n-grams whose sets are not all connected can still bring news; components meet first, by the best that
    # any of their sets could reach, so that sets of one component never meet
    named = (live.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid")))
    open_tokens = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    left = materialise(named.join(open_tokens, "token"), "left")
    groups = left.groupBy("token", "component").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"))
    side = lambda c: groups.select("token", *[F.col(x).alias(f"{x}_{c}") for x in ("component", "least", "most", "rest")])
    reach = F.least("rest_a", "rest_b")
    cross = (side("a").join(side("b"), "token").where("component_a < component_b")
             .where((100 * reach >= percent * (F.col("least_a") + F.col("least_b") - reach)) & (100 * F.col("most_a") >= percent * F.col("least_b")) & (100 * F.col("most_b") >= percent * F.col("least_a")))
             .select("token", "component_a", "component_b", "least_b", "most_b", "rest_b"))
    member_of = lambda c: left.select("token", *[F.col(x).alias(f"{x}_{c}") for x in ("component", "sid", "n", "rest")])
    # of a component's sets only those come forward that can still reach the best of the other component
    own = F.least("ra", "rest_b")
    forward = (cross.join(member_of("a").withColumnRenamed("rest_a", "ra"), ["token", "component_a"])
               .where((100 * own >= percent * (F.col("n_a") + F.col("least_b") - own)) & (100 * F.col("n_a") >= percent * F.col("least_b")) & (100 * F.col("most_b") >= percent * F.col("n_a")))
               .select("token", "component_b", "sid_a", "n_a", F.col("ra").alias("rest_a")))
    rest = (forward.join(member_of("b"), ["token", "component_b"])
            .where(_fits(F.col("n_a"), F.col("rest_a"), F.col("n_b"), F.col("rest_b"), percent))
            .select(F.least("sid_a", "sid_b").alias("a"), F.greatest("sid_a", "sid_b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    links = materialise(links.union(_verify(_likely(rest, classes, percent), docs, classes, n, percent)), "links")

    to_class = lambda c: classes.select(F.col("sid").alias(c), F.col("class_id").alias("class_" + c))
    by_class = links.join(to_class("a"), "a").join(to_class("b"), "b").select("class_a", "class_b")
    label = components(by_class)
    named = F.when(F.col("doc_id").isNotNull(), F.col("class_id"))
    member = (info.drop("parity").join(classes.select("sid", "class_id"), "sid", "left").withColumn("class_id", named).join(label.withColumnRenamed("node", "class_id"), "class_id", "left")
              .select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"),
                      F.coalesce("component", "class_id", "doc_id").alias("component_id")))
    return member, by_class


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of `documents` under links of 85 % of distinct 4-word shingles."""
    member, _ = join(read(spark, sf_dir, "documents"), 4, 85)
    return member.select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM c JOIN n AS a ON a.doc_id = u JOIN n AS b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""
