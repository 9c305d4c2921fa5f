"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are kept in blocks.  A vector, less the mean of its block and scaled to length one, is turned by a
random rotation and kept as the signs of its components, with two scalars: the length that was divided out
and the inner product of the signs with what they stand for.  From these the inner product with a query is
estimated without bias, and its error is bounded: a block's candidates are all vectors whose upper bound
reaches the k-th best lower bound.  Only these are compared exactly, on the original vectors.

Queries are taken in blocks too, and every query block meets every row block in a task of its own, so
that a task holds two blocks whatever the number of rows.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components are neither
queries nor candidates; only vectors of one dimension are compared; equal scores go to the smaller id;
rows that repeat an id are each a candidate, but never of a query with that id; fewer candidates than k
are all returned; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dunlin.llm.common import materialise, read, unique_id

#: Vectors in a row block and in a query block; width of the error bound in standard deviations.
ROW_BLOCK, QUERY_BLOCK, WIDTH = 4096, 1024, 4.0
BLOCK = "block long, dim int, ids binary, vectors binary, codes binary, scalars binary, centre binary"


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray):
    """Codes (packed signs), scalars (length, inner product of signs and direction) and centre of unit vectors."""
    centre = unit.mean(axis=0)
    rest = unit - centre
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.where(length > 0, length, 1)[:, None]) @ turn.T
    signs = turned >= 0
    inner = np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])
    return np.packbits(signs, axis=1), np.stack([length, np.where(length > 0, inner, 1)], axis=1), centre


def estimate(queries: np.ndarray, codes: np.ndarray, scalars: np.ndarray, centre: np.ndarray, turn: np.ndarray, width: float = WIDTH):
    """Estimated inner products (queries x rows) and the bound of their errors (rows)."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    length, inner = scalars[:, 0], scalars[:, 1]
    raw = (queries @ turn.T).astype(np.float32) @ signs.T / np.float32(np.sqrt(dim))
    bound = length * np.sqrt(np.maximum(1 - inner ** 2, 0)) / inner * width / np.sqrt(max(dim - 1, 1)) + 1e-5
    return raw * (length / inner).astype(np.float32) + (queries @ centre)[:, None].astype(np.float32), bound


def _usable(array: pa.Array, ids: pa.Array):
    """Ids and vectors (by dimension) that take part."""
    by: dict[int, tuple[list, list]] = {}
    for key, v in zip(ids.to_pylist(), array):
        if key is None or not v.is_valid or v.values.null_count or not len(v.values):
            continue
        x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
        if np.isfinite(x).all() and x.any():
            k, rows = by.setdefault(len(x), ([], []))
            k.append(key)
            rows.append(x)
    return by


def blocks(vectors: DataFrame, id_col: str, vector_col: str, size: int, coded: bool) -> DataFrame:
    def build(batches):
        held: dict[int, tuple[list, list]] = {}

        def out(dim, ids, rows):
            x = np.array(rows)
            row = {"block": [unique_id()], "dim": pa.array([dim], pa.int32()), "ids": [np.array(ids, "<i8").tobytes()], "vectors": [x.astype("<f8").tobytes()]}
            code = [b"", b"", b""]
            if coded:
                code = [np.ascontiguousarray(c).tobytes() for c in encode(x / np.linalg.norm(x, axis=1)[:, None], rotation(dim))]
            return pa.RecordBatch.from_pydict({**row, **{n: pa.array([c], pa.binary()) for n, c in zip(("codes", "scalars", "centre"), code)}})
        for batch in batches:
            for dim, (ids, rows) in _usable(batch.column("v"), batch.column("id")).items():
                k, v = held.setdefault(dim, ([], []))
                k.extend(ids)
                v.extend(rows)
                while len(k) >= size:
                    yield out(dim, k[:size], v[:size])
                    del k[:size], v[:size]
        for dim, (k, v) in held.items():
            if k:
                yield out(dim, k, v)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(build, BLOCK)


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision, components summed in their order."""
    dot, own, other = (np.cumsum(x, axis=-1)[..., -1] for x in (rows * query, query * query, rows * rows))
    return np.clip(dot / np.sqrt(own * other), -1, 1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every query by cosine."""
    rows = materialise(blocks(vectors, id_col, vector_col, ROW_BLOCK, True), "row-blocks")
    asked = materialise(blocks(queries, id_col, vector_col, QUERY_BLOCK, False).select(F.col("block").alias("query_block"), "dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")), "query-blocks")
    pairs = materialise(rows.select("dim", "block").join(asked.select("dim", "query_block"), "dim").select("block", "query_block"), "block-pairs")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            row, ask = left.to_pylist()[0], right.to_pylist()[0]
            dim = row["dim"]
            ids, own = np.frombuffer(row["ids"], "<i8"), np.frombuffer(ask["query_ids"], "<i8")
            x, q = np.frombuffer(row["vectors"], "<f8").reshape(-1, dim), np.frombuffer(ask["query_vectors"], "<f8").reshape(-1, dim)
            codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
            guess, bound = estimate(q / np.linalg.norm(q, axis=1)[:, None], codes, np.frombuffer(row["scalars"], "<f8").reshape(-1, 2), np.frombuffer(row["centre"], "<f8"), rotation(dim))
            for i, key in enumerate(own):
                other = np.flatnonzero(ids != key)
                if len(other) > k:
                    low = guess[i, other] - bound[other]
                    least = np.partition(low, -k)[-k]
                    other = other[guess[i, other] + bound[other] >= least]
                score = exact_scores(q[i], x[other])
                best = np.lexsort((ids[other], -score))[:k]
                out["query_id"] += [int(key)] * len(best)
                out["vec_id"] += ids[other[best]].tolist()
                out["score"] += score[best].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})
    left = pairs.join(rows, "block")
    right = (pairs.select(F.col("block").alias("to_block"), F.col("query_block").alias("from_block"))
             .join(asked.drop("dim").withColumnRenamed("query_block", "from_block"), "from_block"))
    found = (left.groupBy("block", "query_block").cogroup(right.groupBy("to_block", "from_block"))
             .applyInArrow(meet, "query_id long, vec_id long, score double"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector of `embeddings`, against all."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 50 = 0"))


OP3_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
