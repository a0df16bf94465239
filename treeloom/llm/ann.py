"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are centred on the mean, rotated by a seeded random orthogonal matrix
and kept as one bit a dimension, with their distance r from the mean, the
correction f = <code, direction> (the code as a unit vector) and their inner
product with the mean. For a query q the inner product with the mean-centred
direction is estimated by <code, q'> / f; its error is at most
``epsilon`` * |q'| * sqrt((1 - f^2) / f^2) / sqrt(d - 1) with high probability.
Vectors whose estimate plus error reaches the k-th best exact value so far are
reranked by the exact inner product in double precision.

All queries meet all vectors, in blocks: a block of queries is sent to each
block of codes, and the best of each pair of blocks are merged. So no task holds
more than two blocks, whatever the number of queries.

Nulls, ties, edges: vectors that are null, zero, of another length than most, or
that hold null or non-finite components take no part. Equal scores are ordered
by id. A query is no candidate of its own: rows with its id are left out. Rows
that repeat an id are separate candidates; as queries they count once (the
first by their components). Fewer than k candidates are all returned. Empty
tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import prepare, stored

VECTOR_BLOCK = 4096
QUERY_BLOCK = 8192  # vectors are copied once for each block of queries
QUERY_ROWS = 256  # queries whose estimates are held at a time
EPSILON = 3.0


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits, and for each vector its distance from the mean, correction and inner product with the mean."""
    gap = x - mean
    far = np.linalg.norm(gap, axis=1)
    turned = (gap / np.where(far > 0, far, 1)[:, None]) @ turn
    bits = turned >= 0
    fit = np.where(bits, turned, -turned).sum(1) / np.sqrt(x.shape[1])
    return np.packbits(bits, axis=1), np.column_stack((far, np.where(far > 0, fit, 1.0), x @ mean))


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray, scalars: np.ndarray, mean: np.ndarray, turn: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids and exact scores of up to ``k`` best of ``vectors`` for each query."""
    dims = vectors.shape[1]
    far, fit, on_mean = scalars.T
    # A code's direction by its length over its correction; what all vectors share for a query is left out until the end.
    scaled = ((np.unpackbits(codes, axis=1, count=dims).astype(np.float32) * 2 - 1) * (far / fit / np.sqrt(dims)).astype(np.float32)[:, None]).T
    wide = (epsilon * far * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(dims - 1, 1))).astype(np.float32)
    turned = ((queries - mean) @ turn).astype(np.float32)
    reach, shared = np.linalg.norm(turned, axis=1), queries @ mean - mean @ mean
    order = np.argsort(ids, kind="stable")
    first, last = (np.searchsorted(ids[order], query_ids, side) for side in ("left", "right"))
    at_query, at_id, at_score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for lo in range(0, len(queries), QUERY_ROWS):
        estimate = turned[lo : lo + QUERY_ROWS] @ scaled
        estimate += on_mean.astype(np.float32)
        for i in range(lo, min(lo + QUERY_ROWS, len(queries))):
            row, q = estimate[i - lo], queries[i]
            row[order[first[i] : last[i]]] = -np.inf
            n = len(ids) - (last[i] - first[i])
            if n <= 0:
                continue
            if n > k:
                best = np.argpartition(row, len(ids) - k)[-k:]
                least = (vectors[best] * q).sum(1).min() - shared[i]
                slack = 1e-5 * (1 + abs(least) + np.abs(row[best]).max())
                allowed = np.flatnonzero(row + reach[i] * wide >= least - slack)
            else:
                allowed = np.flatnonzero(row > -np.inf)
            exact = (vectors[allowed] * q).sum(1)
            best = np.lexsort((ids[allowed], -exact))[:k]
            at_query.append(np.full(len(best), i))
            at_id.append(ids[allowed][best])
            at_score.append(exact[best])
    return np.concatenate(at_query), np.concatenate(at_id), np.concatenate(at_score)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Key and vector (single precision where the column is, else doubles) of the rows that take part."""
    single = vectors.schema[vector].dataType.elementType.typeName() == "float"
    x = F.transform(vector, lambda v: v.cast("float" if single else "double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(finite & F.exists("x", lambda v: v != 0))
    lengths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("x") == (lengths[0]["n"] if lengths else 0))


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of at most ``size`` rows: their ids and packed components."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, held = [], [], 0

        def out(ids, xs):
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(xs).tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_x"])

        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                if held + part.num_rows > size:
                    yield out(ids, xs)
                    ids, xs, held = [], [], 0
                ids.append(part.column(0).to_numpy())
                xs.append(part.column(1).flatten().to_numpy())
                held += part.num_rows
        if held:
            yield out(ids, xs)

    return rows.select("id", "x").mapInArrow(make, f"{name}_ids binary, {name}_x binary")


def block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of ``left`` (a block) beside each row of ``right``, as an equi-join of replicated blocks.

    Left blocks fall into as many groups as there are, and so do right ones; a
    block is copied once for each group of the other side, and a task reads the
    few pairs of its groups.
    """
    groups, others = max(1, left.count()), max(1, right.count())
    number = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("l_group", number(groups)).withColumn("r_group", each(others))
    b = right.withColumn("r_group", number(others)).withColumn("l_group", each(groups))
    return a.join(b.hint("shuffle_hash"), ["l_group", "r_group"])


def nearest(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", epsilon: float = EPSILON, seed: int = 11) -> DataFrame:
    """The ``k`` rows of largest inner product for each row that ``is_query`` (of the key as ``id``) names: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    spark = prepare(vectors.sparkSession)
    rows = stored(usable(vectors, key, vector), "vectors")
    dims = rows.select(F.size("x")).head()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = dims[0]
    mean = np.array(rows.agg(*[F.avg(F.col("x")[i]) for i in range(dims)]).head(), float)
    turn = rotation(dims, seed)
    kind = np.dtype(np.float32 if rows.schema["x"].dataType.elementType.typeName() == "float" else np.float64)
    first = rows.where(is_query).groupBy("id").agg(F.min("x").alias("x"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[i].as_py(), kind).reshape(-1, dims).astype(float)
                codes, scalars = encode(x, mean, turn)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([codes.tobytes()], pa.binary()), pa.array([scalars.tobytes()], pa.binary())], names=["v_ids", "v_x", "codes", "scalars"])

    held = stored(_blocks(rows, VECTOR_BLOCK, "v").mapInArrow(index, "v_ids binary, v_x binary, codes binary, scalars binary"), "codes")
    asked = stored(_blocks(first.coalesce(max(1, -(-first.count() // QUERY_BLOCK))), QUERY_BLOCK, "q"), "queries")
    pairs = block_pairs(held, asked)

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            got = batch.to_pydict()
            for i in range(batch.num_rows):
                q_ids, ids = np.frombuffer(got["q_ids"][i], np.int64), np.frombuffer(got["v_ids"][i], np.int64)
                queries, x = (np.frombuffer(got[name][i], kind).reshape(-1, dims).astype(float) for name in ("q_x", "v_x"))
                codes, scalars = np.frombuffer(got["codes"][i], np.uint8).reshape(len(ids), -1), np.frombuffer(got["scalars"][i]).reshape(-1, 3)
                at, found, score = search_block(queries, q_ids, x, ids, codes, scalars, mean, turn, k, epsilon)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"query_id": q_ids[at], "vec_id": found, "score": score}), preserve_index=False)

    best = pairs.select("q_ids", "q_x", "v_ids", "v_x", "codes", "scalars").mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark, sf_dir: str, k: int = 20) -> DataFrame:
    """The 20 nearest of all ``embeddings`` for those whose id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0, k)


OP1_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x) AS score FROM usable q JOIN usable v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
