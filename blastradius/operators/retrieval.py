"""Exact retrieval for many queries: blocks of queries against blocks of vectors, one matrix product for each pair of blocks.

Vectors and queries are packed into rows of up to BLOCK of equal length; each pair of such rows gives, by one
product, what is asked of it: the k best of each query, all pairs above a similarity, or the best of each vector. What a pair
gives is bounded before anything is shuffled, and merged after. Nothing is broadcast by hand, no pair of single
vectors is ever a row of a plan.

Vectors that are null, or hold nulls, are left out. Vectors only meet queries of their own length. A vector of
zeros has similarity 0 to all. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 1024
#: Bytes of block rows that reach a worker at once.
BATCH_BYTES = 16 << 20
DIGITS = 6


def packed(rows: DataFrame, vector: str, prefix: str) -> DataFrame:
    """Rows of up to BLOCK vectors: prefix_dims, prefix_flat (their numbers one after the other), and each other column as an array."""
    rest = [c for c in rows.columns if c != vector]
    kinds = [to_arrow_type(rows.schema[c].dataType) for c in rest]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"{prefix}_dims", f"{prefix}_flat", *(f"{prefix}_{c}" for c in rest)]
        for b in it:
            v = b.column(0)
            for dims in pc.unique(pc.list_value_length(v)).to_pylist():
                if not dims:
                    continue
                some = b.filter(pc.fill_null(pc.equal(pc.list_value_length(v), dims), False))
                flat = some.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
                whole = np.isfinite(flat).all(1)
                flat, some = flat[whole], some.filter(pa.array(whole))
                for lo in range(0, len(flat), BLOCK):
                    part = some.slice(lo, BLOCK)
                    lists = [pa.array([part.column(i).to_pylist()], pa.list_(k)) for i, k in enumerate(kinds, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([flat[lo : lo + BLOCK].tobytes()], pa.binary()), *lists], names=names)

    schema = ", ".join([f"{prefix}_dims int", f"{prefix}_flat binary", *(f"{prefix}_{c} array<{rows.schema[c].dataType.simpleString()}>" for c in rest)])
    return rows.select(F.col(vector).cast("array<double>"), *rest).mapInArrow(run, schema)


#: (similarities of queries by vectors, ids of the vectors, weights of the queries) -> the kept places, by query and by vector.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _with_norms(flat: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.frombuffer(flat).reshape(-1, dims)
    return m, np.sqrt(np.einsum("ij,ij->i", m, m))


def _products(vectors: DataFrame, queries: DataFrame, kernel: Kernel) -> DataFrame:
    """query_id, weight, vec_id, the vectors' other columns, similarity: what the kernel keeps of each pair of blocks."""
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    carry = [c for c in vectors.columns if c not in ("vec_id", "embedding")]
    v, q = packed(vectors, "embedding", "v"), packed(queries, "q", "q")
    pairs = v.crossJoin(q)  # of blocks; a join on the length would be one task's
    taken = ["q_query_id", "q_weight", "v_vec_id", *(f"v_{c}" for c in carry)]
    kinds = [to_arrow_type(pairs.schema[c].dataType.elementType) for c in taken]
    names = [*(c[2:] for c in taken), "similarity"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                if row["v_dims"] != row["q_dims"]:
                    continue
                (x, nx), (y, ny) = _with_norms(row["v_flat"], row["v_dims"]), _with_norms(row["q_flat"], row["v_dims"])
                norms = ny[:, None] * nx[None, :]
                sims = np.divide(y @ x.T, norms, out=np.zeros(norms.shape), where=norms != 0)
                sims = np.round(sims, DIGITS)
                at_q, at_v = kernel(sims, np.array(row["v_vec_id"], np.int64), np.array(row["q_weight"], float))
                cols = [pa.array(row[c], k).take(pa.array(at_q if c[0] == "q" else at_v)) for c, k in zip(taken, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sims[at_q, at_v])], names=names)

    schema = ", ".join([*(f"{c[2:]} {pairs.schema[c].dataType.elementType.simpleString()}" for c in taken), "similarity double"])
    return pairs.select("v_dims", "v_flat", "q_dims", "q_flat", *taken).mapInArrow(run, schema)


def best_of_block(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each row, ties to the smaller id."""
    n, m = sims.shape
    if m > k:  # everything above the k-th value, and of its equals those with the smallest ids
        order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]
    else:
        order = np.broadcast_to(np.arange(m), (n, m))
    return np.repeat(np.arange(n), order.shape[1]), order.ravel()


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, weight, vec_id, the vectors' other columns, similarity, rank: the k best of each query.

    vectors: vec_id, embedding, ...; queries: query_id, weight, q."""
    found = _products(vectors, queries, lambda sims, ids, _: best_of_block(sims, ids, k))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def above(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """All pairs of at least that similarity."""
    return _products(vectors, queries, lambda sims, ids, _: np.nonzero(sims >= least))


def best_by_vector(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """vec_id, similarity, weight: over all queries the best similarity and the best weight, each on its own."""
    best = _products(vectors.select("vec_id", "embedding"), queries, lambda sims, ids, _: (sims.argmax(0), np.arange(sims.shape[1]))).groupBy("vec_id").agg(F.max("similarity").alias("similarity"))
    # every vector meets every query of its length, so that the best weight is the same for all
    weights = queries.agg(F.max("weight").alias("weight"))
    return best.crossJoin(weights)  # one row


def best_weighted(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """vec_id, ranked, similarity: the similarity of the best weighted hit (ties: the larger similarity)."""
    def kernel(sims: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ranked = np.round(sims * weights[:, None], 8)
        first = np.where(ranked == ranked.max(0), sims, -np.inf).argmax(0)
        return first, np.arange(sims.shape[1])

    ranked = F.round(F.col("similarity") * F.col("weight"), 8)
    found = _products(vectors.select("vec_id", "embedding"), queries, kernel)
    best = found.groupBy("vec_id").agg(F.max(F.struct(ranked.alias("ranked"), F.col("similarity").alias("similarity"))).alias("b"))
    return best.select("vec_id", "b.ranked", "b.similarity")
