"""Exact vector retrieval. Query sets are small stated relations; every query meets every vector once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norms: Column, digits: int = 6) -> Column:
    """Cosine in DOUBLE, rounded; norms is the product of both norms, and 0 gives 0."""
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.round(dot(a, b) / norms, digits))


def similarities(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, weight, and vectors' columns but the embedding, similarity. queries: query_id, weight, q; few rows."""
    # a vector's norm is computed once, not once for each query
    dims = vectors.where(F.col("embedding").isNotNull()).withColumn("__n", norm(F.col("embedding")))
    pairs = dims.crossJoin(queries.withColumn("__m", norm(F.col("q")))).where(F.size("embedding") == F.size("q"))
    return pairs.withColumn("similarity", cosine(F.col("embedding"), F.col("q"), F.col("__n") * F.col("__m"))).drop("embedding", "q", "__n", "__m")


def top_k(sims: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller vec_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def of_repository(ranked: DataFrame, column: str, repo: object) -> DataFrame:
    """Of the k best those of one repository, or of none; applied after the ranking, which stays as it was."""
    return ranked.where(F.col(column).isNull() | (F.col(column) == repo))


def top_p(ranked: DataFrame, p: float) -> DataFrame:
    """Rows in rank order until the next one would take the running similarity beyond p."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("cum", F.round(F.sum("similarity").over(w), 6)).where(F.col("cum") <= p)


def fused(best: DataFrame) -> DataFrame:
    """Adds ranked and score to vec_id, similarity, weight: best similarity and best weight, each on its own."""
    return best.withColumn("ranked", F.round(F.col("similarity") * F.col("weight"), 8)).withColumn("score", F.floor(F.col("similarity") * F.lit(60.0)).cast("int"))
