"""Centroid clustering of integer vectors with Drake's adaptive bounds.

A vector's row carries, beside its components, its cluster, an upper bound on the distance to that centroid, lower
bounds for each of the BOUNDS next centroids, and one lower bound for all remaining ones. When centroids move, bounds
move by as much (the remainder by the largest move). Where the upper bound is below all lower ones, the vector stays, and no
distance is computed. Elsewhere its distance is computed, then those to listed centroids whose bounds are not above it, and
only where the remainder is not above it either all of them (a rescan, which orders the list anew).

Components are integers, so that distances and means are exact, whatever the partitions; bounds are floats, kept apart
by a margin far above their rounding, and only a strict order certifies: ties are always settled by exact distances, the
smaller centroid number first. So the result is that of plain assignment.

Each round is a job over the table of the round before, written to the shared folder (an executor that is lost costs its tasks
only), and a sum for each cluster, merged before it is shuffled. To the driver come the centroids alone.
Rounds end early when no centroid moved, since later ones would change nothing.

Rows: vectors of another length than `width`, or with null or non-finite components, are left out, null vectors too. Repeated and null vec_ids
are vectors like any other; a null id hashes as an empty one, equal hashes are ordered by components. With fewer vectors than
centroids there are as many centroids as vectors; an empty table gives no rows. Other columns are ignored, whatever their
names. Scaled components of 2^26 or more raise an error, as squared distances would leave a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete_tables, scratch

#: Lower bounds kept one by one; the other centroids share one.
BOUNDS = 3
MARGIN = 1e-12
LARGEST = 1 << 26
STATE = "vec_id long, x array<long>, cluster int, upper double, near array<int>, lower array<double>, rest double, distance long, computed long"


def _matrix(values: pa.Array, n: int, width: int) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).reshape(n, width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.ravel(), kind))


def integers(df: DataFrame, width: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x: floor(scale * component) of the vectors of that width whose components are all finite."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), width), False))
            given = _matrix(pc.fill_null(b.column(1).flatten(), np.nan), b.num_rows, width)
            ok = np.isfinite(given).all(1)
            x = np.floor(scale * given[ok])
            if (np.abs(x) >= LARGEST).any():
                raise ValueError(f"components of {LARGEST / scale:g} or more: squared distances leave a long")
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), _lists(x.astype(np.int64), pa.int64())], names=["vec_id", "x"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "vec_id long, x array<long>")


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The components of the k vectors with the smallest hashes of salt and id, in that order."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in vectors.orderBy(key, "x").limit(k).select("x").collect()], np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to c, or to the same row of c."""
    return np.square(x - c).sum(1)


class Bounds:
    """A batch of vectors with what is known about their distances."""

    def __init__(self, x: np.ndarray, k: int):
        n, self.x, self.k, self.b = len(x), x, k, min(BOUNDS, k - 1)
        self.cluster, self.upper = np.zeros(n, np.int32), np.full(n, np.inf)
        self.near, self.lower = np.zeros((n, self.b), np.int32), np.zeros((n, self.b))
        self.rest, self.computed = np.zeros(n), np.zeros(n, np.int64)

    def move(self, drift: np.ndarray) -> None:
        """Centroid i moved by at most drift[i]."""
        self.upper = (self.upper + drift[self.cluster]) * (1 + MARGIN)
        self.lower = (self.lower - drift[self.near]) - MARGIN * (np.abs(self.lower) + drift.max())
        self.rest = (self.rest - drift.max()) - MARGIN * np.where(np.isinf(self.rest), 0, np.abs(self.rest) + drift.max())

    def uncertain(self, rows: np.ndarray) -> np.ndarray:
        """Of each row, whether its bounds leave its cluster open."""
        return self.upper[rows] >= np.minimum(self.rest[rows], self.lower[rows].min(1, initial=np.inf))

    def rescan(self, rows: np.ndarray, centroids: np.ndarray) -> None:
        d = np.stack([squares(self.x[rows], c) for c in centroids], 1)
        order = np.argsort(d, axis=1, kind="stable")  # equal distances: the smaller number first
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(float))
        self.cluster[rows], self.upper[rows] = order[:, 0], root[:, 0] * (1 + MARGIN)
        self.near[rows], self.lower[rows] = order[:, 1 : 1 + self.b], root[:, 1 : 1 + self.b] * (1 - MARGIN)
        self.rest[rows] = root[:, 1 + self.b] * (1 - MARGIN) if self.k > 1 + self.b else np.inf
        self.computed[rows] += self.k

    def assign(self, centroids: np.ndarray) -> None:
        rows = np.arange(len(self.x))
        rows = rows[self.uncertain(rows)]
        own = squares(self.x[rows], centroids[self.cluster[rows]])
        self.upper[rows] = np.sqrt(own.astype(float)) * (1 + MARGIN)
        self.computed[rows] += 1
        left = self.uncertain(rows)
        rows, own = rows[left], own[left]
        whole = self.rest[rows] <= self.upper[rows]
        self.rescan(rows[whole], centroids)
        rows, own = rows[~whole], own[~whole]
        for j in range(self.b):  # listed centroids that may be nearer, or as near with a smaller number
            some = np.flatnonzero(self.lower[rows, j] <= self.upper[rows])
            at, other = rows[some], self.near[rows[some], j]
            d = squares(self.x[at], centroids[other])
            self.computed[at] += 1
            self.lower[at, j] = np.sqrt(d.astype(float)) * (1 - MARGIN)
            won = (d < own[some]) | ((d == own[some]) & (other < self.cluster[at]))
            some, at, other, d = some[won], at[won], other[won], d[won]
            self.near[at, j], self.lower[at, j] = self.cluster[at], np.sqrt(own[some].astype(float)) * (1 - MARGIN)
            self.cluster[at], self.upper[at], own[some] = other, np.sqrt(d.astype(float)) * (1 + MARGIN), d


def _round(df: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, width: int) -> DataFrame:
    """The vectors' rows after one assignment; drift is None where they have no bounds yet."""
    k = len(centroids)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = b.num_rows
            if not n:
                continue
            column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: E731, B023
            s = Bounds(_matrix(column("x").flatten(), n, width), k)
            if drift is not None:
                for name in ("cluster", "upper", "rest", "computed"):
                    setattr(s, name, column(name).to_numpy(zero_copy_only=False).copy())
                s.near, s.lower = (_matrix(column(name).flatten(), n, s.b).copy() for name in ("near", "lower"))
                s.move(drift)
            s.assign(centroids)
            distance = squares(s.x, centroids[s.cluster])
            flat = [pa.array(v) for v in (s.cluster, s.upper)], [pa.array(v) for v in (s.rest, distance, s.computed)]
            lists = [_lists(s.near, pa.int32()), _lists(s.lower, pa.float64())]
            yield pa.RecordBatch.from_arrays([column("vec_id"), column("x"), *flat[0], *lists, *flat[1]], names=[f.split(" ")[0] for f in STATE.split(", ")])

    return df.mapInArrow(run, STATE)


def _means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's new place: the exact floor of the mean of its vectors; one without vectors stays."""
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(centroids.shape[1])))
    out = centroids.copy()
    for r in sums.collect():  # one row for each centroid
        out[r.cluster] = [s // r.n for s in r[2:]]
    return out


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: float = 1024, salt: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x, cluster, distance (squared), computed (distances computed for the vector in all), centroid: assignment after so many rounds."""
    spark = df.sparkSession
    with scratch(spark) as keep:
        rows, path = keep(integers(df, width, scale, id_col, vector_col), "drake-vectors")
        centroids, drift = seeds(rows, k, salt), None
        for at in range(rounds + 1 if len(centroids) else 0):
            rows, made = keep(_round(rows, centroids, drift, width), f"drake-{at}")
            delete_tables(spark, [path])
            path = made
            if at == rounds:
                break
            moved = _means(rows, centroids)
            if (moved == centroids).all():
                break
            drift = np.sqrt(squares(moved, centroids).astype(float)) * (1 + MARGIN)
            centroids = moved
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, x array<long>, cluster int, distance long, computed long, centroid array<long>")
    places = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster int, centroid array<long>")
    return rows.join(F.broadcast(places), "cluster").select("vec_id", "x", "cluster", "distance", "computed", "centroid")  # k rows


def digests(df: DataFrame, **kind) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found = cluster(df, **kind)
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"), F.first("centroid").alias("place"))
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))))  # k rows
    sums = sums.select("cluster", "cluster_inertia", "inertia", F.sha2(F.array_join("place", ","), 256).alias("centroid_sha256"))
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """DuckDB SQL: every vector against every centroid in each round."""
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""v AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE len(embedding) = {width} AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))))""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS k, x FROM v QUALIFY k < {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
            SELECT rid, vec_id, v.x, k, c.x AS place, {square} AS d FROM v, c{i} c
            QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
                SELECT k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
                    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
                        SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM a{i}, range(1, {width + 1}) r(i) GROUP BY k, i) GROUP BY k) m USING (k))""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(place, ',')) AS centroid_sha256
        FROM a{rounds}"""
