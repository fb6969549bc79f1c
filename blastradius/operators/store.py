"""What changes stored relations, beside the upserts: inserts that ignore known keys, appends, partial updates; and cuts of
long lineages where the cluster names a folder for that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mutation import latest


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old, and of each key that it doesn't have the first row of new. Without a unique key use append()."""
    first = latest(new, keys, [F.asc(order)]).select(*old.columns)
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def partial_update(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """df with those values that changes gives; a null says nothing. changes has one row for a key at most."""
    sets = [c for c in changes.columns if c != key]
    given = changes.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in sets])
    joined = df.join(given, F.col(key) == F.col("__k"), "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in sets else F.col(c) for c in df.columns])


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint, where spark.checkpoint.dir names a shared folder; else as it is."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        return df
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint()
