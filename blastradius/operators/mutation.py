"""Changes to stored relations as rewrites: upserts, deletes, flags, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the first row in the given order (an upsert where the last write wins)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert_coalesce(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where there are any, old ones elsewhere."""
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(pick(key), *map(pick, columns))


def delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(F.col(key)), key, "left_anti")


def exclusive_flag(df: DataFrame, group: str, key: str, chosen: DataFrame) -> DataFrame:
    """is_primary for exactly the chosen(group, key) row of each group that has one."""
    pick = chosen.select(F.col(group).alias("__g"), F.col(key).alias("__k"))
    return df.join(pick, F.col(group) == F.col("__g"), "left").withColumn("is_primary", F.coalesce(F.col(key) == F.col("__k"), F.lit(False))).drop("__g", "__k")


def allocate(new: DataFrame, order: str, last: DataFrame, prefix: str = "test_", runs: int = 1000) -> DataFrame:
    """Ids after the numerically largest one, in the order of a numeric column without repeats.

    Rows are numbered within runs between quantiles, and after the sizes of the runs before; so no task sees all rows.
    """
    cuts = F.array(*[F.lit(i / runs) for i in range(1, runs)])
    found = sorted(set(new.agg(F.percentile_approx(order, cuts, 4 * runs).alias("c")).first()["c"] or []))
    held = F.array_remove(F.split(F.lit(",".join(map(str, found))), ","), "").cast("array<bigint>")
    rows = new.withColumn("__run", F.size(F.filter(held, lambda c: c < F.col(order))))
    sizes = rows.groupBy(F.col("__run").alias("__r")).agg(F.count("*").alias("__m"))  # at most `runs` rows
    upto = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__r", F.coalesce(F.sum("__m").over(upto), F.lit(0)).alias("__base")).crossJoin(last)  # one row
    inside = F.row_number().over(Window.partitionBy("__run").orderBy(order))
    out = rows.withColumn("__n", inside).join(sizes, F.col("__run") == F.col("__r"))
    number = F.coalesce("last_id", F.lit(0)).cast("long") + F.col("__base") + F.col("__n")
    return out.withColumn("new_id", F.format_string(prefix + "%04d", number)).drop("__run", "__n", "__r", "__m", "__base", "last_id")
