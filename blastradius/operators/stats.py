"""Index statistics: counts, coverage, votes, groupings. Every ordering has a unique tie-break."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def count_tables(frames: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows."""
    return union_all([df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in frames.items()])


def top_by_count(df: DataFrame, keys: list[str], k: int, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(F.desc(name), *keys).limit(k)


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, 0 where there is no whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * part / whole, digits))


def coverage(entities: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """total, covered, coverage_pct of distinct keys."""
    total = entities.agg(F.countDistinct(key).alias("total"))
    have = covered.agg(F.countDistinct(key).alias("covered"))
    return total.crossJoin(have).select("total", "covered", share(F.col("covered"), F.col("total")).alias("coverage_pct"))  # one row each


def counted(left: DataFrame, right: DataFrame, key: str, name: str = "n") -> DataFrame:
    """left with the number of its rows in right, 0 where it has none; right is summed up before the join."""
    n = right.groupBy(key).agg(F.count("*").alias(name))
    return left.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def vote(df: DataFrame, key: str, least: float = 0.05) -> DataFrame:
    """key, n, confidence (share of all, 3 digits), active."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    ratio = F.round(F.col("n").cast("double") / F.col("total"), 3)
    return n.crossJoin(F.broadcast(total)).select(key, "n", ratio.alias("confidence"), (ratio >= least).alias("active"))  # one row


def majority(df: DataFrame, group: str, value: str) -> DataFrame:
    """The commonest value of each group, ties to the smallest."""
    n = df.groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return n.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def linkage(counts: DataFrame, n: str = "n") -> DataFrame:
    return counts.withColumn("linkage", F.when(F.col(n) >= 10, "FULLY_CROSS_DEPENDENT").when(F.col(n) <= 2, "FULLY_STANDALONE").otherwise("MODERATE_LINKAGE"))


def suite(path: Column) -> Column:
    """Of the first segment that is test, tests or a known suite: the segment after it (root if that is empty), or the
    known suite's name; other if there is none."""
    p = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    hit = r"(?:^|/)(?:(tests?)/([^/]*)|(unit|integration|e2e|functional)(?:/|$))"
    found, after, known = (F.regexp_extract(p, hit, i) for i in (1, 2, 3))
    return F.when(known != "", known).when(found == "", "other").when(after == "", "root").otherwise(after)


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("test_id").alias("keeper")).where("n > 1")


def inverted(df: DataFrame, symbol: str, entity: str, width: int = 4096) -> DataFrame:
    """symbol, block, n, entities (sorted distinct, joined): postings in blocks of ids, of at most `width` each, so that a
    symbol that every test refers to is many rows."""
    pairs = df.select(symbol, F.expr(f"{entity} div {width}").alias("block"), entity).distinct()
    return pairs.groupBy(symbol, "block").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(entity)), ",").alias("entities"))
