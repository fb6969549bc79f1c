"""Sharding along a Hilbert curve. DataFrame functions only.

Three metadata dimensions (source, language, size) are quantised to 2^BITS levels of about equal numbers of rows over
the whole table: size by quantiles, source and language by where a value's rows begin in the order of all whole values
(code points; null first). The cell's index on the Hilbert curve gives the order, and the order is cut into runs: shards hold neighbouring
cells, so a reader that filters on several dimensions can skip most of them. The law is `bytes`: shards are near
equal in bytes.

Equal texts are a group: they take their metadata from the group's first row (by doc_id, source, language), stand
side by side in the order, and stay in one shard - unless the group is larger than 1/PIECES of a shard, or has more than
SLICE_ROWS rows. Such a group is dealt into parts of about that size, which lie side by side, so that one large
group of copies bends neither the shards' sizes nor any task: a document by hash of its doc_id, rows that are equal in doc_id and text
(null ids are equal) in equal numbers to one part after the other, from the one of their hash on.

Null text has no bytes (size 1, CRC 0). Null doc_id, source or language is a value of its own, first in order. Rows
that are equal in doc_id and text are counted, placed by number and written out again: they get consecutive slots, or stand in
neighbouring parts. Other columns are ignored. Empty input: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

BITS = 4
PIECES = 64
#: Sums are taken over runs of the order: a cell's groups of about so many rows, were all rows in one cell.
SLICE_ROWS = 10_000


def hilbert_indices(dims: int, bits: int) -> list[int]:
    """The index on the curve of every cell, cells in row-major order (first coordinate slowest)."""
    out = []
    for cell in range(1 << dims * bits):
        x = [cell >> (dims - 1 - d) * bits & (1 << bits) - 1 for d in range(dims)]
        for level in range(bits - 1, 0, -1):  # undo, from the coarsest level, each subcube's reflection or swap
            one, low = 1 << level, (1 << level) - 1
            for d in range(dims):
                if x[d] & one:
                    x[0] ^= low
                else:
                    swap = (x[0] ^ x[d]) & low
                    x[0] ^= swap
                    x[d] ^= swap
        for d in range(1, dims):  # Gray code over the dimensions
            x[d] ^= x[d - 1]
        turn = 0
        for level in range(bits - 1, 0, -1):
            if x[-1] >> level & 1:
                turn ^= (1 << level) - 1
        x = [v ^ turn for v in x]
        index = 0
        for level in range(bits - 1, -1, -1):
            for v in x:
                index = index << 1 | v >> level & 1
        out.append(index)
    return out


def rank_levels(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """__v, __level: each value of a column and the share of all rows that come before it, in 2^bits steps.

    Values are summed up before they are ordered; running sums are taken within ranges of values, and over the ranges.
    """
    per = rows.groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    dealt = stash(per.repartitionByRange(F.col("__v").asc_nulls_first()).withColumn("__range", F.spark_partition_id()), f"shard-{column}")
    ranges = dealt.groupBy("__range").agg(F.sum("__n").alias("__all"))
    over = Window.orderBy("__range")  # a row for each range, of which there are as many as shuffle partitions
    ranges = ranges.select(F.col("__range").alias("__r"), (F.sum("__all").over(over) - F.col("__all")).alias("__base"), F.sum("__all").over(Window.partitionBy()).alias("__total"))
    inside = Window.partitionBy("__range").orderBy(F.col("__v").asc_nulls_first())
    upto = F.sum("__n").over(inside) - F.col("__n")
    found = dealt.withColumn("__upto", upto).join(ranges, F.col("__range") == F.col("__r"))
    return found.select("__v", F.expr(f"cast((__base + __upto) * {2**bits} div __total as int)").alias("__level"))


def levels(df: DataFrame, columns: list[str], bits: int) -> dict[str, list[float]]:
    """For each column the bounds between its levels: at most 2^bits - 1 numbers."""
    at = F.array(*[F.lit(i / 2**bits) for i in range(1, 2**bits)])
    row = df.agg(*[F.percentile_approx(c, at, 2000).alias(c) for c in columns]).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def level(c: Column, bounds: list[float]) -> Column:
    out = F.lit(0)
    for b in bounds:
        out = out + (c > b).cast("int")
    return out


def rows_of(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    group = F.when(text.isNotNull(), F.xxhash64("text"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(group, F.lit(0)).alias("__g"), F.col("source").cast("string").alias("__source"), F.col("lang").cast("string").alias("__lang"),
    )


def shard(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert: where every document lies."""
    rows = stash(rows_of(docs), "shard-rows")  # texts are read once
    key = ["__g", "text_crc32", "size"]
    value = lambda c: F.struct(F.col(c).isNotNull().alias("some"), F.col(c).alias("v"))
    groups = rows.groupBy(*key).agg(F.count("*").alias("__n"), F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), value("__source").alias("s"), value("__lang").alias("l"))).alias("__first"))
    groups = groups.select(*key, "__n", F.col("__first.s.v").alias("__s"), F.col("__first.l.v").alias("__l"))
    got = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    total, slices = got["t"], 1 << max(0, (got["n"] // SLICE_ROWS).bit_length())
    piece = max(1.0, total / shards / PIECES)
    bounds = levels(rows, ["size"], bits)
    for name, column in (("__s", "__source"), ("__l", "__lang")):
        found = rank_levels(rows, column, bits).withColumnsRenamed({"__v": f"{name}v", "__level": f"{name}level"})
        groups = groups.join(found, F.col(name).eqNullSafe(F.col(f"{name}v")))
    cell = (F.col("__slevel") * 2**bits + F.col("__llevel")) * 2**bits + level(F.col("size"), bounds["size"])
    curve = F.split(F.lit(",".join(map(str, hilbert_indices(3, bits)))), ",").cast("array<int>")  # 2^(3 bits) numbers
    parts = F.greatest(F.lit(1), F.ceil(F.col("__n") * F.col("size") / piece), F.ceil(F.col("__n") / SLICE_ROWS)).cast("int")
    groups = groups.select(*key, F.element_at(curve, cell + 1).alias("hilbert"), parts.alias("__parts"))
    groups = stash(groups, "shard-groups")  # so that the join below deals both sides itself, and can split a large group's rows
    # rows of one id and text, counted before the shuffle, in as many lots as their group has parts
    same = rows.groupBy("doc_id", *key).agg(F.count("*").alias("__all")).join(groups, key)
    lots = same.withColumn("__lot", F.explode(F.expr("sequence(0L, least(__parts, __all) - 1)")))
    held = F.expr("__all div __parts + if(__lot < __all % __parts, 1, 0)")
    part = F.pmod(F.pmod(F.xxhash64("doc_id"), F.col("__parts")) + F.col("__lot"), F.col("__parts")).cast("int")
    placed = stash(lots.select("doc_id", *key, "hilbert", part.alias("__part"), held.alias("__held")), "shard-placed")
    unit = ["hilbert", "__g", "text_crc32", "size", "__part"]
    units = placed.groupBy(*unit).agg(F.sum("__held").alias("__n"))
    units = units.withColumn("__slice", F.pmod(F.shiftright("__g", 32), F.lit(slices)).cast("int"))
    ordered = ["__slice", "__g", "text_crc32", "size", "__part"]
    totals = units.groupBy("hilbert", "__slice").agg(F.sum(F.col("__n") * F.col("size")).alias("__b"))
    upto = Window.partitionBy("hilbert").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = totals.groupBy("hilbert").agg(F.sum("__b").alias("__cell"))
    # one row for each cell: at most 2^(3 bits), whatever the input
    cells = cells.select("hilbert", F.coalesce(F.sum("__cell").over(Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__from"))
    totals = totals.select("hilbert", "__slice", F.coalesce(F.sum("__b").over(upto), F.lit(0)).alias("__base"))
    totals = totals.join(cells, "hilbert").select("hilbert", "__slice", (F.col("__from") + F.col("__base")).alias("__base"))
    inside = Window.partitionBy("hilbert", "__slice").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("__in", F.coalesce(F.sum(F.col("__n") * F.col("size")).over(inside), F.lit(0)))
    units = units.join(totals, ["hilbert", "__slice"])
    middle = F.col("__base") + F.col("__in") + F.col("__n") * F.col("size") / 2
    units = units.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / max(1, total))).cast("int"))
    units = stash(units, "shard-units")
    # slots: rows before a unit in its shard, again over slices and within them
    counts = units.groupBy("shard", "hilbert", "__slice").agg(F.sum("__n").alias("__r"))
    upto = Window.partitionBy("shard").orderBy("hilbert", "__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "hilbert", "__slice", F.coalesce(F.sum("__r").over(upto), F.lit(0)).alias("__rows"))
    inside = Window.partitionBy("shard", "hilbert", "__slice").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(counts, ["shard", "hilbert", "__slice"])
    units = units.select(*unit, "shard", (F.col("__rows") + F.col("__before")).alias("__slot"))
    own = Window.partitionBy(*unit).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("__k", F.coalesce(F.sum("__held").over(own), F.lit(0))).join(units, unit)
    slot = F.explode(F.expr("sequence(cast(__slot + __k as bigint), cast(__slot + __k + __held - 1 as bigint))")).alias("slot")
    out = out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, "hilbert")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """One folder for each shard under path, its rows in curve order. doc_id must be unique and not null."""
    placed = shard(docs, shards).select(F.col("doc_id").alias("__id"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    joined = docs.join(placed, F.col("doc_id") == F.col("__id")).drop("__id")
    joined.repartitionByRange(shards, "__shard", "__slot").sortWithinPartitions("__shard", "__slot").drop("__slot").write.partitionBy("__shard").parquet(path)
