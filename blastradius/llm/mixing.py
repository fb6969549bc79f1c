"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Sources, in code point order with null last, have weights that repeat a given tuple. The target of a source is its
share of `budget` times all sizes, but at most `most_epochs` times its own size; what it can't take goes to the
others by weight. Each source is a stream: its documents in the order of a hash, read again in the next epoch,
and cut into blocks of equal numbers of words. The slots of the mix are the van der Corput points of a grid; each
point falls, through the cumulative slot counts, into a source, and the k-th slot of a source takes its k-th block.
Every prefix of the schedule so holds the sources near their weights, and a source's last block is cut where its
target is reached.

Sizes are words (runs of non-blank characters); null text has none. A source without words has target 0. The order's
hash is one of doc_id and text, so that neither an id nor its absence that many rows share is one place of the order.
Rows are told apart by doc_id, text and source, never by doc_id alone: null and repeated ids are documents like others.
Rows equal in all three are one class, a stretch of the stream; each gets what the mix takes at its own place in it,
those with smaller hashes of all their columns first (which of wholly equal rows stands first changes nothing). Other
columns are ignored by plan() and kept by mix(). Empty input gives an empty mix.

Scale: no single task sees all rows of a source or of a class: equal rows are counted before they are shuffled, and
dealt out again in pieces of PIECE_ROWS. Running sums are taken within slices of the hash order (a slice
has about SLICE_ROWS documents), and over the slices' totals. The number of slots is bounded by 2^SLOT_BITS plus
the number of sources, at any input size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash

SLICE_ROWS = 20_000
#: Equal rows are written out by so many at a time.
PIECE_ROWS = 1_000
#: Classes of rows that differ in other columns are ordered within so many slices of a hash.
CLASS_SLICES = 256
#: The blocks are as large as makes about this many slots.
SLOT_BITS = 16


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and the shuffled order's key."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order_key().alias("__key"),
    )


def order_key() -> Column:
    """A document's place in the order of its source: a hash of doc_id and text, which also tells it from others."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))


def copies(rows: DataFrame, n: str, number: str) -> DataFrame:
    """Each row n times, numbered from 0; a row that comes very often is dealt to many tasks before it is written out."""
    pieces = rows.withColumn("__piece", F.explode(F.expr(f"sequence(0, ({n} - 1) div {PIECE_ROWS})"))).repartition("__piece", "__key")
    return pieces.withColumn(number, F.explode(F.expr(f"sequence(__piece * {PIECE_ROWS}, least({n}, (__piece + 1) * {PIECE_ROWS}) - 1)"))).drop("__piece")


def targets(sized: DataFrame, weights: tuple[int, ...], budget: float, most_epochs: int) -> DataFrame:
    """source, source_size, weight, target, n_docs: one row for each source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # the windows below see one row for each source, never documents
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w.cast("double")).withColumn("__cap", F.lit(float(most_epochs)) * F.col("source_size"))
    # water level: sources that reach their limit first stand first; a source is full if the level of what the
    # sources before it leave, spread over it and those after it, is not below its own
    fill = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0.0)
    per = per.withColumn("__level", (F.lit(budget) * F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), zero)) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)))
    per = per.withColumn("__full", F.col("__cap") <= F.col("weight") * F.col("__level"))
    level = F.coalesce(F.min(F.when(~F.col("__full"), F.struct(F.col("__cap") / F.col("weight"), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("__level").alias("l")))).over(every)["l"], zero)
    return per.select("source", "source_size", "weight", "n_docs", F.when(F.col("__full"), F.col("__cap")).otherwise(F.col("weight") * level).alias("target"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def streams(sized: DataFrame, per: DataFrame) -> DataFrame:
    """Every document with where it starts in its source's stream."""
    rows = per.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first()["n"]  # one number
    digits = 0
    while 16**digits * SLICE_ROWS < rows:
        digits += 1
    classes = sized.groupBy("doc_id", "source", "size", "__key").agg(F.count("*").alias("__n"))  # equal rows, counted before the shuffle
    cut = classes.withColumn("__slice", F.substring("__key", 1, digits) if digits else F.lit(""))
    words = F.sum(F.col("size") * F.col("__n"))
    totals = cut.groupBy("source", "__slice").agg(words.alias("__words"))
    upto = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("__s"), F.col("__slice").alias("__c"), F.coalesce(F.sum("__words").over(upto), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("source", "__slice").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("__in", F.coalesce(words.over(inside), F.lit(0)))
    found = cut.join(totals, same(F.col("source"), F.col("__s")) & (F.col("__slice") == F.col("__c")))
    return copies(found, "__n", "__j").select("doc_id", "source", "size", "__key", (F.col("__base") + F.col("__in") + F.col("__j") * F.col("size")).alias("start"))


def schedule(per: DataFrame, slot_bits: int = SLOT_BITS) -> tuple[DataFrame, int]:
    """slot, source, block (from 0, over the epochs), words of the block that the mix takes; and the block size."""
    spark = per.sparkSession
    words = per.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("t")).first()["t"]
    block = max(1, -int(-words // 2**slot_bits))
    quota = per.withColumn("__take", F.floor("target").cast("long")).withColumn("__n", F.ceil(F.col("__take") / block).cast("long"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    quota = quota.withColumn("__from", F.coalesce(F.sum("__n").over(order), F.lit(0)))
    slots = quota.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()["n"]
    bits = max(1, (max(1, slots) - 1).bit_length())
    # the cell of the k-th van der Corput point is k with its bits turned round; a source's cells follow one another
    grid = spark.range(2**bits).select(F.col("id").alias("__k"), F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long").alias("__cell"))
    owned = quota.where("__n > 0").select("source", "__take", F.explode(F.expr("sequence(__from, __from + __n - 1)")).alias("__cell"))
    placed = owned.join(grid, "__cell")
    chunk = 4096
    placed = placed.withColumn("__chunk", F.expr(f"__k div {chunk}"))
    counts = placed.groupBy(F.col("source").alias("__s"), F.col("__chunk").alias("__c")).agg(F.count("*").alias("__m"))
    counts = counts.withColumn("__base", F.coalesce(F.sum("__m").over(Window.partitionBy("__s").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = placed.withColumn("__r", F.row_number().over(Window.partitionBy("source", "__chunk").orderBy("__k")) - 1)
    ranked = ranked.join(counts, same(F.col("source"), F.col("__s")) & (F.col("__chunk") == F.col("__c")))
    at = F.col("__base") + F.col("__r")
    return ranked.select(F.col("__k").alias("slot"), "source", at.alias("block"), F.least(F.lit(block), F.col("__take") - at * block).cast("long").alias("words")), block


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most_epochs: int = 2, slot_bits: int = SLOT_BITS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot: how many words of each document the mix takes, and
    the first slot of the schedule that holds any of them (null: none)."""
    return _keyed_plan(docs, weights, budget, most_epochs, slot_bits).drop("__key")


def _keyed_plan(docs: DataFrame, weights: tuple[int, ...], budget: float, most_epochs: int, slot_bits: int) -> DataFrame:
    sized = stash(sizes(docs), "mix-sizes")  # texts are read once
    per = stash(targets(sized, weights, budget, most_epochs), "mix-targets")
    slots, block = schedule(per, slot_bits)
    at = streams(sized, per).join(per.select(F.col("source").alias("__s"), "source_size", "target"), same(F.col("source"), F.col("__s"))).drop("__s")
    at = at.withColumn("__row", F.struct("doc_id", "source", "size", "__key", "start", "source_size", "target"))
    # a document with the blocks it reaches into, epoch by epoch
    epochs = at.where("size > 0").select("__row", "source", "size", F.explode(F.expr(f"transform(sequence(0, {most_epochs - 1}), e -> e * source_size + start)")).alias("__a"))
    parts = epochs.select("__row", "source", "__a", F.col("size"), F.explode(F.expr(f"sequence(__a div {block}, (__a + size - 1) div {block})")).alias("block"))
    slots = slots.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "slot", "words")
    # blocks of one source are many keys, so that a large source is dealt out too
    met = parts.join(slots, same(F.col("source"), F.col("__s")) & (F.col("block") == F.col("__b")))
    got = F.least(F.col("__a") + F.col("size"), F.col("block") * block + F.col("words")) - F.greatest(F.col("__a"), F.col("block") * block)
    met = met.select("__row", "slot", F.greatest(got, F.lit(0)).alias("__got"))
    missed = at.where("size > 0").select("__row", F.lit(None).cast("long").alias("slot"), F.lit(0).cast("long").alias("__got"))
    out = met.unionByName(missed).groupBy("__row").agg(F.sum("__got").alias("taken"), F.min(F.when(F.col("__got") > 0, F.col("slot"))).alias("first_slot"))
    out = out.select("__row.doc_id", "__row.source", "__row.size", "__row.__key", "__row.source_size", "__row.target", "taken", "first_slot")
    # rows without words start where others do, so that nothing tells equal ones apart: they aren't grouped
    none = at.where("size = 0").select("doc_id", "source", "size", "__key", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return out.unionByName(none)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most_epochs: int = 2, slot_bits: int = SLOT_BITS) -> DataFrame:
    """The documents of the mix with all their columns: a document comes once for every epoch of which the mix takes
    at least half of its words (never more than most_epochs times); texts stay whole."""
    planned = _keyed_plan(docs, weights, budget, most_epochs, slot_bits).where("size > 0")
    # of a class of equal rows: how many there are, and how many of them come at least once, twice, ...
    times = F.floor(F.col("taken") / F.col("size") + 0.5)
    reach = F.array(*[F.count_if(times >= e) for e in range(1, most_epochs + 1)])
    planned = planned.groupBy(F.col("__key").alias("__k"), F.col("source").alias("__src")).agg(F.count("*").alias("__n"), reach.alias("__reach"))
    planned = stash(planned.where("__reach[0] > 0"), "mix-times")
    joined = docs.withColumn("__key", order_key()).join(planned, (F.col("__key") == F.col("__k")) & same(F.col("source").cast("string"), F.col("__src"))).drop("__k", "__src")
    once = joined.where("__n = 1").withColumn("__copy", F.explode(F.expr("sequence(1L, aggregate(__reach, 0L, (a, x) -> a + x))"))).select(*docs.columns)
    if planned.where("__n > 1").isEmpty():  # no class of several rows: texts go to their numbers once
        return once
    return once.unionByName(_equal_rows(joined.where("__n > 1"), docs.columns))


def _equal_rows(joined: DataFrame, columns: list[str]) -> DataFrame:
    """Of classes of several rows: the row at place j of its class comes once for each number of __reach above j."""
    whole = joined.groupBy(*columns, "__key", "__reach").agg(F.count("*").alias("__m"))  # wholly equal rows, counted before the shuffle
    whole = whole.withColumn("__hash", F.xxhash64(*columns)).withColumn("__slice", F.pmod("__hash", F.lit(CLASS_SLICES)))
    kind = ["__key", "source"]
    totals = whole.groupBy(*kind, "__slice").agg(F.sum("__m").alias("__all"))
    upto = Window.partitionBy(*kind).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # CLASS_SLICES rows at most
    totals = totals.select(F.col("__key").alias("__k"), F.col("source").alias("__src"), F.col("__slice").alias("__c"), F.coalesce(F.sum("__all").over(upto), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*kind, "__slice").orderBy("__hash", *[c for c in columns if c not in ("text", "doc_id", "source")]).rowsBetween(Window.unboundedPreceding, -1)
    placed = whole.withColumn("__in", F.coalesce(F.sum("__m").over(inside), F.lit(0)))
    placed = placed.join(totals, (F.col("__key") == F.col("__k")) & same(F.col("source"), F.col("__src")) & (F.col("__slice") == F.col("__c")))
    placed = placed.withColumn("__all", F.expr("aggregate(__reach, 0L, (a, r) -> a + greatest(0L, least(__m, r - __base - __in)))"))
    return copies(placed.where("__all > 0"), "__all", "__j").select(*columns)


#: DuckDB: the stream's clip in closed form, and the schedule: the k-th van der Corput point is k with its bits turned round.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(list_extract([5, 2, 1], (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1) AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap <= weight * level AS is_full FROM l),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE weight * (SELECT arg_min(level, cap / weight) FROM f WHERE NOT is_full) END AS target FROM f),
b AS (SELECT greatest(1, CAST(ceil(coalesce(sum(target), 0) / 65536) AS BIGINT)) AS block FROM t),
q AS (SELECT source, CAST(floor(target) AS BIGINT) AS take, CAST(ceil(floor(target) / block) AS BIGINT) AS n FROM t, b),
g AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cell_from FROM q),
bits AS (SELECT greatest(1, len(bin(greatest(1, CAST(sum(n) AS BIGINT)) - 1))) AS bits FROM q),
grid AS (SELECT k, CAST(list_sum(list_transform(range(bits), lambda i: ((k >> CAST(i AS BIGINT)) & 1) << CAST(bits - 1 - i AS BIGINT))) AS BIGINT) AS cell FROM bits, range(CAST(1 AS BIGINT) << CAST(bits AS BIGINT)) r(k)),
slots AS (SELECT source, k AS slot, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS block_no FROM grid JOIN g ON cell >= cell_from AND cell < cell_from + n),
p AS (SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
e AS (SELECT rid, p.doc_id, p.source, size, source_size, target, start + epoch * source_size AS lo, least(start + epoch * source_size + size, CAST(floor(target) AS BIGINT)) AS hi
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) x(epoch)),
m AS (SELECT e.*, (SELECT min(slot) FROM slots WHERE slots.source IS NOT DISTINCT FROM e.source AND block_no BETWEEN lo // block AND (hi - 1) // block) AS slot FROM e, b)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, hi - lo)) AS BIGINT) AS taken, min(CASE WHEN hi > lo THEN slot END) AS first_slot
FROM m GROUP BY rid, doc_id, source, size, source_size, target
"""
