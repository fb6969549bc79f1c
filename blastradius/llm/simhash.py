"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit of the 64-bit fingerprint gets a nonzero vector of radius + 1 bits, dealt evenly; mask v keeps the bits
whose vector has an odd product with v. Any `radius` vectors are orthogonal to some nonzero v, so two fingerprints
that differ in at most `radius` bits agree on all of that mask's bits: they meet in one of the 2^(radius+1) - 1
tables with certainty. For radius 3 that is 15 tables whose keys hold 32 to 40 bits.

Equal fingerprints are one node. Buckets of up to FEW nodes are compared at once, and only a
spanning forest of the links found there is kept, never all pairs. A larger bucket is covered again, on the bits
that its key leaves open (15 tables over about 30 bits, then again over the 13 or so that remain, which no more than
a few hundred distinct fingerprints can share), so that every comparison stays in a small group and no link is lost.

Texts: A-Z lower-cased, words of non-blank characters, 3-word shingles with repeats (fewer words: the whole
sequence; none, or null: fingerprint zero). Null doc_id is a document of its own, smallest in order, and its
component_id is null where it is the smallest. Rows that share a doc_id, or have none, are linked only as far as
their fingerprints are. Other columns are ignored by fingerprints()
and near_duplicates(), kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, small_batches, stash, texts, whole_text
from .components import components

RADIUS = 3
FEW = 256
#: Stands for a null doc_id while ids are compared.
NULL_ID = -(2**63)


def simhash(data: bytes) -> int:
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 3:
        h = np.array([xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = (ends - [len(w) for w in words]).tolist()
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[2:].tolist(), strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, longs: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), and the given columns of longs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            fp = np.array([simhash(t) for t in texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], names=["doc_id", "fp", *longs])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"), *longs).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *longs)))


def masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """The covering masks over these bit places."""
    n = 2 ** (radius + 1) - 1
    return [sum(1 << b for i, b in enumerate(bits) if (v & (i % n + 1)).bit_count() % 2) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among distinct fingerprints."""
    n = len(fps)
    root = np.arange(n)
    out = []
    for i in range(1, n):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius)
        if len(near):
            for r in np.unique(root[near]).tolist():  # one link to each tree met
                if r != root[i]:
                    out.append((int(near[root[near] == r][0]), i))
            met = np.isin(root[: i + 1], np.append(root[near], root[i]))
            root[: i + 1][met] = root[: i + 1][met].min()
    return out


def _tables(nodes: DataFrame) -> DataFrame:
    """Level 1: path (which masks led here), open (the bits left open), key, fp."""
    full = (1 << 64) - 1
    all_masks = masks(list(range(64)))
    tables = F.array(*[F.struct(F.lit(i).cast("long").alias("path"), F.lit(signed(full ^ m)).alias("open"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(all_masks)])
    return nodes.select("fp", F.explode(tables).alias("t")).select("t.path", "t.open", "t.key", "fp")


def _refine(rows: DataFrame) -> DataFrame:
    """The next level: each row once for every mask over the bits that are still open."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in it:
            path, still, key, fp = (np.asarray(b.column(i)) for i in range(4))
            for o in np.unique(still).tolist():
                if o not in known:
                    bits = [i for i in range(64) if (o & (2**64 - 1)) >> i & 1]
                    known[o] = np.array([signed(m) for m in masks(bits)], np.int64)
                at = still == o
                m = known[o]
                p = (path[at][:, None] * 16 + np.arange(1, len(m) + 1)).ravel()
                k = (key[at][:, None] | (fp[at][:, None] & m)).ravel()
                left = np.broadcast_to(o & ~m, (at.sum(), len(m))).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(left), pa.array(k), pa.array(np.repeat(fp[at], len(m)))], names=["path", "open", "key", "fp"])

    return rows.select("path", "open", "key", "fp").mapInArrow(run, "path long, open long, key long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints, enough that every pair within the radius is connected."""

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            a, c = [], []
            for fps in b.column(0).to_pylist():
                x = np.array(fps, np.int64)
                for i, j in forest(x.view(np.uint64)):
                    a.append(int(x[i])), c.append(int(x[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    found = []
    level = _tables(nodes)
    for depth in range(3):
        counts = level.groupBy("path", "key").agg(F.count("*").alias("__n")).where("__n > 1")
        counts = stash(counts, f"simhash-buckets-{depth}")
        kept = level.join(counts, ["path", "key"])
        last = depth == 2  # what three keys leave open is too little for large buckets
        small = (kept if last else kept.where(F.col("__n") <= FEW)).groupBy("path", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(stash(small.select("fps").mapInArrow(compare, "a long, b long"), f"simhash-links-{depth}"))
        if last or counts.where(F.col("__n") > FEW).isEmpty():
            break
        level = stash(_refine(kept.where(F.col("__n") > FEW)), f"simhash-level-{depth}")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def components_of(fps: DataFrame) -> DataFrame:
    """__fp, __component: of each distinct fingerprint the smallest (doc_id, fingerprint) that it is linked to."""
    nodes = stash(fps.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("first")), "simhash-nodes")
    # a node's name holds its fingerprint: different texts may share a doc_id, or have none
    nodes = nodes.select("fp", F.struct(F.coalesce("first", F.lit(NULL_ID)).alias("first"), F.coalesce("fp", F.lit(0)).alias("fp")).alias("node"))
    named = links(nodes).join(nodes.select(F.col("fp").alias("a"), F.col("node").alias("__a")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("node").alias("__b")), "b")
    found = components(named.select(F.col("__a").alias("a"), F.col("__b").alias("b"))).withColumnRenamed("node", "__n")
    return stash(nodes.join(found, F.col("node") == F.col("__n"), "left").select(F.col("fp").alias("__fp"), F.coalesce("component", "node").alias("__component")), "simhash-place")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id."""
    fps = stash(fingerprints(docs), "simhash-fps")  # texts are read once
    first = F.col("__component.first")
    return fps.join(components_of(fps), F.col("fp") == F.col("__fp")).select("doc_id", "fp", F.when(first != NULL_ID, first).alias("component_id"))


def hex_fingerprint(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of fingerprints: of its smallest doc_id, the text with the smallest hash.

    Null doc_id is the smallest. Different texts that share a doc_id, or have none, stay apart unless they are linked.
    """
    body = whole_text("text")
    key = {"__h": F.xxhash64(body), "__c": F.crc32(body)}  # a row's text; the fingerprint follows from it
    fps = stash(fingerprints(docs.withColumns(key), tuple(key)), "simhash-fps")
    placed = fps.join(components_of(fps), F.col("fp") == F.col("__fp"))
    lead = placed.where(F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("__component.first")).groupBy("__component", "doc_id", "__h", "__c").agg(F.count("*").alias("__n"))
    lead = lead.groupBy("__component").agg(F.min(F.struct("__h", "__c", "doc_id", "__n")).alias("__x"))
    lead = stash(lead.select(F.col("__x.doc_id").alias("__id"), F.col("__x.__h").alias("__h"), F.col("__x.__c").alias("__c"), "__x.__n"), "simhash-lead")
    kept = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__dh": key["__h"], "__dc": key["__c"]})
    kept = kept.join(lead, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__dh") == F.col("__h")) & (F.col("__dc") == F.col("__c")))
    once = kept.where("__n = 1").select(*docs.columns)
    if lead.where("__n > 1").isEmpty():
        return once
    # rows of one doc_id and text: a minimum is merged before it is shuffled, however many there are
    order = F.struct(*[c for c in ("source", "lang") if c in docs.columns], F.lit(0))
    many = kept.where("__n > 1").groupBy("__id", "__h", "__c").agg(F.min_by(F.struct(*docs.columns), order).alias("__row")).select("__row.*")
    return once.unionByName(many)
