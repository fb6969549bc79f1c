"""Quality rules: boosted trees over document statistics beside two fixed rules.

The trees learn from labelled documents (quality 0 or 1). They are fitted on the driver on at most `most`
labelled documents, those with the smallest hash of doc_id; everything else covers every document. More symbols,
repeats, repeated lines or capitals can only lower a document's score (monotonic constraints).

Null text has no words, and so fails the base rules. Null, clashing or missing labels: a document's label is its
mean quality, at least one half counts as good; without both kinds of labels every document gets probability 1.
Rows with equal doc_id are scored one by one; of those with a labelled id, at most `most` rows in all are learnt from.
Other columns are ignored. Empty input: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import batches, small_batches, texts, whole_text
from .textstats import BASE, FEATURES, statistics

#: -1: a larger value can only lower the score.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1, "bang_rate": -1, "mark_rate": -1}
#: The trees keep a document from this probability on.
KEEP_FROM = 0.5


def labelled_sample(labels: DataFrame, most: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """doc_id, good (0.0 or 1.0): at most `most` documents."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.avg(label_col).alias("__q"))
    return known.select("doc_id", (F.col("__q") >= 0.5).cast("double").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts and the features of every document."""

    small_batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            counts, values = zip(*map(statistics, texts(b.column(1))), strict=True)
            cols = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] + [pa.array(np.array(values)[:, j]) for j in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *BASE, *FEATURES])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in BASE), *(f"{c} double" for c in FEATURES)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, most: int = 10_000) -> gbt.Forest | None:
    sample = F.broadcast(labelled_sample(labels, most))  # at most `most` rows
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id", "left_semi")
    rows = features(chosen).join(sample, "doc_id").select("doc_id", "good", *FEATURES)
    # an id may stand on any number of rows: the bound is one of rows
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(most).toPandas().sort_values(["doc_id", *FEATURES])
    y = got["good"].to_numpy()
    if len(y) < 20 or y.min() == y.max():
        return None
    return gbt.fit(got[list(FEATURES)].to_numpy(), y, np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def judge(docs: DataFrame, forest: gbt.Forest | None) -> DataFrame:
    """doc_id, the base counts, base_failed, score, kept."""
    small_batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            counts, values = zip(*map(statistics, texts(b.column(1))), strict=True)
            counts = np.array(counts, np.int64)
            score = np.ones(len(counts)) if forest is None else forest.probability(np.array(values))
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(counts[:, j]) for j in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= KEEP_FROM))],
                names=["doc_id", *BASE, "base_failed", "score", "kept"],
            )

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in BASE), "base_failed boolean, score double, kept boolean"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text")).mapInArrow(run, schema)
