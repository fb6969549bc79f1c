"""A corpus cleaning pipeline. Counts as part of the training-data subpackage.

Every stage is (spark, docs, sf_dir) -> DataFrame; run() writes each stage's result as Parquet in the shared folder
and gives the next stage what it reads back. What a stage writes on its way is deleted with the stage, and a stage's
result when the next one stands.

1. quality_classifier: documents that the classifier rejects go.
2. simhash_near_dedup: of each group of near copies the smallest doc_id stays.
3. pii: spans of personal data are replaced by their kind in brackets.
4. mixing: every document comes as often as the mix takes it (0 to 2 times); such copies have equal doc_id.
5. bpe: a row for each of those documents with its token ids, its count of tokens and the digests of op10.

What the stages do with odd rows:
 - Null text is an empty text: the classifier judges it as one, it is near every other text without words (one of them
   stays), has no spans, and no words, so that the mix takes none of it. The same holds for empty and blank texts.
 - Null doc_id is the smallest id. Different texts that share an id, or have none, are different documents; rows equal
   in id and text are one (one of them stays). Null lang is kept; null source is a source of its own, the last one.
 - Texts of any length are read whole. Ties go to the smallest hash of the text, then source, then lang.
 - Columns beside doc_id, text, lang and source come along through the stages, whatever their names; n_chars is counted
   anew where text changes. The last stage returns its own columns.
 - Empty documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blastradius.llm import bpe, mixing, pii, quality_classifier, simhash
from blastradius.llm.common import delete_tables, scratch
from blastradius.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, quality_classifier.train(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(tokenizer_path()) as f:
        content = f.read()
    return bpe.encode_all(docs, content)


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe_encode_decode", encode),
]

#: SQL can't express the trained classifier nor the encoder; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs, path = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            delete_tables(spark, [last])
        last = path
    return docs
