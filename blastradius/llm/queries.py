"""The registered queries of this subpackage: op1_ to op13_ and the pipeline, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, drake, imatch, mixing, pii, quality_classifier, quality_rules, runs, sentencepieces, sharding, simhash, suffix_dedup, url_filter
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies on the driver; its content is sent to the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


#: Verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, bad: a page's path ends in the number of the document that it shows, and that document has the label."""
    number = F.expr(r"try_cast(regexp_extract(url, '://[^?#]*/([0-9]+)(\\.[a-z]+)?/?([?#]|$)', 1) as bigint)")
    pages = table(spark, sf_dir, "pages").select("url", number.alias("doc_id")).where("doc_id is not null")
    labels = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg((1 - F.avg("quality")).alias("bad"))
    return pages.join(labels, "doc_id").select("url", "bad")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, url_filter.mine(labelled_urls(spark, sf_dir)))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return imatch.compare_edited(docs, imatch.lexicon(docs))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(found["fp"]).alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs))


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path()) as f:
        return bpe.encode_digests(table(spark, sf_dir, "documents"), f.read())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(table(spark, sf_dir, "documents"))


def op12_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drake.digests(table(spark, sf_dir, "embeddings"))


def op13_sentencepiece_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return sentencepieces.encode_digests(table(spark, sf_dir, "documents"), f.read())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_url_filter,
        op3_imatch,
        op4_mixing,
        op5_simhash,
        op6_quality_rules,
        op7_sharding,
        op8_pii,
        op9_quality_classifier,
        op10_bpe_encode_decode,
        op11_periodic_runs,
        op12_drake_clusters,
        op13_sentencepiece_encode_decode,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.ORACLE,
    "op2_url_filter": url_filter.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op12_drake_clusters": drake.oracle(),
}
