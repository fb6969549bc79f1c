"""The driver's star schema read as a change-impact index, for Spark and (as CTEs) for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A stated list of terms as a local relation: its size is known to the planner, which then broadcasts it."""
    names = ", ".join(c.split()[0] for c in schema.split(", "))
    values = ", ".join("(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each test."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("test_id"),
        F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), (F.col("doc_id") % 50).cast("string"), F.lit(".test.js")).alias("file_path"),
        F.expr("nullif(regexp_extract(text, '[A-Za-z]+', 0), '')").alias("class_name"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN 'unit' WHEN 1 THEN 'integration' ELSE 'e2e' END").alias("test_type"),
        F.col("lang").alias("language"),
    )


def symbol() -> Column:
    return F.concat_ws(".", "module_name", "function_name", "leaf")


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("module_name"), F.expr("lower(replace(p_brand, '#', ''))").alias("function_name"), F.expr("replace(p_name, ' ', '_')").alias("leaf"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """production_class, module_name: all symbols that an index can name, once for each part."""
    return _symbols(spark, sf_dir).select(symbol().alias("production_class"), "module_name")


REFERENCE = "CASE l_returnflag WHEN 'A' THEN 'direct_import' WHEN 'N' THEN 'string_ref' ELSE 'transitive_import' END"
SOURCE = "CASE l_linestatus WHEN 'F' THEN 'patch_ref' ELSE 'method_call' END"


def reverse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """test_id, production_class, reference_type: which test refers to which symbol."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(_symbols(spark, sf_dir), "l_partkey")
    return lines.select(F.col("l_orderkey").alias("test_id"), symbol().alias("production_class"), F.expr(REFERENCE).alias("reference_type"))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """test_id, module_name, function_name, source: which test calls which function."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus").join(_symbols(spark, sf_dir), "l_partkey")
    return lines.select(F.col("l_orderkey").alias("test_id"), "module_name", "function_name", F.expr(SOURCE).alias("source"))


def marked_index(spark: SparkSession, sf_dir: str, marks: Column) -> DataFrame:
    """test_id, reference_type, source, mark: index rows of the symbols that have marks, once for each; the
    symbols are marked before the index is joined, so that only what a change can reach is."""
    part = _symbols(spark, sf_dir).withColumn("production_class", symbol()).select("l_partkey", F.explode(marks).alias("mark"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus").join(part, "l_partkey")
    return lines.select(F.col("l_orderkey").alias("test_id"), F.expr(REFERENCE).alias("reference_type"), F.expr(SOURCE).alias("source"), "mark")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE o_orderstatus WHEN 'F' THEN 'unit' WHEN 'O' THEN 'integration' ELSE 'e2e' END")
    path = F.concat(F.lit("tests/"), kind, F.lit("/"), F.expr("lower(substring(o_orderpriority, 3))"), F.lit("/cust_"), F.col("o_custkey").cast("string"), F.lit(".test.js"))
    label = F.expr("CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL ELSE initcap(substring(o_orderpriority, 3)) || 'Suite' END")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("test_id"), kind.alias("test_type"), F.col("o_orderpriority").alias("language"), path.alias("file_path"), label.alias("class_name"))


#: DuckDB twins of the adapters above.
REGISTRY = """registry AS (SELECT doc_id AS test_id, source || '/' || lang || '/doc_' || CAST(doc_id % 50 AS VARCHAR) || '.test.js' AS file_path,
  nullif(regexp_extract(text, '[A-Za-z]+'), '') AS class_name, CASE doc_id % 3 WHEN 0 THEN 'unit' WHEN 1 THEN 'integration' ELSE 'e2e' END AS test_type, lang AS language FROM documents)"""
RI = """ri AS (SELECT l_orderkey AS test_id, concat_ws('.', lower(p_type), lower(replace(p_brand, '#', '')), replace(p_name, ' ', '_')) AS production_class,
  CASE l_returnflag WHEN 'A' THEN 'direct_import' WHEN 'N' THEN 'string_ref' ELSE 'transitive_import' END AS reference_type FROM lineitem JOIN part ON l_partkey = p_partkey)"""
TFM = """tfm AS (SELECT l_orderkey AS test_id, lower(p_type) AS module_name, lower(replace(p_brand, '#', '')) AS function_name,
  CASE l_linestatus WHEN 'F' THEN 'patch_ref' ELSE 'method_call' END AS source FROM lineitem JOIN part ON l_partkey = p_partkey)"""
ENT = """ent AS (SELECT o_orderkey AS test_id, CASE o_orderstatus WHEN 'F' THEN 'unit' WHEN 'O' THEN 'integration' ELSE 'e2e' END AS test_type, o_orderpriority AS language,
  'tests/' || CASE o_orderstatus WHEN 'F' THEN 'unit' WHEN 'O' THEN 'integration' ELSE 'e2e' END || '/' || lower(substr(o_orderpriority, 3)) || '/cust_' || o_custkey || '.test.js' AS file_path,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN upper(substr(o_orderpriority, 3, 1)) || lower(substr(o_orderpriority, 4)) || 'Suite' END AS class_name FROM orders)"""


def sql(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + "\n"
