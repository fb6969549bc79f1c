"""Statistics of the index on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from .tables import ENT, REGISTRY, RI, TFM, entities, load, mapping, registry, reverse_index, sql

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


@query(sql(REGISTRY) + "SELECT test_id, file_path, class_name, test_type, language FROM registry ORDER BY test_id")
def scan_registry(spark, d):
    return registry(spark, d).orderBy("test_id")


@query("SELECT 'lineitem' AS table_name, count(*) AS n_rows FROM lineitem")
def count_tables(spark, d):
    return S.count_tables({"lineitem": load(spark, d, "lineitem")})


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def count_all_tables(spark, d):
    return S.count_tables({t: load(spark, d, t) for t in TABLES})


@query("SELECT o_orderstatus AS test_type, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus <> '' GROUP BY 1")
def tests_by_type(spark, d):
    return load(spark, d, "orders").where("o_orderstatus IS NOT NULL AND o_orderstatus <> ''").groupBy(F.col("o_orderstatus").alias("test_type")).agg(F.count("*").alias("n"))


@query(sql(RI) + "SELECT production_class, count(*) AS n FROM ri GROUP BY 1 ORDER BY n DESC, production_class LIMIT 1")
def top_symbol(spark, d):
    return S.top_by_count(reverse_index(spark, d), ["production_class"], 1)


@query("SELECT o_orderkey AS test_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY n DESC, test_id LIMIT 5")
def top_deps(spark, d):
    ids = load(spark, d, "orders").select(F.col("o_orderkey").alias("test_id"))
    return S.counted(ids, load(spark, d, "lineitem").select(F.col("l_orderkey").alias("test_id")), "test_id").orderBy(F.desc("n"), "test_id").limit(5)


@query("SELECT count(DISTINCT d.doc_id) AS total, (SELECT count(DISTINCT doc_id) FROM labels) AS covered, round(100.0::DOUBLE * (SELECT count(DISTINCT doc_id) FROM labels) / count(DISTINCT d.doc_id), 2) AS coverage_pct FROM documents d")
def metadata_coverage(spark, d):
    return S.coverage(load(spark, d, "documents"), load(spark, d, "labels"), "doc_id")


@query("SELECT (SELECT count(DISTINCT o_orderkey) FROM orders) AS total, count(DISTINCT l_orderkey) AS covered, round(100.0::DOUBLE * count(DISTINCT l_orderkey) / (SELECT count(DISTINCT o_orderkey) FROM orders), 2) AS coverage_pct FROM lineitem")
def mapping_coverage(spark, d):
    return S.coverage(load(spark, d, "orders").select(F.col("o_orderkey").alias("k")), load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query(sql(TFM) + """, top AS (SELECT module_name, function_name, count(*) AS n FROM tfm GROUP BY 1, 2 ORDER BY n DESC, module_name, function_name LIMIT 1)
SELECT DISTINCT t.module_name, t.function_name, top.n, t.test_id FROM tfm t JOIN top USING (module_name, function_name) ORDER BY t.test_id LIMIT 3""".replace(", top AS", ", top AS", 1))
def top_function(spark, d):
    calls = mapping(spark, d)
    top = S.top_by_count(calls, ["module_name", "function_name"], 1)
    return calls.join(F.broadcast(top), ["module_name", "function_name"]).select("module_name", "function_name", "n", "test_id").distinct().orderBy("test_id").limit(3)


@query("SELECT o_orderkey AS test_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unused_tests(spark, d):
    return load(spark, d, "orders").join(load(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.col("o_orderkey").alias("test_id"))


@query("""SELECT count(*) AS n_files, count(*) FILTER (l.doc_id IS NULL) AS n_missing, round(100.0::DOUBLE * count(l.doc_id) / count(*), 2) AS coverage_pct
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def missing_index(spark, d):
    known = load(spark, d, "labels").select(F.col("doc_id").alias("k")).distinct()
    joined = load(spark, d, "documents").select("doc_id").join(known, F.col("doc_id") == F.col("k"), "left")
    return joined.agg(F.count("*").alias("n_files"), F.count_if(F.col("k").isNull()).alias("n_missing"), S.share(F.count("k"), F.count("*")).alias("coverage_pct"))


@query("SELECT o_orderkey AS test_id, o_orderpriority AS language FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) ORDER BY test_id LIMIT 10")
def diagnose_missing(spark, d):
    rows = load(spark, d, "orders").join(load(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return rows.select(F.col("o_orderkey").alias("test_id"), F.col("o_orderpriority").alias("language")).orderBy("test_id").limit(10)


@query(sql(REGISTRY) + "SELECT count(*) AS total, count(DISTINCT class_name) AS n_classes, count(DISTINCT file_path) AS n_files, count(*) FILTER (test_type = 'unit') AS n_unit, count(*) FILTER (test_type = 'integration') AS n_integration, count(*) FILTER (test_type = 'e2e') AS n_e2e FROM registry")
def registry_stats(spark, d):
    kind = lambda k: F.count_if(F.col("test_type") == k).alias(f"n_{k}")
    return registry(spark, d).agg(F.count("*").alias("total"), F.countDistinct("class_name").alias("n_classes"), F.countDistinct("file_path").alias("n_files"), kind("unit"), kind("integration"), kind("e2e"))


@query("SELECT count(*) AS n_tests, sum(n)::BIGINT AS n_imports, round(sum(n)::DOUBLE / count(*), 2) AS avg_imports, count(*) FILTER (n > 0) AS n_with FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def dependency_stats(spark, d):
    ids = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    rows = S.counted(ids, load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")
    return rows.agg(F.count("*").alias("n_tests"), F.sum("n").alias("n_imports"), F.round(F.sum("n").cast("double") / F.count("*"), 2).alias("avg_imports"), F.count_if(F.col("n") > 0).alias("n_with"))


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (quality IS NULL) AS n_unknown FROM labels")
def metadata_stats(spark, d):
    return load(spark, d, "labels").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("quality").isNull()).alias("n_unknown"))


@query(sql(RI) + "SELECT count(DISTINCT production_class) AS n_symbols, count(*) AS n_mappings, round(count(*)::DOUBLE / count(DISTINCT production_class), 2) AS avg_per_symbol FROM ri")
def index_stats(spark, d):
    n = F.countDistinct("production_class")
    return reverse_index(spark, d).agg(n.alias("n_symbols"), F.count("*").alias("n_mappings"), F.round(F.count("*").cast("double") / n, 2).alias("avg_per_symbol"))


@query("SELECT lang, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 3) AS confidence, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 3) >= 0.05 AS active FROM documents GROUP BY 1")
def language_vote(spark, d):
    return S.vote(load(spark, d, "documents"), "lang")


@query(sql(REGISTRY) + """SELECT test_type AS category, count(DISTINCT file_path) AS file_count, count(*) AS test_count, sum(len(string_split(text, chr(10))))::BIGINT AS total_lines
FROM registry JOIN documents ON doc_id = test_id GROUP BY 1""")
def category_structure(spark, d):
    lines = load(spark, d, "documents").select(F.col("doc_id").alias("test_id"), F.size(F.split("text", "\n", -1)).alias("n_lines"))
    return registry(spark, d).join(lines, "test_id").groupBy(F.col("test_type").alias("category")).agg(F.countDistinct("file_path").alias("file_count"), F.count("*").alias("test_count"), F.sum("n_lines").alias("total_lines"))


SUITE_PATH = """CASE language WHEN 'de' THEN 'app/unit/tests/foo/' WHEN 'fr' THEN 'tests/' WHEN 'es' THEN 'tests//x/' ELSE CASE test_type WHEN 'unit' THEN 'tests/unit/' WHEN 'integration' THEN 'app/integration/' ELSE 'src/' END END"""


@query(sql(REGISTRY) + f""", p AS (SELECT string_split({SUITE_PATH} || file_path, '/') AS parts FROM registry),
i AS (SELECT parts, list_min(list_filter(range(1, len(parts) + 1), lambda k: (parts[k] IN ('test', 'tests') AND k < len(parts)) OR parts[k] IN ('unit', 'integration', 'e2e', 'functional'))) AS pos FROM p)
SELECT CASE WHEN pos IS NULL THEN 'other' WHEN parts[pos] IN ('test', 'tests') THEN CASE parts[pos + 1] WHEN '' THEN 'root' ELSE parts[pos + 1] END ELSE parts[pos] END AS suite, count(*) AS n FROM i GROUP BY 1""")
def suite_group(spark, d):
    prefix = F.expr(SUITE_PATH)
    return registry(spark, d).select(S.suite(F.concat(prefix, "file_path")).alias("suite")).groupBy("suite").agg(F.count("*").alias("n"))


@query(sql(RI) + "SELECT production_class, test_id // 4096 AS block, count(DISTINCT test_id) AS n, array_to_string(list_sort(list(DISTINCT test_id)), ',') AS entities FROM ri GROUP BY 1, 2")
def inverted_index(spark, d):
    return S.inverted(reverse_index(spark, d), "production_class", "test_id")


@query(sql(ENT) + "SELECT e.test_id, count(l_orderkey) AS n, CASE WHEN count(l_orderkey) >= 10 THEN 'FULLY_CROSS_DEPENDENT' WHEN count(l_orderkey) <= 2 THEN 'FULLY_STANDALONE' ELSE 'MODERATE_LINKAGE' END AS linkage FROM ent e LEFT JOIN lineitem ON l_orderkey = e.test_id GROUP BY 1")
def linkage_profile(spark, d):
    return S.linkage(S.counted(entities(spark, d).select("test_id"), load(spark, d, "lineitem").select(F.col("l_orderkey").alias("test_id")), "test_id"))


@query(sql(REGISTRY) + "SELECT test_id, file_path, class_name FROM registry QUALIFY row_number() OVER (PARTITION BY file_path, class_name ORDER BY test_id) = 1")
def duplicate_keep(spark, d):
    keep = registry(spark, d).groupBy("file_path", "class_name").agg(F.min("test_id").alias("test_id"))
    return keep.select("test_id", "file_path", "class_name")


@query("SELECT analyzer, count(*) AS n_files, sum(n)::BIGINT AS total_chars, round(avg(n::DOUBLE), 2) AS avg_chars FROM (SELECT source AS analyzer, n_chars AS n FROM documents UNION ALL SELECT 'pages', len(html) FROM pages UNION ALL SELECT role, len(text) FROM conversations) GROUP BY 1")
def merge_structure(spark, d):
    """The results of several analysers, concatenated and summed up."""
    docs, pages, turns = load(spark, d, "documents"), load(spark, d, "pages"), load(spark, d, "conversations")
    rows = [docs.select("source", "lang", "n_chars"), pages.select(F.lit("pages"), F.lit(None), F.length("html")), turns.select("role", F.lit(None), F.length("text"))]
    docs = rows[0].union(rows[1]).union(rows[2])
    part = docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    merged = part.groupBy(F.col("source").alias("analyzer")).agg(F.sum("n").alias("n_files"), F.sum("c").alias("total_chars"))
    return merged.withColumn("avg_chars", F.round(F.col("total_chars").cast("double") / F.col("n_files"), 2))


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1")
def framework_vote(spark, d):
    return S.majority(load(spark, d, "documents"), "source", "lang")
