"""Impact reports, configuration and control-plane queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import change as K
from ..operators import diff as D
from ..operators import reach
from ..operators import report as R
from ..operators import score as C
from ..operators import stats as S
from . import scoring
from .scoring import ALL, QUALITY, RISK
from .tables import REGISTRY, load, marked_index, registry, small, sql
from .texts import ADDED, DIFF, FILE_OF, diff_lines

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


GAPS = "gap AS (SELECT term FROM terms WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.term = terms.term))"


@query(ALL.rstrip() + f""", {GAPS}, dep AS (SELECT o_orderkey AS test_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
pick AS (SELECT CAST(s.test_id AS VARCHAR) AS key, CASE WHEN n >= 10 THEN 'FULLY_CROSS_DEPENDENT' WHEN n <= 2 THEN 'FULLY_STANDALONE' ELSE 'MODERATE_LINKAGE' END AS linkage, {QUALITY} AS quality, {RISK} AS risk FROM s JOIN dep USING (test_id) WHERE score >= 50)
SELECT 'linkage' AS part, key, linkage AS value FROM pick UNION ALL SELECT 'quality', key, quality FROM pick UNION ALL SELECT 'risk', key, risk FROM pick UNION ALL SELECT 'gap', term, 'no test' FROM gap UNION ALL SELECT 'gaps', '0', CAST(count(*) AS VARCHAR) FROM gap
UNION ALL SELECT 'tag', '0', 'SYMBOL_LEVEL_CHANGES' UNION ALL SELECT 'note', '0', '{R.NOTES[4]}' UNION ALL SELECT 'hint', '0', 'FN_RISK: ' || count(*) || ' changed symbol(s) have no mapped tests — manual review.' FROM gap HAVING count(*) > 0""")
def impact_bundle(spark, d):
    """Everything that is said of the flagship's change: tags, notes, hints, gaps, and of each likely test its linkage, quality and risk."""
    deps = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("test_id"))
    rows = S.linkage(S.counted(scoring.scored(spark, d).where("score >= 50"), deps, "test_id", "n"))
    tests = rows.select("test_id", "linkage", C.evidence_quality().alias("quality"), C.false_positive_risk(F.col("symbol_fits")).alias("risk"))
    terms = small(spark, [(t,) for t in scoring.CHANGE.exact], "symbol string")
    found = marked_index(spark, d, reach.marks(scoring.CHANGE)).where("mark.type = 'exact'").select(F.col("mark.term").alias("symbol")).distinct()
    shape = D.scenario(D.lines(small(spark, [(0, scoring.DIFF)], "k int, body string"), "k", "body"), "k", K.SOURCE).select(D.scenario_tags().alias("tags"))
    return R.impact(tests, shape, terms.join(found, "symbol", "left_anti"))


DEFAULTS = {"en": "pytest", "de": "JUnit5", "fr": "Jest"}


@query("""WITH n AS (SELECT l_orderkey % 3 AS repo, l_orderkey, l_partkey, l_returnflag FROM lineitem), reg AS (SELECT doc_id % 4 AS repo, source || '/' || lang AS dir, lang FROM documents),
i AS (SELECT repo, count(DISTINCT l_partkey) AS n_classes, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_partkey END) AS n_direct FROM n WHERE repo <> 1 GROUP BY 1),
g AS (SELECT repo, count(*) AS n_tests, count(DISTINCT dir) AS n_dirs, arg_min(lang, (-c, lang)) AS lang FROM (SELECT *, count(*) OVER (PARTITION BY repo, lang) AS c FROM reg) GROUP BY 1),
f AS (SELECT s_nationkey AS repo, min(s_name) AS framework FROM supplier WHERE s_nationkey = 2 GROUP BY 1)
SELECT k.repo, coalesce(n_tests, 0) AS n_tests, coalesce(n_classes, n_dirs, 0) AS n_modules, coalesce(n_direct, n_classes, 0) AS n_production, coalesce(framework, CASE lang WHEN 'en' THEN 'pytest' WHEN 'de' THEN 'JUnit5' WHEN 'fr' THEN 'Jest' END, 'unknown') AS framework
FROM (SELECT DISTINCT n_nationkey::BIGINT AS repo FROM nation WHERE n_nationkey < 6) k LEFT JOIN i USING (repo) LEFT JOIN g USING (repo) LEFT JOIN f USING (repo)""")
def repository_kpis(spark, d):
    """Figures of each repository, by the surest source that it has: the index, else the registry's folders; a detected framework, else its first language's."""
    lines = load(spark, d, "lineitem").selectExpr("l_orderkey % 3 as repo", "l_partkey", "l_returnflag").where("repo <> 1")
    index = lines.groupBy("repo").agg(F.countDistinct("l_partkey").alias("n_classes"), F.countDistinct(F.when(F.col("l_returnflag") == "A", F.col("l_partkey"))).alias("n_direct"))
    known = load(spark, d, "documents").selectExpr("doc_id % 4 as repo", "concat(source, '/', lang) as dir", "lang")
    tests = known.groupBy("repo").agg(F.count("*").alias("n_tests"), F.countDistinct("dir").alias("n_dirs"))
    first = known.groupBy("repo", "lang").agg(F.count("*").alias("c")).groupBy("repo").agg(F.min(F.struct((-F.col("c")).alias("c"), "lang"))["lang"].alias("lang"))
    found = load(spark, d, "supplier").where("s_nationkey = 2").groupBy(F.col("s_nationkey").cast("long").alias("repo")).agg(F.min("s_name").alias("framework"))
    rows = load(spark, d, "nation").where("n_nationkey < 6").select(F.col("n_nationkey").cast("long").alias("repo")).distinct()
    for part in (index, tests, first, found):
        rows = rows.join(part, "repo", "left")
    return rows.select("repo", *R.fallbacks(DEFAULTS))


@query("SELECT coalesce((SELECT count(*) FROM labels), 0) AS n_metadata, (SELECT count(*) FROM documents) AS n_tests, coalesce(nullif((SELECT count(DISTINCT lang) FROM documents), 0), 1) AS n_languages, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_symbols, (SELECT max(ts) FROM events)::VARCHAR[:19] AS last_event".replace("(SELECT max(ts) FROM events)::VARCHAR[:19]", "strftime((SELECT max(ts) FROM events), '%Y-%m-%d %H:%M:%S')"))
def summary_kpis(spark, d):
    one = lambda t, e, n: load(spark, d, t).agg(e.alias(n))
    frames = [one("labels", F.count("*"), "n_metadata"), one("documents", F.count("*"), "n_tests"), one("documents", F.countDistinct("lang"), "n_languages"), one("lineitem", F.countDistinct("l_partkey"), "n_symbols"), one("events", F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss"), "last_event")]
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)  # one row each
    return out.withColumn("n_languages", F.coalesce(F.nullif("n_languages", F.lit(0)), F.lit(1)))


@query("SELECT c_nationkey, arg_max(c_custkey, (c_acctbal > 0, c_acctbal, -c_custkey)) AS primary_id FROM customer GROUP BY 1")
def primary_repo(spark, d):
    c = load(spark, d, "customer")
    return R.first_by(c, "c_nationkey", (F.col("c_acctbal") > 0).desc(), F.desc("c_acctbal"), F.asc("c_custkey")).select("c_nationkey", F.col("c_custkey").alias("primary_id"))


@query("SELECT c_custkey, coalesce(greatest(0.05::DOUBLE, least(0.92::DOUBLE, CASE WHEN c_nationkey % 3 = 0 THEN c_acctbal / 5000 END)), CASE c_mktsegment WHEN 'BUILDING' THEN 0.22::DOUBLE WHEN 'MACHINERY' THEN 0.32::DOUBLE WHEN 'FURNITURE' THEN 0.5::DOUBLE END, 0.45::DOUBLE) AS threshold FROM customer".replace("greatest(0.05::DOUBLE, least(0.92::DOUBLE, CASE WHEN c_nationkey % 3 = 0 THEN c_acctbal / 5000 END))", "CASE WHEN c_nationkey % 3 = 0 THEN greatest(0.05::DOUBLE, least(0.92::DOUBLE, c_acctbal / 5000)) END"))
def threshold_override(spark, d):
    preset = F.when(F.col("c_mktsegment") == "BUILDING", "lenient").when(F.col("c_mktsegment") == "MACHINERY", "balanced").when(F.col("c_mktsegment") == "FURNITURE", "strict")
    override = F.when(F.col("c_nationkey") % 3 == 0, F.col("c_acctbal") / 5000)
    return load(spark, d, "customer").select("c_custkey", R.threshold(F.lit(0.45), override, preset).alias("threshold"))


FILES = "f AS (SELECT DISTINCT 'lib/' || source || '/' || lang || CASE doc_id % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' ELSE '/index.js' END AS file_path FROM documents)"
WANT = "w AS (SELECT DISTINCT doc_id % 7 AS src, 'lib/' || source || '/' || lang AS target FROM documents)"


def module_files(spark, d):
    return load(spark, d, "documents").select(F.expr("'lib/' || source || '/' || lang || CASE doc_id % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' ELSE '/index.js' END").alias("file_path")).distinct()


@query(f"WITH {FILES}, {WANT} SELECT src, target, file_path FROM (SELECT w.*, f.file_path, list_position([target, target || '.js', target || '.ts', target || '/index.js'], f.file_path) AS p FROM w JOIN f ON f.file_path IN (target, target || '.js', target || '.ts', target || '/index.js')) QUALIFY row_number() OVER (PARTITION BY src, target ORDER BY p) = 1")
def import_resolution(spark, d):
    wanted = load(spark, d, "documents").select(F.expr("doc_id % 7").alias("src"), F.expr("'lib/' || source || '/' || lang").alias("target")).distinct()
    return R.resolve_imports(wanted, module_files(spark, d))


PATHS = "p AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN 'lib/' || source || '/' || lang || '.js' WHEN 1 THEN '/abs/x/' || source || '/' || lang || '.js' ELSE 'q/' || lang || '.ts' END AS path FROM documents)"


@query(f"""WITH {FILES}, {PATHS}, m AS (SELECT path, file_path, CASE WHEN path = file_path THEN 0 WHEN array_to_string(string_split(path, '/')[-2:], '/') = array_to_string(string_split(file_path, '/')[-2:], '/') THEN 1 WHEN string_split(path, '/')[-1] = string_split(file_path, '/')[-1] THEN 2 END AS how FROM p, f)
SELECT path, file_path, how FROM m WHERE how IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY how, file_path) = 1""")
def path_format_fallback(spark, d):
    path = F.expr("CASE doc_id % 3 WHEN 0 THEN 'lib/' || source || '/' || lang || '.js' WHEN 1 THEN '/abs/x/' || source || '/' || lang || '.js' ELSE 'q/' || lang || '.ts' END")
    return R.path_fallback(load(spark, d, "documents").select(path.alias("path")).distinct(), module_files(spark, d))


@query("""WITH e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'l' || l_linenumber FROM lineitem WHERE l_quantity > 49 UNION SELECT DISTINCT 'p' || l_partkey, 'l' || l_linenumber FROM lineitem WHERE l_discount > 0.09),
two AS (SELECT DISTINCT x.a, y.b FROM e x JOIN e y ON x.b = y.a) SELECT * FROM two EXCEPT SELECT * FROM e""")
def indirect_imports(spark, d):
    """What is imported by what is imported, and not directly, over the whole graph."""
    li = load(spark, d, "lineitem")
    pair = lambda a, b, where="true": li.where(where).select(F.expr(a).alias("a"), F.expr(b).alias("b"))
    e = pair("concat('p', l_partkey)", "concat('s', l_suppkey)").union(pair("concat('s', l_suppkey)", "concat('l', l_linenumber)", "l_quantity > 49")).union(pair("concat('p', l_partkey)", "concat('l', l_linenumber)", "l_discount > 0.09D")).distinct()
    two = e.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
    return two.subtract(e)


@query(sql(DIFF) + FILE_OF + f""", a AS (SELECT doc_id, file FROM f WHERE file IS NOT NULL GROUP BY 1, 2 HAVING bool_or(starts_with(line, 'new file')))
SELECT doc_id, file, string_agg(DISTINCT name, ',' ORDER BY name) AS definitions FROM (SELECT doc_id, file, unnest({" || ".join(f"regexp_extract_all(line, '{rx}', 1)" for rx in K.NAMED)} || [{", ".join(f"regexp_extract(line, '^.*{rx}', 1)" for rx in K.NAMED)}]
 || [CASE WHEN ends_with(file, '.java') THEN regexp_extract(line, '{K.DEFINED[".java"]}', 1) ELSE regexp_extract(line, '{K.DEFINED[".py"]}', 1) END]) AS name FROM f JOIN a USING (doc_id, file) WHERE {ADDED}) WHERE name <> '' GROUP BY 1, 2""")
def new_file_definitions(spark, d):
    """The classes and functions that the added lines of new files define, by words of any language and by the file's own pattern."""
    names = D.new_definitions(diff_lines(spark, d), "doc_id", K.NAMED, K.DEFINED)
    return names.groupBy("doc_id", "file").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("definitions"))


@query("""SELECT CASE WHEN label IS NULL THEN CAST(vec_id AS VARCHAR) ELSE 'repo' || label || '_' || vec_id END AS id, len(embedding)::INT AS dims, CAST(vec_id AS VARCHAR) AS test_id, left(array_to_string(embedding, ' '), 0) || left(repeat('d', vec_id::INT * 7), 1000) AS description,
 CASE WHEN vec_id % 2 = 0 THEN 'true' ELSE 'false' END AS is_async, CASE WHEN vec_id % 3 = 0 THEN 'slow,db' ELSE '' END AS markers, coalesce('repo' || label, '') AS test_repo_id FROM embeddings WHERE vec_id IS NOT NULL AND label <> 3""")
def vector_upsert(spark, d):
    """Rows for a store with flat metadata of strings, after the rows of one repository (label 3) are deleted."""
    rows = load(spark, d, "embeddings").where("label <> 3").selectExpr(
        "vec_id as test_id", "embedding", "'repo' || label as repo", "repeat('d', cast(vec_id * 7 as int)) as description", "vec_id % 2 = 0 as is_async", "CASE WHEN vec_id % 3 = 0 THEN array('slow', 'db') ELSE array() END as markers")
    return R.vector_rows(rows, 64).select("id", F.size("embedding").alias("dims"), "test_id", "description", "is_async", "markers", "test_repo_id")


@query()
def hashed_embeddings(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("test_id"), F.col("text").alias("body"))
    return R.hashing_vectors(docs)


@query(sql(REGISTRY) + "SELECT language, array_to_string(list_sort(list(DISTINCT file_path))[1:10], ';') AS sample, least(count(DISTINCT file_path), 500) AS capped FROM registry GROUP BY 1")
def list_caps(spark, d):
    files = registry(spark, d).select("language", "file_path").distinct()
    n = files.groupBy("language").agg(F.least(F.count("*"), F.lit(500)).alias("capped"))
    return R.first_k(files, "language", "file_path", 10).join(n, "language").select("language", F.array_join("values", ";").alias("sample"), "capped")


@query("SELECT date_trunc('hour', ts) AS hour_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def audit_windows(spark, d):
    """The audit feed's tumbling windows, as a batch."""
    from ..streaming.incremental import audit_counts

    return audit_counts(load(spark, d, "events")).select(F.col("start").alias("hour_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, count(DISTINCT o_custkey) AS repos FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def selection_cube(spark, d):
    rows = load(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("repos"))
    return rows.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "repos")
