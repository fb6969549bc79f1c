"""Control-plane relations, reports, sessions and windows on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import report as R
from ..operators import schema
from ..operators import score as C
from ..operators import stats as S
from ..operators import store
from ..streaming import incremental, streaks
from . import scoring, texts
from .scoring import ALL, GATE, HINT
from .tables import ENT, REGISTRY, RI, entities, load, registry, reverse_index, sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


@query("SELECT s_suppkey AS k, s_name AS v FROM supplier UNION ALL SELECT l_partkey, min(l_returnflag) FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r = 1 AND l_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def insert_ignore(spark, d):
    old = load(spark, d, "supplier").selectExpr("s_suppkey as k", "s_name as v")
    new = load(spark, d, "lineitem").selectExpr("l_partkey as k", "l_returnflag as v", "l_orderkey * 10 + l_linenumber as seq")
    return store.insert_ignore(old, new, ["k"], "seq")


@query("""WITH c AS (SELECT o_custkey, CASE WHEN count(*) >= 10 THEN max(o_totalprice) END AS bal, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'URGENT' END AS seg FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(bal, c_acctbal) AS c_acctbal, coalesce(seg, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def partial_update(spark, d):
    changes = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.when(F.count("*") >= 10, F.max("o_totalprice")).alias("c_acctbal"), F.when(F.bool_or(F.col("o_orderpriority") == "1-URGENT"), "URGENT").alias("c_mktsegment"))
    return store.partial_update(load(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), changes, "c_custkey")


@query(ALL + f"SELECT 'repo' AS repository_id, 3 AS changed_files_count, count(*) FILTER ({GATE}) AS selected_tests_count, count(*) FILTER ({GATE} AND score >= 70) AS high, count(*) FILTER ({GATE} AND score >= 50 AND score < 70) AS medium, count(*) FILTER ({GATE} AND score < 50) AS low, false AS threshold_exceeded FROM s")
def audit_row(spark, d):
    """The row that a selection appends to the audit log (store.append)."""
    k, n = scoring.kept(), len(scoring.CHANGE.files)
    band = lambda b: F.count_if(k & (C.band(F.col("score")) == b)).alias(b)
    rows = scoring.scored(spark, d).agg(F.count_if(k).alias("selected_tests_count"), band("high"), band("medium"), band("low"))
    return rows.select(F.lit("repo").alias("repository_id"), F.lit(n).alias("changed_files_count"), "selected_tests_count", "high", "medium", "low", F.lit(n > 20).alias("threshold_exceeded"))


@query(ALL + f"SELECT test_id, coalesce(l.label, {HINT}) AS dependency FROM s LEFT JOIN (SELECT doc_id AS test_id, CASE toxic WHEN 1 THEN 'cross_dependent' WHEN 0 THEN 'independent' END AS label FROM labels) l USING (test_id)")
def dependency_override(spark, d):
    """A given label stands before the rule's."""
    given = load(spark, d, "labels").selectExpr("doc_id as test_id", "CASE toxic WHEN 1 THEN 'cross_dependent' WHEN 0 THEN 'independent' END as label")
    return scoring.scored(spark, d).join(given, "test_id", "left").select("test_id", F.coalesce("label", C.dependency_hint()).alias("dependency"))


@query(sql(RI, ENT) + "SELECT DISTINCT test_id, test_type, production_class, reference_type FROM ent LEFT JOIN ri USING (test_id) WHERE test_type IN ('integration', 'e2e')")
def integration_references(spark, d):
    ent = entities(spark, d).where(F.col("test_type").isin("integration", "e2e")).select("test_id", "test_type")
    return ent.join(reverse_index(spark, d), "test_id", "left").select("test_id", "test_type", "production_class", "reference_type").distinct()


ORPHANS = {
    "lineitem.l_orderkey": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "lineitem.l_partkey": ("lineitem", "l_partkey", "part", "p_partkey"),
    "orders.o_custkey": ("orders", "o_custkey", "customer", "c_custkey"),
    "labels.doc_id": ("labels", "doc_id", "documents", "doc_id"),
}


def orphans(spark, d):
    out = []
    for name, (a, x, b, y) in ORPHANS.items():
        left = load(spark, d, a).select(F.col(x).alias("__a"))
        gone = left.join(load(spark, d, b).select(F.col(y).alias("__b")), F.col("__a") == F.col("__b"), "left_anti")
        out.append(gone.agg(F.count("*").alias("value")).select(F.lit(name).alias("check"), "value"))
    return out


ORPHAN_SQL = " UNION ALL ".join(f"SELECT '{n}' AS check_, count(*) AS value FROM {a} x WHERE NOT EXISTS (SELECT 1 FROM {b} y WHERE y.{q} = x.{p})" for n, (a, p, b, q) in ORPHANS.items())


@query(f"SELECT check_ AS relation, value AS n_orphans FROM ({ORPHAN_SQL})")
def orphan_check(spark, d):
    return S.union_all(orphans(spark, d)).select(F.col("check").alias("relation"), F.col("value").alias("n_orphans"))


TABLES = ("documents", "orders", "lineitem", "labels")


@query(sql(RI) + f"""SELECT 'rows.' || t AS check_, n AS value FROM ({" UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in TABLES)})
UNION ALL SELECT 'symbols', count(DISTINCT production_class) FROM ri UNION ALL SELECT 'tests_without_references', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'orphans.' || check_, value FROM ({ORPHAN_SQL})""")
def quality_report(spark, d):
    """The checks of an index in one relation: sizes, symbols, tests without references, orphans."""
    sizes = [load(spark, d, t).agg(F.count("*").alias("value")).select(F.lit(f"rows.{t}").alias("check"), "value") for t in TABLES]
    symbols = reverse_index(spark, d).agg(F.countDistinct("production_class").alias("value")).select(F.lit("symbols").alias("check"), "value")
    unused = load(spark, d, "orders").join(load(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("value")).select(F.lit("tests_without_references").alias("check"), "value")
    gone = S.union_all(orphans(spark, d)).select(F.concat(F.lit("orphans."), "check").alias("check"), "value")
    return S.union_all([*sizes, symbols, unused, gone]).withColumnRenamed("check", "check_")


@query(sql(REGISTRY) + "SELECT test_type AS category, file_path, count(*) AS n FROM registry GROUP BY 1, 2 ORDER BY 1, 2")
def structure_sorted(spark, d):
    return registry(spark, d).groupBy(F.col("test_type").alias("category"), "file_path").agg(F.count("*").alias("n")).orderBy("category", "file_path")


#: The same file under different roots; its class may be missing.
DUP = """g AS (SELECT CASE test_id % 3 WHEN 0 THEN 'c:/x/test_repository/' || language || '/a.js' WHEN 1 THEN 'd:/y/test_repository/' || language || '/a.js' ELSE 'z/unit/' || language || '.js' END AS path, CASE WHEN test_id % 4 > 0 THEN class_name END AS class_name, test_type, test_id FROM registry)"""
NORM = "CASE WHEN contains(path, 'test_repository') THEN ltrim(substr(path, strpos(path, 'test_repository') + 15), '/') WHEN list_extract(string_split(path, '/'), -2) IN ('unit', 'integration', 'e2e', 'tests', 'test') THEN array_to_string(string_split(path, '/')[-2:], '/') ELSE list_extract(string_split(path, '/'), -1) END"


def same_files(spark, d):
    path = F.expr("CASE test_id % 3 WHEN 0 THEN 'c:/x/test_repository/' || language || '/a.js' WHEN 1 THEN 'd:/y/test_repository/' || language || '/a.js' ELSE 'z/unit/' || language || '.js' END")
    rows = registry(spark, d).withColumns({"path": path, "class_name": F.expr("CASE WHEN test_id % 4 > 0 THEN class_name END")})
    return rows.select(X.normalize_path(F.col("path")).alias("path"), F.coalesce("class_name", F.lit("")).alias("class_name"), "test_type", "test_id")


@query(sql(REGISTRY, DUP) + f"SELECT {NORM} AS path, coalesce(class_name, '') AS class_name, test_type, count(*) AS n, min(test_id) AS keeper FROM g GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return S.duplicate_groups(same_files(spark, d), ["path", "class_name", "test_type"])


@query(sql(REGISTRY, DUP) + f"SELECT count(*) AS n_groups, sum(n - 1)::BIGINT AS n_extra FROM (SELECT count(*) AS n FROM g GROUP BY {NORM}, coalesce(class_name, ''), test_type HAVING count(*) > 1)")
def duplicate_summary(spark, d):
    return S.duplicate_groups(same_files(spark, d), ["path", "class_name", "test_type"]).agg(F.count("*").alias("n_groups"), F.sum(F.col("n") - 1).alias("n_extra"))


@query(ALL + f"""SELECT (SELECT count(*) FROM ent) AS n_total, count(*) FILTER ({GATE}) AS n_selected, count(*) FILTER ({GATE} AND score >= 60) AS n_high, count(*) FILTER ({GATE} AND score >= 60 AND test_type = 'unit') AS n_fast,
round((1 - count(*) FILTER ({GATE})::DOUBLE / (SELECT count(*) FROM ent)) * 100, 1) AS reduction_pct FROM s""")
def reduction_stats(spark, d):
    k, high = scoring.kept(), F.col("score") >= 60
    rows = scoring.scored(spark, d).agg(F.count_if(k).alias("n_selected"), F.count_if(k & high).alias("n_high"), F.count_if(k & high & (F.col("test_type") == "unit")).alias("n_fast"))
    rows = rows.crossJoin(entities(spark, d).agg(F.count("*").alias("n_total")))  # one row each
    pct = F.when(F.col("n_total") == 0, 0.0).otherwise(F.round((1 - F.col("n_selected").cast("double") / F.col("n_total")) * 100, 1))
    return rows.select("n_total", "n_selected", "n_high", "n_fast", pct.alias("reduction_pct"))


@query(ALL + f"SELECT test_id, file_path || '::' || coalesce(class_name, '') AS command FROM s JOIN ent USING (test_id, test_type) WHERE {GATE} AND score >= 60 AND test_type = 'unit'")
def fast_commands(spark, d):
    """What runs first: unit tests of high confidence, as arguments of a test runner; rows, not one long string."""
    rows = scoring.scored(spark, d).where(scoring.kept() & (F.col("score") >= 60) & (F.col("test_type") == "unit"))
    return rows.join(entities(spark, d).select("test_id", "file_path", "class_name"), "test_id").select("test_id", F.concat_ws("::", "file_path", F.coalesce("class_name", F.lit(""))).alias("command"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'FN_RISK: Large change set — run area suites or full test job in addition to listed tests.' END, CASE WHEN p_size % 4 > 0 THEN 'FN_RISK: ' || p_size % 4 || ' changed symbol(s) have no mapped tests — manual review.' END, CASE WHEN p_size % 7 = 0 THEN 'FN_RISK: Verify each language''s test pipeline was indexed for this repo.' END], lambda x: x IS NOT NULL), '|') AS hints FROM part")
def false_negative_hints(spark, d):
    tags = F.array_compact(F.array(F.when(F.col("p_size") > 40, "MAXIMUM_BLAST_RADIUS"), F.when(F.col("p_size") % 7 == 0, "MIXED_LANGUAGE_DIFF")))
    return load(spark, d, "part").select("p_partkey", F.array_join(R.false_negative_hints(tags, F.col("p_size") % 4), "|").alias("hints"))


NOTES = [("MICRO_GUARD_HOTFIX", R.NOTES[0]), ("MAXIMUM_BLAST_RADIUS", R.NOTES[1]), ("MIXED_LANGUAGE_DIFF", R.NOTES[2]), ("TIGHT_FEATURE_ISOLATION", R.NOTES[3])]


@query(f"""SELECT doc_id, coalesce(nullif(array_to_string(list_filter([{', '.join(f"CASE WHEN contains(tags, '{t}') THEN '{n}' END" for t, n in NOTES)}], lambda x: x IS NOT NULL), '|'), ''), '{R.NOTES[4]}') AS notes FROM ({texts.ORACLE_SQL["scenario_tags"]})""")
def precision_notes(spark, d):
    """What each diff's tags say of the precision of its matches."""
    tags = texts.QUERIES["scenario_tags"](spark, d)
    return tags.select("doc_id", F.array_join(R.precision_notes(F.split("tags", ",")), "|").alias("notes"))


@query("""WITH t AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM t)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM n GROUP BY user_id, session""")
def user_sessions(spark, d):
    """Events of a user with less than half an hour between them, as a batch."""
    rows = incremental.sessions(load(spark, d, "events"))
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2""")
def sliding_counts(spark, d):
    """Events by type in windows of an hour that start every half hour, as a batch."""
    rows = incremental.audit_counts(load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", slide="30 minutes")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("SELECT coalesce(l.label, e.label)::INT AS label, coalesce(n, 0) AS n, CASE WHEN l.label IS NULL THEN 'unknown' WHEN n > 0 THEN 'healthy' ELSE 'empty' END AS health FROM (SELECT n_nationkey AS label FROM nation WHERE n_nationkey <> 3) l FULL JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) e ON l.label = e.label")
def embedding_status(spark, d):
    """Every known repository (those of nations, but one) with or without vectors, and vectors of unknown ones."""
    known = load(spark, d, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").cast("int").alias("label"), F.lit(True).alias("known"))
    n = load(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    rows = known.join(n, "label", "full_outer")
    return rows.select("label", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("known").isNull(), "unknown").when(F.col("n") > 0, "healthy").otherwise("empty").alias("health"))


@query("""WITH e AS (SELECT *, coalesce(event_type = 'error', false) AS error, CASE WHEN event_type = 'error' AND NOT coalesce(ts > lag(ts) OVER o + INTERVAL 2 HOUR, false) THEN 0 ELSE 1 END AS begins FROM events WHERE ts IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_no FROM e), s AS (SELECT *, count(*) FILTER (error) OVER (PARTITION BY user_id, row_no ORDER BY ts, event_id) AS streak FROM g)
SELECT user_id, event_id, streak::INT AS streak FROM s WHERE error AND streak = 2""")
def failure_streaks(spark, d):
    """The events that make two errors in a row; the stateful stream gives the same."""
    return streaks.batch(load(spark, d, "events"), most=2)


@query("SELECT 'test_registry' AS relation, count(*) AS n_rows, count(*) FILTER (o_orderkey IS NULL OR o_custkey IS NULL OR o_orderpriority IS NULL) AS n_null, count(*) - count(DISTINCT o_orderkey) AS n_repeated FROM orders UNION ALL "
       "SELECT 'reverse_index', count(*), 0, 0 FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT 'test_metadata', count(*), count(*) FILTER (doc_id IS NULL), count(*) - count(DISTINCT doc_id) FROM labels")
def schema_verification(spark, d):
    """The relations that are made of the tables, fitted to their types and looked through for nulls and repeated keys."""
    ent = entities(spark, d).withColumn("method_name", F.col("language"))
    fitted = {"test_registry": ent, "reverse_index": reverse_index(spark, d), "test_metadata": load(spark, d, "labels").withColumnRenamed("doc_id", "test_id")}
    return schema.verify({n: schema.conform(df, schema.CORE[n]) for n, df in fitted.items()}, schema.CORE)
