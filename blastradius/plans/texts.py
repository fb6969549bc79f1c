"""Text, diff, chunking, mutation and merge queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..functions import text as X
from ..operators import change as K
from ..operators import diff as D
from ..operators import mutation as M
from ..operators import stats as S
from ..operators import versions as W
from .tables import REGISTRY, RI, TFM, load, mapping, registry, reverse_index, sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def docs(spark, d):
    return load(spark, d, "documents")


TOKENS = "list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+'), lambda t: len(t) >= {1}), lambda t: lower(t)))"


@query("SELECT p_partkey, array_to_string(list_sort(" + TOKENS.format("p_name || 'XMLParser_' || p_type || 'fooBar'", 3) + "), ',') AS tokens FROM part")
def tokenize_symbol(spark, d):
    name = F.concat("p_name", F.lit("XMLParser_"), "p_type", F.lit("fooBar"))
    return load(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(X.tokenize(name)), ",").alias("tokens"))


@query("SELECT p_partkey FROM part WHERE list_has_any(" + TOKENS.format("p_name", 4) + ", ['widget', 'gear'])")
def token_overlap_filter(spark, d):
    wanted = F.array(F.lit("widget"), F.lit("gear"))
    return load(spark, d, "part").where(F.arrays_overlap(X.tokenize(F.col("p_name"), 4), wanted)).select("p_partkey")


PATHS = "CASE doc_id % 5 WHEN 0 THEN 'x/test_repository/' || source || '/a.js' WHEN 1 THEN 'lib/tests/' || lang || '.py' WHEN 2 THEN 'c:/test_repository' WHEN 3 THEN 'unit/' || lang || '.js' ELSE 'deep/src1/' || source || '.java' END"


def paths(spark, d):
    return docs(spark, d).select("doc_id", F.expr(f"{PATHS}").alias("path"))


@query(f"WITH p AS (SELECT doc_id, {PATHS} AS path FROM documents) SELECT doc_id, CASE WHEN contains(path, 'test_repository') THEN ltrim(substr(path, strpos(path, 'test_repository') + 15), '/') WHEN list_extract(string_split(path, '/'), -2) IN ('unit', 'integration', 'e2e', 'tests', 'test') THEN array_to_string(string_split(path, '/')[-2:], '/') ELSE list_extract(string_split(path, '/'), -1) END AS norm FROM p")
def normalize_path(spark, d):
    return paths(spark, d).select("doc_id", X.normalize_path(F.col("path")).alias("norm"))


@query("WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '@scope/' || source WHEN 1 THEN lang WHEN 2 THEN './lib/' || source || '.js' ELSE '../' || lang || '/' || source END AS spec FROM documents) SELECT doc_id, coalesce(CASE WHEN starts_with(spec, '@') OR NOT contains(spec, '/') THEN NULL ELSE regexp_extract(spec, '([^/]+?)(?:\\.[A-Za-z]+)?$', 1) END, '') AS stem FROM p")
def normalize_import(spark, d):
    spec = F.expr("CASE doc_id % 4 WHEN 0 THEN '@scope/' || source WHEN 1 THEN lang WHEN 2 THEN './lib/' || source || '.js' ELSE '../' || lang || '/' || source END")
    return docs(spark, d).select("doc_id", F.coalesce(X.normalize_import(spec), F.lit("")).alias("stem"))


FILE = "CASE doc_id % 4 WHEN 0 THEN 'src/' || source || '/' || lang || '.js' WHEN 1 THEN 'backend/client/' || lang || '.py' WHEN 2 THEN lang || '.ts' ELSE 'src/main/' || source || '/' || lang || '.java' END"


@query(f"""WITH p AS (SELECT doc_id, {FILE} AS path FROM documents), m AS (SELECT doc_id, path, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(path, '\\.[A-Za-z]+$', ''), '/', '.'), '^backend\\.', ''), '^client\\.', ''), '^src\\.', '') AS m FROM p)
SELECT doc_id, array_to_string(list_filter([m, CASE WHEN contains(m, '.') THEN string_split(m, '.')[1] END, CASE WHEN contains(m, '.') AND (path LIKE '%.js' OR path LIKE '%.ts') THEN string_split(m, '.')[-1] END], lambda x: x IS NOT NULL), ',') AS modules FROM m""")
def module_candidates(spark, d):
    return docs(spark, d).select("doc_id", F.expr(FILE).alias("path")).select("doc_id", F.array_join(X.module_candidates(F.col("path")), ",").alias("modules"))


@query(f"""WITH p AS (SELECT doc_id, {FILE} AS path FROM documents), s AS (SELECT doc_id, regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS stem, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS parent, regexp_extract(path, '([.][^./]+)$', 1) AS ext FROM p),
n AS (SELECT doc_id, ext, unnest(list_distinct([stem, CASE WHEN parent <> '' THEN parent || '_' || stem ELSE stem END])) AS n FROM s),
c AS (SELECT doc_id, unnest(CASE ext WHEN '.py' THEN ['test_' || n || '.py', n || '_test.py'] WHEN '.java' THEN [n || 'Test.java', n || 'Tests.java', n || 'Spec.java'] WHEN '.ts' THEN [n || '.test.ts', n || '.spec.ts', n || '.test.tsx', n || '.spec.tsx'] ELSE [n || '.test.js', n || '.spec.js', n || '.test.jsx', n || '.spec.jsx'] END) AS c FROM n)
SELECT doc_id, string_agg(c, ',' ORDER BY c) AS names FROM c GROUP BY 1""")
def test_file_candidates(spark, d):
    return docs(spark, d).select("doc_id", F.expr(FILE).alias("path")).select("doc_id", F.array_join(X.test_file_candidates(F.col("path")), ",").alias("names"))


@query("SELECT doc_id, CASE WHEN length(text) <= 350 THEN text ELSE left(text, 200) || ' ... ' || right(text, 150) END AS short_text, left(coalesce(lang, ''), 50) AS ref_type FROM documents")
def truncate_text(spark, d):
    return docs(spark, d).select("doc_id", X.head_tail(F.col("text"), 200, 150).alias("short_text"), F.substring(F.coalesce("lang", F.lit("")), 1, 50).alias("ref_type"))


LABEL = "CASE p_size % 5 WHEN 0 THEN p_name || ' with ' || p_type WHEN 1 THEN p_name || ' → ' || p_brand || ' > x' WHEN 2 THEN p_name || ': ' || p_type WHEN 3 THEN ' ' || p_name || ' > ' || p_type || ' ' ELSE p_brand || ' — ' || p_name END"


@query(f"SELECT p_partkey, CASE p_size % 5 WHEN 2 THEN p_name || ': ' || p_type WHEN 4 THEN p_brand ELSE p_name END AS head, replace(replace('test_' || replace(p_name, ' ', '_'), 'test_', ''), '_', ' ') AS title FROM part")
def describe_label_enrich(spark, d):
    name = F.concat(F.lit("test_"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return load(spark, d, "part").select("p_partkey", X.label_head(F.expr(LABEL)).alias("head"), X.readable(name).alias("title"))


@query("SELECT doc_id, length(text) AS size, len(string_split(text, chr(10))) AS n_lines, lang AS language FROM documents")
def file_metadata(spark, d):
    return docs(spark, d).select("doc_id", F.length("text").cast("long").alias("size"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.col("lang").alias("language"))


@query(sql(REGISTRY) + "SELECT left(sha256(file_path || '#' || test_id), 16) AS file_id, file_path, len(string_split(text, chr(10))) AS line_count, sha256(text) AS content_sha FROM registry JOIN documents ON doc_id = test_id")
def file_source(spark, d):
    body = docs(spark, d).select(F.col("doc_id").alias("test_id"), F.size(F.split("text", "\n", -1)).cast("long").alias("line_count"), F.sha2("text", 256).alias("content_sha"))
    return registry(spark, d).join(body, "test_id").select(F.left(F.sha2(F.concat("file_path", F.lit("#"), F.col("test_id").cast("string")), 256), F.lit(16)).alias("file_id"), "file_path", "line_count", "content_sha")


@query("SELECT doc_id, i::INT AS chunk_no, substr(text, i * 500 + 1, 500) AS chunk FROM documents, range(0, greatest(length(text) - 1, 0) // 500 + 1) r(i)")
def chunk_fixed(spark, d):
    return docs(spark, d).select("doc_id", F.explode(X.fixed_chunks(F.col("text"), 500)).alias("c")).select("doc_id", "c.chunk_no", "c.chunk")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total_k FROM events GROUP BY 1")
def json_props(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k long")["k"]).alias("total_k"))


#: A diff made of a document: lines get headers and signs from their numbers, some are declarations or guards.
LINE = """CASE WHEN line_no % 7 = 0 THEN 'diff --git a/f' || line_no || '.' || CASE (line_no + doc_id) % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'md' ELSE 'js' END || ' b/f' || line_no || '.' || CASE (line_no + doc_id) % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'md' ELSE 'js' END
 WHEN line_no % 7 = 1 THEN CASE (line_no + doc_id) % 5 WHEN 0 THEN 'new file mode 100644' WHEN 1 THEN 'deleted file mode 100644' ELSE 'index 1..2' END
 WHEN line_no % 7 = 2 THEN '@@ -' || (line_no * doc_id) % 90 || ',3 +' || (line_no * doc_id) % 95 || ',4 @@ f()'
 WHEN line_no % 7 = 3 AND doc_id % 4 = 0 THEN ' context'
 WHEN line_no % 5 = 0 AND doc_id % 3 = 0 THEN '-export const v' || line_no % 4 || ' = 1' WHEN line_no % 5 = 1 AND doc_id % 3 = 0 THEN '+  export const v' || line_no % 6 || ' = 1'
 WHEN line_no % 5 = 0 AND doc_id % 3 = 1 THEN '+function f' || line_no % 4 || '() {' WHEN line_no % 5 = 1 AND doc_id % 3 = 1 THEN '-class C' || line_no % 6 || ' {'
 WHEN line_no % 5 = 2 AND doc_id % 5 = 1 THEN '+if (x' || line_no || ' == null) return;' WHEN line_no % 5 = 3 AND doc_id % 7 = 2 THEN '-name' || line_no % 3 || ': 1'
 WHEN line_no % 2 = 0 AND doc_id % 6 <> 5 THEN '+' || {0} ELSE '-' || {0} END"""
DIFF = f"""t AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS line_no, unnest(string_split(text, chr(10))) AS body FROM documents),
l AS (SELECT doc_id, line_no, {LINE.replace('{0}', 'body')} AS line FROM t)"""
ADDED, REMOVED = "(starts_with(line, '+') AND NOT starts_with(line, '+++'))", "(starts_with(line, '-') AND NOT starts_with(line, '---'))"


def diff_lines(spark, d):
    return D.lines(docs(spark, d), "doc_id", "text").select("doc_id", "line_no", F.expr(LINE.replace("{0}", "line")).alias("line"))


def diff_bodies(spark, d):
    """diff_id, body: the same lines as whole diffs."""
    lines = F.expr("transform(split(text, '\\n'), (line, line_no) -> " + LINE.replace("{0}", "line") + ")")
    return docs(spark, d).select(F.col("doc_id").alias("diff_id"), F.array_join(lines, "\n").alias("body"))


@query(sql(DIFF) + f"SELECT doc_id, count(*) FILTER {ADDED} AS additions, count(*) FILTER {REMOVED} AS deletions FROM l GROUP BY 1".replace(f"FILTER {ADDED}", f"FILTER (WHERE {ADDED})").replace(f"FILTER {REMOVED}", f"FILTER (WHERE {REMOVED})"))
def diff_stats(spark, d):
    return diff_lines(spark, d).groupBy("doc_id").agg(F.count_if(D.added()).alias("additions"), F.count_if(D.removed()).alias("deletions"))


FILE_OF = ", f AS (SELECT *, last_value(CASE WHEN starts_with(line, 'diff --git') THEN regexp_extract(line, ' b/([^ ]+)', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS file FROM l)"
STATUS = "CASE WHEN bool_or(starts_with(line, 'new file')) THEN 'added' WHEN bool_or(starts_with(line, 'deleted file')) THEN 'deleted' ELSE 'modified' END"


@query(sql(DIFF) + FILE_OF + f"""
SELECT doc_id, file, {STATUS} AS status, count(*) FILTER (WHERE {ADDED}) AS additions, count(*) FILTER (WHERE {REMOVED}) AS deletions, count(*) FILTER (WHERE starts_with(line, '@@')) AS hunks FROM f WHERE file IS NOT NULL GROUP BY 1, 2""")
def diff_file_stats(spark, d):
    return D.file_stats(diff_lines(spark, d), "doc_id")


def first_name(patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(line, '{p}', 1), '')" for p in patterns) + ")"


#: The next four lines of a removed constant, in order: its new name, or what ends the search.
RENAMED = """r AS (SELECT doc_id, line_no, regexp_extract(line, '^-\\s*export\\s+const\\s+([A-Za-z_]\\w*)', 1) AS old FROM l WHERE starts_with(line, '-') AND NOT starts_with(line, '---')),
n AS (SELECT r.doc_id, r.line_no, old, l.line_no AS pos, regexp_extract(line, '^\\+\\s*export\\s+const\\s+([A-Za-z_]\\w*)', 1) AS new, (trim(line) <> '' AND NOT regexp_matches(line, '^[-+@]')) OR starts_with(line, '---') AS ends FROM r JOIN l ON l.doc_id = r.doc_id AND l.line_no BETWEEN r.line_no + 1 AND r.line_no + 4 WHERE old <> ''),
m AS (SELECT doc_id, old, arg_min(new, pos) AS new FROM n WHERE new <> '' OR ends GROUP BY doc_id, line_no, old HAVING arg_min(new, pos) NOT IN ('', old))"""


@query(sql(DIFF, RENAMED) + "SELECT doc_id, old, new FROM m")
def symbol_renames(spark, d):
    return D.renames(diff_lines(spark, d), "doc_id")


@query(sql(DIFF, RENAMED) + f""", s AS (SELECT doc_id, unnest([{first_name(K.DECLARATIONS)}, nullif(regexp_extract(line, '{K.PROPERTY}', 1), '')]) AS symbol, {ADDED} AS a FROM l WHERE {ADDED} OR {REMOVED}),
c AS (SELECT doc_id, symbol, bool_and(a) AS came FROM s WHERE symbol IS NOT NULL GROUP BY 1, 2 HAVING bool_and(a) OR NOT bool_or(a))
SELECT doc_id, symbol, CASE WHEN came THEN 'added' ELSE 'deleted' END AS change FROM c WHERE CASE WHEN came THEN (doc_id, symbol) NOT IN (SELECT (doc_id, new) FROM m) ELSE (doc_id, symbol) NOT IN (SELECT (doc_id, old) FROM m) END""")
def symbol_delta(spark, d):
    return D.symbol_delta(diff_lines(spark, d), "doc_id", K.DECLARATIONS, K.PROPERTY)


#: Numbers of changed lines: in the new file for added ones, in the old one for removed ones.
NUMBERED = f"""h AS (SELECT *, count(*) FILTER (WHERE starts_with(line, '@@')) OVER (PARTITION BY doc_id ORDER BY line_no) AS hunk FROM f),
k AS (SELECT *, max(try_cast(nullif(regexp_extract(line, '^@@ -([0-9]+)', 1), '') AS INT)) OVER w AS old_at, max(try_cast(nullif(regexp_extract(line, '^@@ -[0-9,]+ [+]([0-9]+)', 1), '') AS INT)) OVER w AS new_at,
  count(*) FILTER (WHERE {ADDED} OR starts_with(line, ' ')) OVER b AS n_new, count(*) FILTER (WHERE {REMOVED} OR starts_with(line, ' ')) OVER b AS n_old FROM h
  WINDOW w AS (PARTITION BY doc_id, hunk), b AS (PARTITION BY doc_id, hunk ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT doc_id, file, {STATUS} AS status, count(*) FILTER (WHERE {ADDED}) AS plus, coalesce(bool_or(regexp_extract(line, '\\b(?:class|interface|enum|def|function)\\s+([A-Za-z_]\\w*)', 1) <> '') FILTER (WHERE {ADDED} OR {REMOVED}), false) AS symbols,
  max(CASE WHEN {ADDED} THEN new_at + n_new WHEN {REMOVED} THEN old_at + n_old END) AS last_line FROM k WHERE file IS NOT NULL GROUP BY 1, 2)"""


@query(sql(DIFF) + FILE_OF + f""", {NUMBERED}
SELECT doc_id, file, CASE WHEN status <> 'modified' THEN status WHEN NOT symbols AND plus = 0 THEN 'comment_only' WHEN NOT symbols AND last_line <= 50 THEN 'import_only' ELSE 'code' END AS change_type FROM c""")
def change_type(spark, d):
    return D.change_type(diff_lines(spark, d), "doc_id")


SOURCES = "('.py', '.java', '.js', '.ts', '.tsx', '.jsx', '.c', '.cpp', '.cc', '.h', '.hpp', '.go', '.rb', '.cs', '.kt')"
SCENARIO = f"""sc AS (SELECT doc_id, count(DISTINCT file) AS n_files, count(DISTINCT lower(regexp_extract(file, '([.][^./]+)$', 1))) FILTER (WHERE lower(regexp_extract(file, '([.][^./]+)$', 1)) IN {SOURCES}) AS n_source_kinds,
 count(DISTINCT nullif(regexp_extract(line, '\\b(?:class|interface|enum|def|function)\\s+([A-Za-z_]\\w*)', 1), '')) FILTER (WHERE {ADDED} OR {REMOVED}) AS n_exact, count(DISTINCT nullif(regexp_extract(line, '\\b(?:def|function)\\s+([A-Za-z_]\\w*)', 1), '')) FILTER (WHERE {ADDED} OR {REMOVED}) AS n_fn,
 count(*) FILTER (WHERE {ADDED}) AS n_plus, count(*) FILTER (WHERE {ADDED} AND regexp_matches(line, '{D.GUARD}')) AS n_guard FROM f GROUP BY 1)"""
TAGS = """list_filter([CASE WHEN n_source_kinds > 1 THEN 'MIXED_LANGUAGE_DIFF' END, CASE WHEN n_files >= 12 OR (n_exact >= 20 AND n_files >= 5) THEN 'MAXIMUM_BLAST_RADIUS' WHEN n_files <= 1 AND n_exact <= 4 AND n_fn <= 2 THEN 'TIGHT_FEATURE_ISOLATION' END,
 CASE WHEN n_plus BETWEEN 1 AND 20 AND n_guard >= greatest(2, floor(0.45::DOUBLE * n_plus)) THEN 'MICRO_GUARD_HOTFIX' END, CASE WHEN n_fn >= 1 THEN 'SYMBOL_LEVEL_CHANGES' END], lambda x: x IS NOT NULL)"""


@query(sql(DIFF) + FILE_OF + f", {SCENARIO} SELECT doc_id, array_to_string({TAGS}, ',') AS tags FROM sc")
def scenario_tags(spark, d):
    return D.scenario(diff_lines(spark, d), "doc_id", K.SOURCE).select("doc_id", F.concat_ws(",", D.scenario_tags()).alias("tags"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, d):
    return M.latest(load(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def first_wins(spark, d):
    return M.latest(load(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id", "event_type"], [F.asc("event_id")])


@query("SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.quality, o.n_chars % 2) AS quality FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 2 = 0) o FULL JOIN labels n ON n.doc_id = o.doc_id")
def upsert_coalesce(spark, d):
    old = docs(spark, d).where("doc_id % 2 = 0").selectExpr("doc_id", "n_chars % 2 as quality")
    return M.upsert_coalesce(old, load(spark, d, "labels"), "doc_id", ["quality"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def delete_antijoin(spark, d):
    gone = load(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return M.delete(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), gone, "l_orderkey")


REFERENCES = [("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("events", "user_id", "customer", "c_custkey")]


@query("""WITH c AS (SELECT * FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)), gone AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)),
o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)), lost AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
SELECT 'nation' AS relation, count(*) AS n_left, sum(n_nationkey)::BIGINT AS key_sum FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'customer', count(*), sum(c_custkey)::BIGINT FROM c
UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM o UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM lost)
UNION ALL SELECT 'events', count(*), sum(user_id)::BIGINT FROM events WHERE user_id IS NULL OR user_id NOT IN (SELECT c_custkey FROM gone)""")
def cascade_delete(spark, d):
    """What a delete of one region's nations leaves of the relations that refer to them, over four references."""
    names = {"nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "user_id"}
    relations = {n: load(spark, d, n) for n in names}
    left = W.cascade(relations, REFERENCES, "nation", relations["nation"].where("n_regionkey = 1").select("n_nationkey"))
    return S.union_all([df.agg(F.count("*").alias("n_left"), F.sum(names[n]).alias("key_sum")).select(F.lit(n).alias("relation"), "n_left", "key_sum") for n, df in left.items()])


@query("SELECT c_custkey, c_nationkey, c_custkey = max(c_custkey) OVER (PARTITION BY c_nationkey) AS is_primary FROM customer")
def exclusive_flag(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    return M.exclusive_flag(c, "c_nationkey", "c_custkey", c.groupBy("c_nationkey").agg(F.max("c_custkey").alias("c_custkey")))


@query("SELECT doc_id, 'test_' || lpad(n::VARCHAR, greatest(4, len(n::VARCHAR))::INT, '0') AS new_id FROM (SELECT doc_id, (SELECT count(*) FROM orders) + row_number() OVER (ORDER BY doc_id) AS n FROM documents)")
def id_allocate(spark, d):
    """New ids for all documents, after those that orders hold."""
    last = load(spark, d, "orders").agg(F.count("*").alias("last_id"))
    return M.allocate(docs(spark, d).select("doc_id"), "doc_id", last).select("doc_id", "new_id")


@query("SELECT s_suppkey, n_name, coalesce(r_name, 'none') AS r_name, s_acctbal > 0 AS is_primary, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal > 0 DESC, s_acctbal DESC, s_suppkey)::INT AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_name <> 'ASIA'")
def bindings_join(spark, d):
    s, n, r = load(spark, d, "supplier"), load(spark, d, "nation"), load(spark, d, "region").where("r_name <> 'ASIA'")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = rows.select("s_suppkey", "n_name", F.coalesce("r_name", F.lit("none")).alias("r_name"), (F.col("s_acctbal") > 0).alias("is_primary"), "s_acctbal")
    # the primary one first, then by what stands for the time of upload
    order = Window.partitionBy("n_name").orderBy(F.desc("is_primary"), F.desc("s_acctbal"), "s_suppkey")
    return rows.withColumn("place", F.row_number().over(order)).drop("s_acctbal")


@query(sql(RI, TFM) + "SELECT DISTINCT test_id, production_class AS reference FROM ri UNION SELECT DISTINCT test_id, module_name || '.' || function_name FROM tfm")
def reference_union(spark, d):
    a = reverse_index(spark, d).select("test_id", F.col("production_class").alias("reference"))
    return a.unionByName(mapping(spark, d).select("test_id", F.concat_ws(".", "module_name", "function_name").alias("reference"))).distinct()


@query("""WITH a AS (SELECT 0 AS rank, 'docs' AS namespace, doc_id AS test_id, source AS name, 'exact' AS kind FROM documents UNION ALL SELECT 1, 'pages', page_id, left(url, 12), 'module' FROM pages UNION ALL SELECT 2, 'turns', conv_id, role, 'semantic' FROM conversations)
SELECT test_id, arg_min(namespace, (rank, name)) AS source_schema, arg_min(name, (rank, name)) AS name, count(*) AS n_evidence, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM a GROUP BY 1""")
def merge_schemas(spark, d):
    """Tests of several namespaces: the first one's row stands, the evidence of all of them is put together."""
    part = lambda t, rank, name, key, label, kind: load(spark, d, t).select(F.lit(rank).alias("rank"), F.lit(name).alias("namespace"), F.col(key).alias("test_id"), label.alias("name"), F.lit(kind).alias("kind"))
    rows = part("documents", 0, "docs", "doc_id", F.col("source"), "exact").unionByName(part("pages", 1, "pages", "page_id", F.left("url", F.lit(12)), "module")).unionByName(part("conversations", 2, "turns", "conv_id", F.col("role"), "semantic"))
    first = F.min(F.struct("rank", "name", "namespace"))
    out = rows.groupBy("test_id").agg(first.alias("f"), F.count("*").alias("n_evidence"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    return out.select("test_id", F.col("f.namespace").alias("source_schema"), "f.name", "n_evidence", "kinds")


#: Answers of a model, made of turns of conversations: in a fence, among other text, with a bad escape, or none.
ANSWER = """CASE turn % 4 WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || '{"n": {"x": 1}, "variations": ["' || w || '", " ' || role || ' ", ""]}' || chr(10) || '```'
WHEN 1 THEN 'ok {"a": 1} and {"why": "' || role || '", "variations": ["' || w || chr(92) || 's+"]} bye' WHEN 2 THEN 'no list: ' || w ELSE '{"variations": ["' || w || '"' END"""
WORDS = "SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' '{g})) AS w FROM conversations"


@query(f"""WITH c AS ({WORDS.format(g=", 'g'")}) SELECT conv_id, turn, array_to_string(list_filter(CASE turn % 4 WHEN 0 THEN [w, role] WHEN 1 THEN [w || chr(92) || 's+'] ELSE [] END, lambda v: v <> ''), ';') AS variations FROM c""")
def rewritten_queries(spark, d):
    """The lists in a model's answers."""
    rows = load(spark, d, "conversations").selectExpr("conv_id", "turn", "role", "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ')) as w")
    return rows.select("conv_id", "turn", F.array_join(J.listed(F.expr(ANSWER)), ";").alias("variations"))


@query("""WITH n AS (SELECT doc_id AS test_id, lang AS description, CASE WHEN doc_id % 3 = 0 THEN '[' || '"' || source || '","slow"]' END AS markers, coalesce(CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 = 0 END, false) AS is_async FROM documents),
o AS (SELECT doc_id + 3 AS test_id, 'old' AS description, NULL AS markers, false AS is_async FROM labels)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE test_id NOT IN (SELECT test_id FROM n)""")
def metadata_upsert(spark, d):
    """New metadata replaces all of a test's; markers as JSON, or null where there are none; missing flags are false."""
    none = F.array().cast("array<string>")
    new = docs(spark, d).select(F.col("doc_id").alias("test_id"), F.col("lang").alias("description"), F.when(F.col("doc_id") % 3 == 0, F.array("source", F.lit("slow"))).otherwise(none).alias("markers"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 4 == 0).alias("is_async"))
    old = load(spark, d, "labels").select((F.col("doc_id") + 3).alias("test_id"), F.lit("old").alias("description"), none.alias("markers"), F.lit(None).cast("boolean").alias("is_async"))
    both = old.withColumn("__at", F.lit(0)).unionByName(new.withColumn("__at", F.lit(1)))
    rows = M.latest(both, ["test_id"], [F.desc("__at")])
    return rows.select("test_id", "description", F.when(F.size("markers") > 0, F.to_json("markers")).alias("markers"), F.coalesce("is_async", F.lit(False)).alias("is_async"))
