"""Structural lookups on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import change as K
from ..operators import grams as G
from ..operators import lookup as L
from ..operators import stats as S
from .tables import ENT, REGISTRY, RI, TFM, dictionary, entities, load, mapping, registry, reverse_index, small, sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TERMS = ["promo", "promo.brand5", "small_widget", "no_such_symbol"]
FUNCTIONS = [("promo", "brand4"), ("small", "brand10")]
CLASS, OTHER = "promo.brand15.hot_widget", "promo.brand25.blue_ring"


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def terms(spark, values=TERMS):
    return small(spark, [(v,) for v in values], "term string")


def function_terms(spark):
    return small(spark, FUNCTIONS, "module_name string, function_name string")


TERM_CTE = "terms AS (SELECT unnest(['" + "', '".join(TERMS) + "']) AS term)"
FN_CTE = "fn AS (SELECT * FROM (VALUES ('promo', 'brand4'), ('small', 'brand10')) v(module_name, function_name))"
MATCH = "CASE WHEN production_class = term THEN 1 WHEN starts_with(production_class, term || '.') THEN 2 WHEN ends_with(production_class, '.' || term) THEN 3 END"
LOOKUP_CTE = f"""sl AS (SELECT DISTINCT term, test_id, production_class, reference_type, kind FROM (SELECT *, {MATCH} AS kind FROM ri, terms) WHERE kind IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY term, test_id ORDER BY kind, CASE reference_type WHEN 'string_ref' THEN 0 ELSE 1 END, reference_type, production_class) = 1)"""
FL_CTE = """fl AS (SELECT t.test_id, e.test_type, t.source, t.priority FROM (SELECT DISTINCT test_id, source, CASE source WHEN 'patch_ref' THEN 1 ELSE 2 END AS priority FROM tfm JOIN fn USING (module_name, function_name)
  QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY priority, source) = 1) t JOIN ent e USING (test_id))"""


@query(sql(RI, TERM_CTE) + f"SELECT term, symbol, kind FROM (SELECT DISTINCT term, production_class AS symbol, {MATCH} AS kind FROM ri, terms) WHERE kind IS NOT NULL")
def symbol_match(spark, d):
    return L.match_symbols(reverse_index(spark, d), "production_class", terms(spark))


@query(sql(RI, TERM_CTE, LOOKUP_CTE) + "SELECT * FROM sl")
def symbol_lookup(spark, d):
    return L.lookup_symbols(reverse_index(spark, d), terms(spark))


@query(sql(TFM, ENT, FN_CTE, FL_CTE) + "SELECT * FROM fl")
def function_level(spark, d):
    return L.function_level(mapping(spark, d), entities(spark, d), function_terms(spark))


BELOW = "('direct_import', 'string_ref', 'transitive_import', 'transitive_normalized')"
KINDS = "('direct_import', 'string_ref', 'transitive_import', 'transitive_normalized', 'source_annotation', 'source_annotation_normalized')"
REF = "CASE WHEN reference_type IN ('direct_import', 'string_ref') THEN 1 WHEN reference_type IN ('transitive_import', 'transitive_normalized') THEN 2 ELSE 3 END AS ref_priority"


@query(sql(RI) + f"SELECT DISTINCT test_id, production_class, reference_type, CASE production_class WHEN 'promo' THEN 1 ELSE 2 END AS exact_priority, {REF} FROM ri WHERE production_class = 'promo' OR (starts_with(production_class, 'promo.') AND reference_type IN {BELOW})")
def module_pattern(spark, d):
    return L.module_pattern(reverse_index(spark, d), "promo")


@query(sql(RI) + f"SELECT DISTINCT test_id, production_class, reference_type, CASE production_class WHEN 'promo' THEN 1 ELSE 2 END AS exact_priority, {REF} FROM ri WHERE production_class = 'promo' OR (starts_with(production_class, 'promo.') AND reference_type IN {BELOW}) ORDER BY exact_priority, ref_priority, test_id, production_class, reference_type LIMIT 50")
def module_ranked(spark, d):
    """The fifty surest tests of a module: by how they refer to it, then by id."""
    return L.module_pattern(reverse_index(spark, d), "promo").orderBy("exact_priority", "ref_priority", "test_id", "production_class", "reference_type").limit(50)


@query(sql(RI) + f"SELECT DISTINCT test_id, production_class, reference_type, CASE WHEN production_class = '{OTHER}' THEN 1 ELSE 2 END AS exact_priority, {REF} FROM ri WHERE production_class IN ('{CLASS}', 'small.brand25.new_gear') OR (production_class = '{OTHER}' AND reference_type IN {KINDS})")
def module_pattern_specific(spark, d):
    return L.module_pattern(reverse_index(spark, d), OTHER, "specific", (CLASS, "small.brand25.new_gear"))


@query(sql(RI) + "SELECT DISTINCT test_id, production_class, reference_type FROM ri WHERE starts_with(production_class, 'promo.')")
def module_pattern_broad(spark, d):
    return L.module_pattern(reverse_index(spark, d), "promo", "broad")


@query(sql(RI, ENT) + f"SELECT DISTINCT test_id, test_type, reference_type FROM ri JOIN ent USING (test_id) WHERE production_class = '{CLASS}' AND test_type IN ('integration', 'e2e')")
def integration_lookup(spark, d):
    return L.integration_lookup(reverse_index(spark, d), entities(spark, d), CLASS)


#: A changed file, names that its tests may have, and a module: each gives a strategy, in this order.
CANDIDATES, MODULE_BASE, FILE_STEM = ("doc_1.test.js", "test_src3_*.py"), "doc_2", "doc_7"


@query(sql(REGISTRY) + """SELECT test_id, file_path, strategy, strategy_ord FROM (SELECT *, CASE WHEN file_path LIKE '%doc_1.test.js' OR file_path LIKE '%test_src3_.py' THEN 0 WHEN file_path LIKE '%test_src3_%' OR file_path LIKE '%test_%src3%' THEN 1 WHEN file_path LIKE '%test_doc_2%' OR file_path LIKE '%doc_2%' THEN 2 WHEN file_path LIKE '%doc_7%' THEN 3 END AS strategy_ord,
 ['exact_filename', 'pattern_match', 'module_basename', 'file_path_based'][strategy_ord + 1] AS strategy FROM registry) WHERE strategy_ord IS NOT NULL""")
def direct_file_lookup(spark, d):
    rows = registry(spark, d).select("test_id", "file_path")
    return L.first_strategy(rows, L.direct_strategies(F.col("file_path"), CANDIDATES, MODULE_BASE, FILE_STEM))


CHANGED_FILES = ("lib/DOC_1.js", "src/index.js", "src/de/Reducers.ts", "lib/doc_3.constants.js")


@query(sql(REGISTRY) + """SELECT DISTINCT test_id, file_path, stem FROM registry, (SELECT lower(regexp_extract(unnest(['lib/DOC_1.js', 'src/index.js', 'src/de/Reducers.ts', 'lib/doc_3.constants.js']), '([^/]+)[.][^./]+$', 1)) AS stem)
WHERE stem NOT IN ('index', 'main', 'app', 'config', 'types', 'utils', 'helpers', 'common', 'shared', 'base', 'reducer', 'reducers', 'actions', 'action', 'store', 'stores', 'state', 'selectors', 'selector',
'saga', 'sagas', 'epic', 'epics', 'service', 'services', 'middleware', 'middlewares', 'context', 'contexts', 'hooks', 'hook') AND (file_path ILIKE '%' || stem || '%.test%' OR file_path ILIKE '%' || stem || '%.spec%')""")
def file_stem_match(spark, d):
    rows = registry(spark, d).select("test_id", "file_path")
    hits = [rows.where(X.stem_match(F.col("file_path"), s)).withColumn("stem", F.lit(s)) for s in X.stems(CHANGED_FILES)]
    return S.union_all(hits).distinct()


@query(sql(REGISTRY) + "SELECT test_id, file_path FROM registry WHERE file_path ILIKE 'doc_3.test.js' OR file_path ILIKE '%/doc_3.test.js' OR file_path ILIKE '%en/doc_3.test.js'")
def path_tail_match(spark, d):
    return registry(spark, d).where(X.tail_match(F.col("file_path"), "lib/en/doc_3.test.js")).select("test_id", "file_path")


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), '(^|/)(tests?|__tests__)/|\\.(test|spec)\\.') THEN 'test' WHEN regexp_matches(lower(url), '\\.(html|js|py|java)([?#]|$)') THEN 'production' ELSE 'other' END AS kind FROM pages")
def path_classify(spark, d):
    return load(spark, d, "pages").select("page_id", X.classify_path(F.col("url")).alias("kind"))


KINDS_OF = """CASE p_partkey % 8 WHEN 0 THEN 'src/' || n || '.js' WHEN 1 THEN 'src/' || n || '.test.js' WHEN 2 THEN 'a' || chr(92) || 'Tests' || chr(92) || n || '.py' WHEN 3 THEN 'app/' || n || 'Test.py' WHEN 4 THEN 'build/' || n || '.java'
WHEN 5 THEN n || '/__tests__/x.ts' WHEN 6 THEN n || '.md' ELSE 'lib/' || n || '.SPEC.ts' END"""


@query(f"""WITH p AS (SELECT p_partkey, {KINDS_OF} AS path FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS n FROM part))
SELECT p_partkey, regexp_matches(replace(path, chr(92), '/'), '(?i)(\\.test\\.|\\.spec\\.|/__tests__/|/tests?/|test_repository[/]|\\.feature\\.test\\.)') OR regexp_matches(lower(path), '(\\.test\\.js|\\.spec\\.ts)$') AS is_test,
regexp_matches(path, '\\.(py|java|js|ts|jsx|tsx|kt|go|rb|cs)$') AND NOT lower(path) LIKE '%test.py' AND len(list_filter({list(K.SKIPPED)}, lambda s: contains(lower(path), s))) = 0 AS is_production FROM p""")
def path_kinds(spark, d):
    """Which paths are tests, and which are production code."""
    named = load(spark, d, "part").selectExpr("p_partkey", "replace(p_name, ' ', '_') as n")
    path = F.expr(KINDS_OF)
    return named.withColumn("path", path).select("p_partkey", X.is_test_path(F.col("path")).alias("is_test"), X.is_production_path(F.col("path"), K.PRODUCTION, K.SKIPPED).alias("is_production"))


@query(sql(REGISTRY) + ", seeds AS (SELECT test_id, file_path FROM registry WHERE class_name IN ('The', 'Des')) SELECT r.* FROM registry r WHERE file_path IN (SELECT file_path FROM seeds) AND test_id NOT IN (SELECT test_id FROM seeds)")
def colocated_expand(spark, d):
    r = registry(spark, d)
    return L.colocated(r, r.where(F.col("class_name").isin("The", "Des")).select("test_id")).select("test_id", "file_path", "class_name", "test_type", "language")


@query("""SELECT user_id, event_id, coalesce((SELECT arg_max(v.event_id, (v.ts, v.event_id)) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND (v.ts, v.event_id) < (e.ts, e.event_id)), -1) AS view_id FROM events e WHERE event_type = 'purchase'""")
def asof_label(spark, d):
    ev = load(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return L.last_before(ev, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "view", F.col("event_id")), "view_id").where("event_type = 'purchase'").select("user_id", "event_id", F.coalesce("view_id", F.lit(-1)).alias("view_id"))


@query("""SELECT conv_id, turn, coalesce((SELECT max(u.turn) FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user' AND u.turn < c.turn), (SELECT min(u.turn) FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user')) AS owner_turn FROM conversations c WHERE role = 'assistant'""")
def asof_owner(spark, d):
    turns = load(spark, d, "conversations").select("conv_id", "turn", "role")
    user = F.when(F.col("role") == "user", F.col("turn"))
    first = turns.groupBy("conv_id").agg(F.min(user).alias("__first"))
    rows = L.last_before(turns, "conv_id", ["turn"], user, "owner_turn").where("role = 'assistant'").join(first, "conv_id")
    return rows.select("conv_id", "turn", F.coalesce("owner_turn", "__first").alias("owner_turn"))


@query(sql(REGISTRY) + "SELECT r.file_path, c.language AS call, count(*) AS n FROM registry r JOIN (SELECT DISTINCT file_path, language FROM registry) c USING (file_path) GROUP BY 1, 2")
def file_call_fanout(spark, d):
    # calls of a file times tests of the file: sizes are multiplied instead of rows
    r = registry(spark, d)
    calls = r.select("file_path", F.col("language").alias("call")).distinct()
    return calls.join(r.groupBy("file_path").agg(F.count("*").alias("n")), "file_path")


EDGES = "edges AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT DISTINCT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


@query("WITH RECURSIVE " + EDGES + ", walk(node, depth) AS (SELECT 'p' || p_partkey, 0 FROM part WHERE p_partkey % 20 = 0 UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM walk GROUP BY 1")
def transitive_closure(spark, d):
    """What every twentieth part leads to, over all edges."""
    pair = lambda t, a, b: load(spark, d, t).select(F.expr(a).alias("src"), F.expr(b).alias("dst")).distinct()
    edges = pair("lineitem", "concat('p', l_partkey)", "concat('s', l_suppkey)").union(pair("supplier", "concat('s', s_suppkey)", "concat('n', s_nationkey)")).union(pair("nation", "concat('n', n_nationkey)", "concat('r', n_regionkey)"))
    return L.closure(edges, load(spark, d, "part").where("p_partkey % 20 = 0").select(F.expr("concat('p', p_partkey)").alias("node")))


@query(sql(REGISTRY) + "SELECT test_id, file_path, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM registry LEFT JOIN labels l ON l.doc_id = test_id")
def metadata_left_join(spark, d):
    lab = load(spark, d, "labels").withColumnRenamed("doc_id", "test_id")
    return registry(spark, d).join(lab, "test_id", "left").select("test_id", "file_path", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query(sql(RI, TERM_CTE) + f"SELECT term FROM terms WHERE NOT EXISTS (SELECT 1 FROM ri WHERE {MATCH} IS NOT NULL)")
def zero_coverage(spark, d):
    t = terms(spark)
    return t.join(L.match_symbols(reverse_index(spark, d), "production_class", t), "term", "left_anti")


GONE = "gone AS (SELECT * FROM (VALUES ('promo.brand15.hot_widget', 'deleted', 0), ('promo.brand1.red_rod', 'renamed', 1), ('small.brand25.new_gear', 'renamed', 1)) g(symbol, reason, p))"


@query(sql(RI, GONE) + "SELECT test_id, symbol, reason FROM ri JOIN gone ON production_class = symbol QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY p, reference_type, symbol) = 1")
def breakage_map(spark, d):
    ev = reverse_index(spark, d).select("test_id", F.col("production_class").alias("symbol"), F.lit("exact").alias("type"), F.col("reference_type").alias("seq"))
    return L.breakage(ev, small(spark, [(CLASS,)], "symbol string"), small(spark, [("promo.brand1.red_rod",), ("small.brand25.new_gear",)], "old string"))


@query(sql(RI, TERM_CTE, GONE) + f"""SELECT 'COMPLETELY_UNTESTED' AS kind, term AS symbol, 0::BIGINT AS n_tests FROM terms WHERE NOT EXISTS (SELECT 1 FROM ri WHERE {MATCH} IS NOT NULL)
UNION ALL SELECT upper(reason), symbol, count(DISTINCT test_id) FROM ri JOIN gone ON production_class = symbol GROUP BY 1, 2""")
def coverage_gaps(spark, d):
    gaps = zero_coverage(spark, d).select(F.lit("COMPLETELY_UNTESTED").alias("kind"), F.col("term").alias("symbol"), F.lit(0).cast("long").alias("n_tests"))
    gone = small(spark, [(CLASS, "DELETED"), ("promo.brand1.red_rod", "RENAMED"), ("small.brand25.new_gear", "RENAMED")], "symbol string, kind string")
    hit = reverse_index(spark, d).join(gone, F.col("production_class") == F.col("symbol")).groupBy("kind", "symbol").agg(F.countDistinct("test_id").alias("n_tests"))
    return gaps.unionByName(hit)


GENERIC = "('util', 'utils', 'index', 'main', 'test', 'tests', 'common', 'base', 'core', 'api', 'data', 'mock', 'helper', 'helpers', 'config', 'types', 'type')"
ZONES = ("src/promo/brand5.js", "lib/gizmo99.py", "utils.js", "hot_widget.ts")
SYMBOLS = ("promo.hot_widget", "zzz.gizmo99", "brand7", "x.api")
COVER = """c AS (SELECT name, (SELECT count(DISTINCT test_id) FROM ri WHERE len(list_filter(patterns, lambda p: production_class ILIKE p)) > 0) AS ri_n, (SELECT count(DISTINCT test_id) FROM tfm WHERE len(list_filter(patterns, lambda p: module_name ILIKE p)) > 0) AS tfm_n FROM z)
SELECT name, ri_n, tfm_n, CASE WHEN ri_n > 0 AND tfm_n > 0 THEN greatest(ri_n, tfm_n) ELSE ri_n + tfm_n END AS coverage, ri_n + tfm_n = 0 AS dead, bool_and(ri_n + tfm_n = 0) OVER () AS complete FROM c"""


@query(sql(RI, TFM) + f""", n AS (SELECT unnest({list(ZONES)}) AS name), x AS (SELECT name, regexp_extract(name, '([^/]+)[.][^./]+$', 1) AS stem, array_to_string(string_split(name, '/')[-2:], '/') AS tail FROM n),
z AS (SELECT name, list_concat(CASE WHEN contains(name, '/') AND len(tail) >= 5 THEN ['%' || tail || '%'] ELSE [] END, CASE WHEN len(stem) >= 4 AND lower(stem) NOT IN {GENERIC} THEN ['%' || stem || '%'] ELSE [stem || '.%', '%.' || stem] END) AS patterns FROM x), {COVER}""")
def dead_zone_files(spark, d):
    """Changed files that no test refers to."""
    z = small(spark, [(f,) for f in ZONES], "name string")
    stem = F.regexp_replace(X.basename(F.col("name")), r"\.[^.]*$", "")
    return _dead(spark, d, z.withColumn("patterns", X.dead_zone_patterns(stem, F.col("name"))))


@query(sql(RI, TFM) + f""", x AS (SELECT name, string_split(name, '.')[-1] AS last FROM (SELECT unnest({list(SYMBOLS)}) AS name)),
z AS (SELECT name, list_concat([name, name || '.%', '%.' || name], CASE WHEN last = name THEN [] WHEN len(last) >= 4 AND lower(last) NOT IN {GENERIC} THEN ['%' || last || '%'] ELSE [last || '.%', '%.' || last] END) AS patterns FROM x), {COVER}""")
def dead_zone_symbols(spark, d):
    z = small(spark, [(x,) for x in SYMBOLS], "name string")
    return _dead(spark, d, z.withColumn("patterns", X.symbol_patterns(F.col("name"))))


def _dead(spark, d, zones):
    """The dictionary's symbols meet the patterns by their rarest pieces; tests are counted by the symbols that matched."""
    every = zones.select("name", F.explode("patterns").alias("pattern"))

    def count(df, column, name):
        return df.join(G.ilike(dictionary(spark, d), column, every), column).groupBy("name").agg(F.countDistinct("test_id").alias(name))

    ri_n, tfm_n = count(reverse_index(spark, d), "production_class", "ri_n"), count(mapping(spark, d), "module_name", "tfm_n")
    rows = zones.select("name").join(ri_n, "name", "left").join(tfm_n, "name", "left").na.fill(0)
    both = (F.col("ri_n") > 0) & (F.col("tfm_n") > 0)
    rows = rows.withColumn("coverage", F.when(both, F.greatest("ri_n", "tfm_n")).otherwise(F.col("ri_n") + F.col("tfm_n"))).withColumn("dead", F.col("ri_n") + F.col("tfm_n") == 0)
    return rows.withColumn("complete", F.bool_and("dead").over(Window.partitionBy()))  # the stated names
