"""Evidence, scores, vectors, merges, and the flagship selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import change as K
from ..operators import lookup as L
from ..operators import reach
from ..operators import retrieval as B
from ..operators import score as C
from ..operators import vector as V
from .lookups import BELOW, FL_CTE, LOOKUP_CTE
from .tables import ENT, RI, TFM, entities, load, marked_index, sql
from .texts import TOKENS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def vectors(spark, d):
    return load(spark, d, "embeddings")


def probe(spark, d, where="vec_id % 20 = 0"):
    """The query set: every vector whose id is divisible by 20; the first weighs 1.0, the others 0.9."""
    w = F.when(F.col("vec_id") == 0, 1.0).otherwise(0.9)
    return vectors(spark, d).where(where).select(F.col("vec_id").alias("query_id"), w.alias("weight"), F.col("embedding").alias("q"))


SIM = """q AS (SELECT vec_id AS query_id, CASE vec_id WHEN 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS weight, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
sims AS (SELECT query_id, weight, vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS similarity FROM embeddings, q)"""
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sims)"


def top(spark, d, k):
    return B.nearest(vectors(spark, d), probe(spark, d), k)


@query(sql(SIM) + "SELECT query_id, vec_id, similarity FROM sims WHERE vec_id % 20 = 0")
def cosine_pair(spark, d):
    """The queries among themselves, pair by pair."""
    return V.similarities(vectors(spark, d).where("vec_id % 20 = 0"), probe(spark, d)).select("query_id", "vec_id", "similarity")


@query(sql(SIM, RANKED) + "SELECT query_id, vec_id, label, similarity, rank FROM ranked WHERE rank <= 10")
def vector_topk(spark, d):
    return top(spark, d, 10).select("query_id", "vec_id", "label", "similarity", "rank")


@query(sql(SIM) + "SELECT query_id, vec_id, similarity, least(floor(similarity * 100.0::DOUBLE), 60)::INT AS score FROM sims WHERE similarity >= 0.2")
def vector_threshold(spark, d):
    found = B.above(vectors(spark, d), probe(spark, d), 0.2)
    return found.select("query_id", "vec_id", "similarity", F.least(F.floor(F.col("similarity") * F.lit(100.0)), F.lit(60)).cast("int").alias("score"))


@query(sql(SIM, RANKED) + "SELECT query_id, vec_id, label, similarity, rank FROM ranked WHERE rank <= 40 AND similarity >= 0.05 AND (label IS NULL OR label = 2)")
def vector_filtered(spark, d):
    """The repository filter comes after top-k and threshold: fewer than k rows may be left."""
    best = top(spark, d, 40).where("similarity >= 0.05D")
    return V.of_repository(best, "label", 2).select("query_id", "vec_id", "label", "similarity", "rank")


@query(sql(SIM, RANKED) + ", c AS (SELECT *, round(sum(similarity) OVER (PARTITION BY query_id ORDER BY rank), 6) AS cum FROM ranked WHERE rank <= 50) SELECT query_id, vec_id, similarity, rank, cum FROM c WHERE cum <= 3.0")
def nucleus_topp(spark, d):
    return V.top_p(top(spark, d, 50), 3.0).select("query_id", "vec_id", "similarity", "rank", "cum")


@query(sql(SIM) + "SELECT vec_id, max(similarity) AS similarity, max(weight) AS weight, round(max(similarity) * max(weight), 8) AS ranked, floor(max(similarity) * 60.0::DOUBLE)::INT AS score FROM sims GROUP BY 1 ORDER BY ranked DESC, vec_id LIMIT 20")
def multi_query_search(spark, d):
    return V.fused(B.best_by_vector(vectors(spark, d), probe(spark, d))).orderBy(F.desc("ranked"), "vec_id").limit(20)


@query(sql(SIM) + "SELECT vec_id, round(similarity * weight, 8) AS ranked, similarity FROM sims QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(similarity * weight, 8) DESC, similarity DESC) = 1")
def multi_query_weighted(spark, d):
    return B.best_weighted(vectors(spark, d), probe(spark, d))


@query(sql(SIM, RANKED) + "SELECT query_id, round(avg(similarity), 4) AS avg_sim, max(similarity) AS max_sim, min(similarity) AS min_sim, CASE WHEN avg(similarity) >= 0.5 THEN 'summary' ELSE 'diff_anchor' END AS canonical FROM ranked WHERE rank <= 20 GROUP BY 1")
def query_validation(spark, d):
    """How well each query's own best twenty fit it, and which kind of query text that speaks for."""
    best = top(spark, d, 20).groupBy("query_id").agg(F.round(F.avg("similarity"), 4).alias("avg_sim"), F.max("similarity").alias("max_sim"), F.min("similarity").alias("min_sim"), F.avg("similarity").alias("__a"))
    return best.withColumn("canonical", F.when(F.col("__a") >= 0.5, "summary").otherwise("diff_anchor")).drop("__a")


#: The change that the selection is made for.
DIFF = """diff --git a/src/promo.js b/src/promo.js
--- a/src/promo.js
+++ b/src/promo.js
@@ -60,3 +60,3 @@ function brand4() {
 function brand4() {
-  return price(1);
+  return price(2);
 }
diff --git a/src/promo/brand15/hot_widget.js b/src/promo/brand15/hot_widget.js
--- a/src/promo/brand15/hot_widget.js
+++ b/src/promo/brand15/hot_widget.js
@@ -70,2 +70,3 @@
-export const old_gear = 1
+export const hot_gear = 1
+function handleUrgent() {
diff --git a/src/orders/cust_7.js b/src/orders/cust_7.js
--- a/src/orders/cust_7.js
+++ b/src/orders/cust_7.js
@@ -80,2 +80,2 @@ class OrderBook {
-class red_plate {
+  total = 2
"""
CHANGE = K.bundle(DIFF)
WEAK = reach.weak_modules(CHANGE)
LABEL_TOKENS, SYMBOL_TOKENS = CHANGE.tokens(wide=False), CHANGE.tokens()
NEAR = 0.45


def semantic_hits(spark, d):
    return V.similarities(vectors(spark, d), probe(spark, d, "vec_id = 0")).where("similarity >= 0.1D").selectExpr("vec_id * 3 as test_id", "similarity")


def evidence(spark, d):
    """All strategies' rows in one long table."""
    fits = {"label_fits": C.relevant(F.col("class_name"), LABEL_TOKENS), "symbol_fits": C.relevant(F.col("class_name"), SYMBOL_TOKENS)}
    return reach.evidence(marked_index(spark, d, reach.marks(CHANGE)), entities(spark, d), semantic_hits(spark, d), CHANGE, NEAR, fits)


def structural(spark, d):
    return evidence(spark, d).where("seq < 8")


def texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


NUL = "NULL::VARCHAR"
MODULE_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT test_id, 5, 'module', reference_type, NULL, NULL, NULL, {str(m.removesuffix('.*') in WEAK).lower()} FROM ri WHERE production_class = '{m.removesuffix('.*')}' OR (starts_with(production_class, '{m.removesuffix('.*')}.') AND reference_type IN {BELOW})"
    for m in CHANGE.modules
)
EV = f"""terms AS (SELECT unnest({texts(CHANGE.exact)}) AS term), {LOOKUP_CTE},
fn AS (SELECT unnest({texts(m for m, _ in CHANGE.functions)}) AS module_name, unnest({texts(f for _, f in CHANGE.functions)}) AS function_name), {FL_CTE},
sem AS (SELECT vec_id * 3 AS test_id, similarity FROM sims WHERE query_id = 0 AND similarity >= 0.1),
seeds AS (SELECT test_id FROM (SELECT test_id, upper(term) = term AND NOT regexp_matches(term, '^.?[0-9]') AS constant, list_contains({texts(CHANGE.module_exact)}, term) AS module FROM sl
UNION ALL SELECT test_id, false, false FROM fl) GROUP BY test_id HAVING NOT bool_and(constant) AND NOT bool_and(module)),
st AS (SELECT test_id, 1 AS seq, 'function_level' AS type, {NUL} AS reference_type, source, NULL::DOUBLE AS similarity, {NUL} AS match_strategy, false AS weak FROM fl
UNION ALL SELECT test_id, 2, 'direct_file', NULL, NULL, NULL, 'exact_filename', false FROM ent WHERE len(list_filter({texts(CHANGE.test_files)}, lambda n: file_path LIKE '%' || n)) > 0
UNION ALL SELECT DISTINCT test_id, 3, 'integration', reference_type, NULL, NULL, NULL, false FROM ri JOIN ent USING (test_id) WHERE list_contains({texts(m[0] for m in map(K.modules, CHANGE.files) if m)}, production_class) AND test_type IN ('integration', 'e2e')
UNION ALL SELECT test_id, 4, 'exact', reference_type, NULL, NULL, NULL, list_contains({texts(WEAK)}, term) FROM sl
UNION ALL {MODULE_SQL}
UNION ALL SELECT test_id, 6, 'direct_file', NULL, NULL, NULL, 'colocated_in_same_file', false FROM ent WHERE file_path IN (SELECT file_path FROM ent JOIN seeds USING (test_id)) AND test_id NOT IN (SELECT test_id FROM seeds)
UNION ALL SELECT test_id, 7, 'direct_file', NULL, NULL, NULL, 'file_stem', false FROM ent WHERE len(list_filter({texts(X.stems(CHANGE.files))}, lambda n: file_path ILIKE '%' || n || '%.test%' OR file_path ILIKE '%' || n || '%.spec%')) > 0),
fit AS (SELECT test_id, file_path, coalesce(class_name, '') = '' OR list_has_any({TOKENS.format('class_name', 4)}, {texts(LABEL_TOKENS)}) AS label_fits,
  coalesce(class_name, '') = '' OR list_has_any({TOKENS.format('class_name', 4)}, {texts(SYMBOL_TOKENS)}) AS symbol_fits FROM ent),
near AS (SELECT test_id FROM fit WHERE label_fits AND file_path IN (SELECT file_path FROM ent JOIN (SELECT test_id FROM st UNION SELECT test_id FROM sem WHERE similarity >= 0.45) USING (test_id)) AND test_id NOT IN (SELECT test_id FROM sem)),
ev AS (SELECT * FROM st UNION ALL SELECT test_id, 8, 'semantic', NULL, NULL, similarity, NULL, false FROM sem UNION ALL SELECT test_id, 9, 'semantic_colocation', NULL, NULL, NULL, 'semantic_colocated_file', false FROM near)"""


def value(transitive: int) -> str:
    return f"""CASE type WHEN 'function_level' THEN CASE source WHEN 'patch_ref' THEN 95 ELSE 85 END
 WHEN 'exact' THEN CASE WHEN reference_type = 'direct_import' THEN 75 WHEN reference_type = 'string_ref' THEN 65 WHEN starts_with(reference_type, 'transitive_') THEN {transitive} ELSE 60 END
 WHEN 'direct_file' THEN 50 WHEN 'integration' THEN 40 WHEN 'module' THEN CASE reference_type WHEN 'direct_import' THEN 55 ELSE 45 END ELSE 0 END"""


PROFILE = f"""v AS (SELECT *, {value(58)} AS val, {value(60)} AS val1 FROM ev),
p AS (SELECT test_id, max(val) AS base, max(val1) AS base_v1, count(DISTINCT type) AS n_types, arg_min(type, (seq, coalesce(reference_type, ''))) FILTER (val > 0) AS first_base, coalesce(max(floor(similarity * 100.0::DOUBLE)), 0)::INT AS vec, count(*) AS n_evidence,
 bool_or(type = 'function_level') AS fn, bool_or(type = 'exact') AS ex, bool_or(type = 'direct_file') AS df, bool_or(type = 'integration') AS integ, bool_or(type = 'module') AS mo, bool_or(type = 'semantic') AS se, bool_or(type IN ('semantic', 'semantic_colocation')) AS sx, bool_or(type NOT IN ('semantic', 'semantic_colocation') AND NOT weak) AS strong, bool_or(type = 'semantic_colocation') AS sem_coloc,
 coalesce(bool_or(type <> 'semantic' AND reference_type = 'direct_import'), false) AS direct, bool_and(coalesce(match_strategy = 'colocated_in_same_file', false)) FILTER (type <> 'semantic') AS coloc_only FROM v GROUP BY 1),
a AS (SELECT p.*, e.test_type, label_fits, symbol_fits, greatest(0, least(100, base + CASE WHEN fn THEN 10 ELSE 0 END + CASE WHEN n_types > 1 THEN 5 ELSE 0 END - CASE WHEN first_base = 'module' THEN 10 ELSE 0 END - CASE WHEN fn OR ex THEN 0 ELSE 5 END + CASE e.test_type WHEN 'unit' THEN 5 WHEN 'integration' THEN 3 ELSE 0 END)) AS ast,
 greatest(0, least(100, base_v1 + CASE WHEN fn THEN 10 ELSE 0 END + CASE WHEN n_types > 1 THEN 5 ELSE 0 END - CASE WHEN first_base = 'module' THEN 10 ELSE 0 END - CASE WHEN fn OR ex THEN 0 ELSE 5 END + CASE e.test_type WHEN 'unit' THEN 5 WHEN 'integration' THEN 3 ELSE 0 END)) AS ast1
 FROM p JOIN ent e USING (test_id) JOIN fit USING (test_id)),
s AS (SELECT *, greatest(0, least(100, CASE WHEN df AND vec = 0 THEN greatest(floor(ast * 0.6::DOUBLE + vec * 0.4::DOUBLE), 45) ELSE floor(ast * 0.6::DOUBLE + vec * 0.4::DOUBLE) END))::INT AS score, fn OR ex OR df OR integ OR mo AS structural FROM a)"""
ALL = sql(RI, TFM, ENT, SIM, EV, PROFILE)


def profiled(spark, d):
    return C.profile(evidence(spark, d), "test_type", "known", "label_fits", "symbol_fits").where("known")


def kept():
    return C.keep(F.col("label_fits"), F.col("symbol_fits"))


def scored(spark, d):
    return C.confidence(profiled(spark, d))


@query(ALL + ", q2 AS (SELECT test_id, max(similarity) AS similarity FROM (SELECT vec_id * 3 AS test_id, similarity FROM sims) GROUP BY 1) SELECT test_id, similarity FROM q2 WHERE test_id IN (SELECT test_id FROM st)")
def ast_supplement(spark, d):
    """Similarities of all tests that were found by structure."""
    ids = structural(spark, d).select("test_id").distinct()
    best = B.best_by_vector(vectors(spark, d), probe(spark, d)).selectExpr("vec_id * 3 as test_id", "similarity").groupBy("test_id").agg(F.max("similarity").alias("similarity"))
    return best.join(ids, "test_id", "left_semi")


@query(ALL + "SELECT test_id, ast, vec, score, round(ast * 0.6::DOUBLE, 1) AS ast_part, round(vec * 0.4::DOUBLE, 1) AS vec_part FROM s")
def confidence_score(spark, d):
    return scored(spark, d).select("test_id", "ast", "vec", "score", "ast_part", "vec_part")


@query(ALL + """, t AS (SELECT *, CASE WHEN fn OR ex OR df THEN greatest(ast1, 55) ELSE ast1 END AS a1 FROM s),
u AS (SELECT *, CASE WHEN (fn OR ex OR df) AND vec > 0 THEN a1 * 0.45::DOUBLE + vec * 0.3::DOUBLE WHEN fn OR ex OR df THEN a1 * 0.75::DOUBLE WHEN vec > 0 THEN vec * 0.75::DOUBLE ELSE 0 END + CASE WHEN vec > 0 AND (ex OR fn) THEN 15 ELSE 0 END AS t0 FROM t),
w AS (SELECT *, CASE WHEN NOT (ex OR fn) AND a1 = 0 AND vec >= 70 THEN greatest(t0, floor(vec * 0.75::DOUBLE)) ELSE t0 END AS t1 FROM u)
SELECT test_id, greatest(0, least(100, floor(CASE WHEN vec = 0 AND a1 > 0 AND t1 < 50 THEN greatest(50, floor(a1 * 0.6::DOUBLE)) ELSE t1 END)))::INT AS score_v1 FROM w""")
def confidence_score_v1(spark, d):
    return C.confidence_v1(profiled(spark, d)).select("test_id", "score_v1")


@query(ALL + "SELECT CASE WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM s GROUP BY 1")
def confidence_distribution(spark, d):
    return scored(spark, d).groupBy(C.band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


QUALITY = "CASE WHEN fn THEN 'CONFIRMED_FUNCTION' WHEN df THEN 'CONFIRMED_FILE' WHEN ex THEN 'CONFIRMED_SYMBOL' WHEN integ THEN 'INTEGRATION_SCOPE' WHEN mo THEN 'BROAD_MODULE' WHEN se THEN 'SEMANTIC_SUPPLEMENT' ELSE 'UNKNOWN' END"
RISK = "CASE WHEN sx AND NOT structural AND NOT symbol_fits THEN 'HIGH' WHEN se AND NOT (ex OR fn) THEN CASE WHEN mo THEN 'MEDIUM' ELSE 'MEDIUM_HIGH' END WHEN mo AND NOT (ex OR fn) THEN 'MEDIUM' WHEN ex OR fn THEN 'LOW' ELSE 'LOW_MEDIUM' END"
HOTFIX_RISK = RISK.replace("THEN 'MEDIUM' WHEN ex OR fn", "THEN 'MEDIUM_HIGH' WHEN ex OR fn")
HINT = "CASE WHEN structural AND (direct OR fn OR (ex AND NOT se)) THEN 'independent' ELSE 'cross_dependent' END"
GATE = "(CASE WHEN structural AND sx THEN score >= 30 WHEN sem_coloc THEN true WHEN structural THEN score >= 42 WHEN sx THEN symbol_fits ELSE score >= 42 END AND NOT (coalesce(coloc_only, false) AND NOT sx) AND (NOT structural OR strong OR label_fits))"


@query(ALL + f"SELECT test_id, {QUALITY} AS quality FROM s")
def evidence_quality(spark, d):
    return profiled(spark, d).select("test_id", C.evidence_quality().alias("quality"))


@query(ALL + f"SELECT test_id, {RISK} AS risk, {HOTFIX_RISK} AS hotfix_risk FROM s")
def fp_risk(spark, d):
    """The risk of a false positive, for this change and as if it were a guard edit."""
    fits = F.col("symbol_fits")
    return profiled(spark, d).select("test_id", C.false_positive_risk(fits).alias("risk"), C.false_positive_risk(fits, F.lit(True)).alias("hotfix_risk"))


@query(ALL + f"SELECT test_id, {HINT} AS hint FROM s")
def dependency_hint(spark, d):
    return profiled(spark, d).select("test_id", C.dependency_hint().alias("hint"))


@query(ALL + f"SELECT test_id, score FROM s WHERE {GATE}")
def confidence_filter(spark, d):
    return scored(spark, d).where(kept()).select("test_id", "score")


@query(ALL + "SELECT test_id, score, structural AND sx AS both_, structural AND NOT sx AS ast_only, sx AND NOT structural AS semantic_only FROM s")
def match_partition(spark, d):
    a, s = C.is_structural(), C.has_semantic()
    return scored(spark, d).select("test_id", "score", (a & s).alias("both_"), (a & ~s).alias("ast_only"), (s & ~a).alias("semantic_only"))


@query(ALL + f"SELECT count(*) AS n_candidates, count(*) FILTER (structural) AS n_ast, count(*) FILTER (sx) AS n_semantic, count(*) FILTER (structural AND sx) AS n_both, count(*) FILTER ({GATE}) AS n_kept, count(*) FILTER ({GATE} AND score >= 70) AS n_high FROM s")
def selection_funnel(spark, d):
    a, s, k = C.is_structural(), C.has_semantic(), kept()
    return scored(spark, d).agg(F.count("*").alias("n_candidates"), F.count_if(a).alias("n_ast"), F.count_if(s).alias("n_semantic"), F.count_if(a & s).alias("n_both"), F.count_if(k).alias("n_kept"), F.count_if(k & (F.col("score") >= 70)).alias("n_high"))


@query(ALL + "SELECT count(*) FILTER (structural) AS n_ast, count(*) FILTER (sx) AS n_semantic, count(*) FILTER (structural AND sx) AS n_both, round(100.0::DOUBLE * count(*) FILTER (structural AND sx) / greatest(count(*) FILTER (structural), 1), 1) AS overlap_pct FROM s")
def compare_methods(spark, d):
    a, s = C.is_structural(), C.has_semantic()
    rows = scored(spark, d).agg(F.count_if(a).alias("n_ast"), F.count_if(s).alias("n_semantic"), F.count_if(a & s).alias("n_both"))
    return rows.withColumn("overlap_pct", F.round(F.lit(100.0) * F.col("n_both") / F.greatest("n_ast", F.lit(1)), 1))


@query(ALL + ", b AS (SELECT test_id FROM ev WHERE type = 'semantic'), c AS (SELECT DISTINCT test_id FROM ev WHERE type <> 'semantic') SELECT 'both_' AS side, count(*) AS n FROM (SELECT test_id FROM b INTERSECT SELECT test_id FROM c) UNION ALL SELECT 'ast_only', count(*) FROM (SELECT test_id FROM c EXCEPT SELECT test_id FROM b) UNION ALL SELECT 'semantic_only', count(*) FROM (SELECT test_id FROM b EXCEPT SELECT test_id FROM c)")
def set_compare(spark, d):
    ev = evidence(spark, d)
    sem, ast = ev.where("type = 'semantic'").select("test_id"), ev.where("type <> 'semantic'").select("test_id")
    side = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return side(sem.intersect(ast), "both_").unionByName(side(ast.subtract(sem), "ast_only")).unionByName(side(sem.subtract(ast), "semantic_only"))


@query(ALL + "SELECT coalesce(c.test_id, b.test_id) AS test_id, c.n, b.similarity FROM (SELECT test_id, count(*) AS n FROM ev WHERE type <> 'semantic' GROUP BY 1) c FULL JOIN (SELECT test_id, max(similarity) AS similarity FROM ev WHERE type = 'semantic' GROUP BY 1) b ON b.test_id = c.test_id".replace("c.n,", "coalesce(c.n, 0) AS n_ast,").replace("b.similarity FROM (SELECT test_id, count", "coalesce(b.similarity, 0) AS similarity FROM (SELECT test_id, count"))
def merge_ast_semantic(spark, d):
    ev = evidence(spark, d)
    ast = ev.where("type <> 'semantic'").groupBy("test_id").agg(F.count("*").alias("n_ast"))
    sem = ev.where("type = 'semantic'").groupBy("test_id").agg(F.max("similarity").alias("similarity"))
    return ast.join(sem, "test_id", "full_outer").select("test_id", F.coalesce("n_ast", F.lit(0)).alias("n_ast"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


@query(ALL + "SELECT test_id, count(*) AS n_evidence, min(seq) AS first_seq FROM ev WHERE type <> 'semantic' GROUP BY 1")
def select_ast(spark, d):
    return evidence(spark, d).where("type <> 'semantic'").groupBy("test_id").agg(F.count("*").alias("n_evidence"), F.min("seq").alias("first_seq"))


LABEL = "lab AS (SELECT doc_id AS test_id, CASE WHEN quality = 0 THEN 'NonRelevant' ELSE 'Relevant' END AS label FROM labels)"


@query(ALL + f", {LABEL} SELECT s.test_id, s.score, coalesce(label, 'none') AS label FROM s LEFT JOIN lab USING (test_id) WHERE label IS NULL OR label <> 'NonRelevant' OR structural")
def label_prune_restore(spark, d):
    lab = load(spark, d, "labels").selectExpr("doc_id as test_id", "CASE WHEN quality = 0 THEN 'NonRelevant' ELSE 'Relevant' END as label")
    rows = scored(spark, d).join(lab, "test_id", "left")
    keep = F.col("label").isNull() | (F.col("label") != "NonRelevant") | C.is_structural()
    return rows.where(keep).select("test_id", "score", F.coalesce("label", F.lit("none")).alias("label"))


@query(ALL + "SELECT test_id FROM near")
def semantic_colocate(spark, d):
    return evidence(spark, d).where("seq = 9").select("test_id")


#: A change of a production file together with test files.
COCHANGED = ("src/orders/cust_7.js", "app\\tests\\unit\\urgent\\cust_7.test.js", "tests/e2e/low/cust_11.test.js")


@query(ALL + """, tails AS (SELECT unnest(['%/cust_7.test.js', '%cust_7.test.js', '%urgent/cust_7.test.js%', '%/cust_11.test.js', '%cust_11.test.js', '%low/cust_11.test.js%']) AS pattern),
suite AS (SELECT DISTINCT test_id FROM ent JOIN tails ON file_path ILIKE pattern) SELECT e.test_id, greatest(coalesce(s.score, 0), 82) AS score, true AS is_ast, false AS is_semantic FROM suite e LEFT JOIN s USING (test_id)""")
def cochange_suite(spark, d):
    """Where a change holds both kinds of files, the tests of its test files take the result's place."""
    tests = [p for p in COCHANGED if K.is_test(p)] if K.is_cochanged(list(COCHANGED)) else []
    suite = entities(spark, d).where(L.any_tail(F.col("file_path"), tests)).select("test_id")
    return suite.join(scored(spark, d).select("test_id", "score"), "test_id", "left").select("test_id", F.greatest(F.coalesce("score", F.lit(0)), F.lit(82)).alias("score"), F.lit(True).alias("is_ast"), F.lit(False).alias("is_semantic"))


@query("SELECT o_custkey AS repo, count(o_orderkey) AS n_changed, CASE WHEN count(o_orderkey) > any_value(CASE WHEN c_acctbal > 0 THEN c_nationkey END) THEN 'run_all' ELSE 'select' END AS decision FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def risk_gate(spark, d):
    """More changed files than a repository's threshold: everything runs. No threshold: never."""
    limits = load(spark, d, "customer").selectExpr("c_custkey as repo", "CASE WHEN c_acctbal > 0 THEN c_nationkey END as threshold")
    n = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.count("*").alias("n_changed")).join(limits, "repo")
    return n.select("repo", "n_changed", F.when(F.col("n_changed") > F.col("threshold"), "run_all").otherwise("select").alias("decision"))


@query(ALL + f"""SELECT test_id, test_type, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS band, CASE WHEN structural AND sx THEN 'Both' WHEN structural THEN 'AST' ELSE 'Semantic' END AS match_type,
{QUALITY} AS quality, {RISK} AS risk, {HINT} AS hint, n_evidence FROM s WHERE {GATE}""")
def select_entities(spark, d):
    """The flagship: all evidence, scored, gated and labelled, in one plan."""
    a, s = C.is_structural(), C.has_semantic()
    kind = F.when(a & s, "Both").when(a, "AST").otherwise("Semantic")
    return scored(spark, d).where(kept()).select("test_id", "test_type", "score", C.band(F.col("score")).alias("band"), kind.alias("match_type"), C.evidence_quality().alias("quality"), C.false_positive_risk(F.col("symbol_fits")).alias("risk"), C.dependency_hint().alias("hint"), "n_evidence")


@query(ALL + f"SELECT test_id, score FROM s WHERE {GATE} ORDER BY score DESC, test_id LIMIT 100")
def top_selection(spark, d):
    """The hundred best tests of the selection, in order."""
    return scored(spark, d).where(kept()).select("test_id", "score").orderBy(F.desc("score"), "test_id").limit(100)


TRUTH = f"tr AS (SELECT quality, test_id IN (SELECT test_id FROM s WHERE {GATE}) AS picked FROM labels JOIN ent ON test_id = doc_id)"


def judged(spark, d):
    """quality, picked: labelled tests of the registry, and whether the flagship selects them."""
    chosen = scored(spark, d).where(kept()).select("test_id", F.lit(True).alias("picked"))
    truth = load(spark, d, "labels").select(F.col("doc_id").alias("test_id"), "quality").join(entities(spark, d).select("test_id"), "test_id")
    return truth.join(chosen, "test_id", "left").select("quality", F.coalesce("picked", F.lit(False)).alias("picked"))


@query(ALL + f", {TRUTH} SELECT quality AS truth, count(*) AS n, count(*) FILTER (picked) AS selected FROM tr GROUP BY 1")
def truth_table(spark, d):
    return judged(spark, d).groupBy(F.col("quality").alias("truth")).agg(F.count("*").alias("n"), F.count_if("picked").alias("selected"))


@query(ALL + f""", {TRUTH}, c AS (SELECT count(*) FILTER (picked AND quality = 1)::DOUBLE AS tp, count(*) FILTER (picked AND quality = 0)::DOUBLE AS fp, count(*) FILTER (NOT picked AND quality = 1)::DOUBLE AS fn FROM tr)
SELECT CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 4) END AS precision_, CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn), 4) END AS recall_, CASE WHEN tp + fp + fn = 0 THEN 0 ELSE round(2 * tp / (2 * tp + fp + fn), 4) END AS f1 FROM c""")
def precision_recall(spark, d):
    """The flagship's selection against labels of what is relevant."""
    rows, n = judged(spark, d), lambda c: F.count_if(c).cast("double")
    tp, fp, fn = n(F.col("picked") & (F.col("quality") == 1)), n(F.col("picked") & (F.col("quality") == 0)), n(~F.col("picked") & (F.col("quality") == 1))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / b, 4))
    return rows.agg(safe(tp, tp + fp).alias("precision_"), safe(tp, tp + fn).alias("recall_"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))
