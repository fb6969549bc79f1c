"""Scanning, extraction, chunking and the inverted index, over paths and sources written from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract as E
from .tables import load

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Paths made of a document's source, language and number.
PATH = """CASE doc_id % 9 WHEN 0 THEN source || '/tests/test_' || lang || '.py' WHEN 1 THEN source || '/node_modules/' || lang || '.test.js' WHEN 2 THEN 'e2e/' || lang || '.spec.ts' WHEN 3 THEN 'api/' || source || '/User' || lang || 'Test.java'
 WHEN 4 THEN source || '/' || lang || '_test.go' WHEN 5 THEN 'functional/build/x.' || lang WHEN 6 THEN 'acceptance/' || lang || 'tests.PY' WHEN 7 THEN source || '/Integration/' || lang || '.rb' ELSE 'readme' END"""
PATHS = f"p AS (SELECT doc_id, {PATH} AS path FROM documents)"
LANGUAGE = "CASE lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in E.LANGUAGES.items()) + " END"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def paths(spark, d):
    return load(spark, d, "documents").select("doc_id", F.expr(PATH).alias("path"))


def words_in(low: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"


@query(f"WITH {PATHS} SELECT doc_id, coalesce({LANGUAGE}, 'unknown') AS language, NOT list_has_any(string_split(path, '/')[:-2], {list(E.EXCLUDED)}) AS should_scan FROM p")
def path_language(spark, d):
    p = F.col("path")
    return paths(spark, d).select("doc_id", F.coalesce(E.language_of(p), F.lit("unknown")).alias("language"), E.should_scan(p).alias("should_scan"))


NAME = "list_extract(string_split(path, '/'), -1)"
EXT = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"
IS_TEST = f"CASE {EXT} " + " ".join(f"WHEN '{e}' THEN regexp_matches({NAME}, '{E.any_of(rx)}')" for e, rx in E.TEST_FILES.items()) + f" ELSE regexp_matches({NAME}, '{E.any_of(*E.TEST_FILES.values())}') END"


@query(f"WITH {PATHS} SELECT {LANGUAGE} AS language, count(*) AS n_files, count(*) FILTER (WHERE {IS_TEST}) AS n_tests FROM p WHERE {LANGUAGE} IS NOT NULL AND NOT list_has_any(string_split(path, '/')[:-2], {list(E.EXCLUDED)}) GROUP BY 1")
def scan_languages(spark, d):
    """A scan of several languages: files and test files of each, excluded folders left out."""
    p = F.col("path")
    rows = paths(spark, d).where(E.should_scan(p)).withColumn("language", E.language_of(p)).where("language IS NOT NULL")
    return rows.groupBy("language").agg(F.count("*").alias("n_files"), F.count_if(E.is_test_file(p)).alias("n_tests"))


CATEGORY = f"CASE WHEN {words_in('lower(path)', E.CATEGORIES['e2e'])} THEN 'e2e' WHEN {words_in('lower(path)', E.CATEGORIES['integration'])} THEN 'integration' ELSE 'unit' END"


@query(f"WITH {PATHS} SELECT {CATEGORY} AS category, count(*) AS n_files FROM p GROUP BY 1")
def category_files(spark, d):
    return paths(spark, d).groupBy(E.category(F.col("path")).alias("category")).agg(F.count("*").alias("n_files"))


@query(f"""WITH {PATHS} SELECT doc_id, CASE WHEN contains(lower(path), 'integration') THEN 'integration' WHEN contains(lower(path), 'e2e') OR contains(lower(path), 'end.to.end') OR (coalesce({LANGUAGE}, '') = 'python' AND contains(lower(path), 'acceptance')) THEN 'e2e' ELSE 'unit' END AS test_type FROM p""")
def path_test_type(spark, d):
    p = F.col("path")
    return paths(spark, d).select("doc_id", E.test_type(p, F.coalesce(E.language_of(p), F.lit(""))).alias("test_type"))


#: Sources in nine languages made of a part's name and type.
BODIES = {
    "python": "'import os' || chr(10) || 'from ' || t || '.core import x' || chr(10) || 'class TestA:' || chr(10) || '    async def test_' || n || '(self):' || chr(10) || '        assert ' || n || '(1) == 2' || chr(10) || 'def testing(): pass'",
    "java": "'import java.util.List;' || chr(10) || 'import org.junit.jupiter.api.Test;' || chr(10) || 'public class UserTest {' || chr(10) || '  @Test' || chr(10) || '  public void ' || n || '() { run(); }' || chr(10) || '  public void testMore() { }'",
    "javascript": "'import \"./' || t || '\"' || chr(10) || 'describe(\"suite_' || n || '\", () => {' || chr(10) || '  it(\"does_' || n || '\", () => { call(1) })' || chr(10) || '  test(\"x y\", () => { require(\"jest\") })' || chr(10) || '})'",
    "kotlin": "'import a.' || t || chr(10) || '@Test fun test_' || n || '() {}' || chr(10) || 'fun testTwo() {}'",
    "go": "'import \"' || t || '/x\"' || chr(10) || 'func Test' || n || '(t *testing.T) {}'",
    "ruby": "'it \"' || n || ' works\" do' || chr(10) || 'def test_' || t",
    "csharp": "'using NUnit.' || t || ';' || chr(10) || '[Fact]' || chr(10) || 'public void ' || n || '() {}'",
    "c": "'#include <' || t || '.h>' || chr(10) || 'void test_' || n || '(void) {}'",
    "cpp": "'#include \"' || t || '.hpp\"' || chr(10) || 'TEST_F(Suite, ' || n || ') {}' || chr(10) || 'FRIEND_TEST(Suite, Other);'",
}
LANGS = list(BODIES)
SOURCE = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(BODIES.values())) + " END"
SRC = f"src AS (SELECT p_partkey AS file_id, list_extract({LANGS}, p_partkey % 9 + 1) AS language, {SOURCE} AS body FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS n, lower(p_type) AS t FROM part))"


def sources(spark, d):
    part = load(spark, d, "part").select("p_partkey", F.expr("replace(p_name, ' ', '_')").alias("n"), F.lower("p_type").alias("t"))
    language = F.element_at(F.array(*map(F.lit, LANGS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    return part.select(F.col("p_partkey").alias("file_id"), language.alias("language"), F.expr(SOURCE).alias("body"))


def found(table: dict[str, tuple[str, ...]]) -> str:
    """Distinct matches in order, pattern by pattern."""
    every = {k: "list_concat(" + ", ".join(f"regexp_extract_all(body, '{p.replace(chr(39), chr(39) * 2)}', 1)" for p in v) + ")" for k, v in table.items()}
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in every.items()) + " END"


FIRST = "list_filter(v, lambda x, i: list_position(v, x) = i)"


@query(f"WITH {SRC}, v AS (SELECT file_id, language, {found(E.TESTS)} AS v FROM src) SELECT file_id, language, generate_subscripts({FIRST}, 1)::INT - 1 AS ordinal, unnest({FIRST}) AS test_name FROM v")
def declared_tests(spark, d):
    return E.declared_tests(sources(spark, d))


IMPORTS_SQL = f"SELECT DISTINCT file_id, language, unnest({found(E.IMPORTS)}) AS module FROM src"


@query(f"WITH {SRC} {IMPORTS_SQL}")
def declared_imports(spark, d):
    return E.declared_imports(sources(spark, d))


def votes_sql() -> str:
    rows = []
    for lang, table in E.FRAMEWORKS.items():
        for f, (imp, ann) in table.items():
            q = lambda rx: rx.replace("'", "''")
            ann_votes = f" + CASE WHEN regexp_matches(body, '{q(ann)}') THEN 3 ELSE 0 END" if ann else ""
            rows.append(f"SELECT '{lang}' AS language, '{f}' AS framework, sum(CASE WHEN regexp_matches(body, '{q(imp)}') THEN 2 ELSE 0 END{ann_votes})::BIGINT AS votes FROM s WHERE language = '{lang}'")
    return " UNION ALL ".join(rows)


@query(f"WITH {SRC}, s AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY language ORDER BY file_id) <= 50) SELECT language, framework, votes, CASE WHEN votes >= 10 THEN 'high' WHEN votes >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM ({votes_sql()}) WHERE votes >= 3")
def framework_detect(spark, d):
    return E.frameworks(sources(spark, d))


def start_rx(lang: str) -> str:
    return rf"(?i)^[^\S\n]*(?:{E.STARTS[lang]})"


@query(f"""WITH {SRC}, l AS (SELECT file_id, language, generate_subscripts(string_split(body, chr(10)), 1) AS no, unnest(string_split(body, chr(10))) AS line, len(string_split(body, chr(10))) AS n_lines FROM src WHERE language IN ('python', 'javascript', 'java')),
g AS (SELECT *, sum(CASE WHEN no > 1 AND CASE language WHEN 'python' THEN regexp_matches(line, '{start_rx('python')}') WHEN 'javascript' THEN regexp_matches(line, '{start_rx('javascript')}') ELSE regexp_matches(line, '{start_rx('java')}') END THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY no) AS piece FROM l),
c AS (SELECT file_id, language, (piece - 1)::INT AS chunk_no, string_agg(line, chr(10) ORDER BY no) || CASE WHEN max(no) < any_value(n_lines) THEN chr(10) ELSE '' END AS chunk, min(no)::INT AS start_line, (CASE WHEN max(no) < any_value(n_lines) THEN max(no) + 1 ELSE max(no) END)::INT AS end_line FROM g WHERE piece > 0 GROUP BY file_id, language, piece)
SELECT file_id, chunk_no, chunk, start_line, end_line, CASE language WHEN 'python' THEN replace(regexp_extract(chunk, '(?m)^\\s*def\\s+(test_\\w+)\\s*\\(', 1), '_', ' ')
 WHEN 'javascript' THEN trim(CASE WHEN regexp_extract(chunk, '(?i)(?:it|test)\\s*\\(\\s*[''"`]([^''"`]+)[''"`]', 1) <> '' THEN regexp_extract(chunk, '(?i)(?:it|test)\\s*\\(\\s*[''"`]([^''"`]+)[''"`]', 1) ELSE '' END)
 ELSE replace(trim(regexp_replace(regexp_extract(chunk, '(?i)(?:public\\s+)?void\\s+(test\\w+)\\s*\\(', 1), '([A-Z])', ' \\1', 'g')), 'test ', '') END AS method_name, '' AS class_name FROM c""")
def chunk_by_boundary(spark, d):
    return E.chunks_by_test(sources(spark, d))


@query(f"""WITH {SRC}, a AS (SELECT file_id, list_concat(list_transform(regexp_extract_all(body, '(?im)assert\\s+[^\\n]+'), lambda x: trim(x)), regexp_extract_all(body, '(?im)self\\.assert[A-Z]\\w+\\([^)]*\\)')) AS a, list_filter(regexp_extract_all(body, '{E.CALL}'), lambda c: NOT regexp_matches(lower(c), '{E.NOT_CALLS}')) AS v, string_split(body, chr(10)) AS s FROM src)
SELECT file_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ';') AS assertions, array_to_string({FIRST}[:15], ';') AS calls, left(array_to_string(s[:10], chr(10)), 500) AS setup FROM a""")
def summarize_content(spark, d):
    s = E.summary(F.col("body"))
    return sources(spark, d).select("file_id", s.alias("s")).select("file_id", F.array_join("s.assertions", ";").alias("assertions"), F.array_join("s.calls", ";").alias("calls"), "s.setup")


#: What tests refer to: a part's file by a direct, transitive or annotated import, its type as a called module, and a label.
DEP = """dep AS (SELECT l_orderkey AS test_id, CASE p_size % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN '@scope/' || lower(p_type) ELSE '../lib/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '.js' END AS referenced_class,
 CASE l_returnflag WHEN 'A' THEN 'direct_import' WHEN 'N' THEN 'transitive_import' ELSE 'source_annotation' END AS reference_type, CASE l_linestatus WHEN 'F' THEN 'patch_ref' END AS source, lower(p_type) AS module_name,
 CASE l_linenumber WHEN 1 THEN ' ' || p_name || ' with ' || lower(p_type) || ' ' WHEN 2 THEN p_name WHEN 3 THEN '' ELSE p_brand || ' > ' || p_name END AS class_name FROM lineitem JOIN part ON l_partkey = p_partkey)"""
HEAD = "trim(string_split(trim(regexp_split_to_array(trim(class_name), '(?i)\\s+(?:with|uses|from|for|in|that|>|→|:|—|–)\\s+')[1]), ' > ')[1])"


@query(f"""WITH {DEP}, r AS (SELECT referenced_class AS symbol, test_id, reference_type FROM dep
UNION ALL SELECT regexp_extract(referenced_class, '([^/]+?)(?:\\.[A-Za-z]+)?$', 1), test_id, CASE reference_type WHEN 'transitive_import' THEN 'transitive_normalized' WHEN 'source_annotation' THEN 'source_annotation_normalized' ELSE 'normalized_import' END FROM dep WHERE NOT starts_with(referenced_class, '@') AND contains(referenced_class, '/')
UNION ALL SELECT module_name, test_id, coalesce(source, 'method_call') FROM dep
UNION ALL SELECT symbol, test_id, 'describe_label' FROM (SELECT DISTINCT test_id, {HEAD} AS symbol FROM dep WHERE trim(class_name) <> '' UNION SELECT DISTINCT test_id, trim(class_name) FROM dep WHERE trim(class_name) <> '' AND {HEAD} <> '') WHERE symbol <> '')
SELECT symbol, test_id, reference_type, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def build_reverse_index(spark, d):
    """All five sources over all rows; equal references are kept as their number."""
    part = load(spark, d, "part")
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_linenumber").join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.selectExpr(
        "l_orderkey as test_id", "CASE p_size % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN '@scope/' || lower(p_type) ELSE '../lib/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '.js' END as referenced_class",
        "CASE l_returnflag WHEN 'A' THEN 'direct_import' WHEN 'N' THEN 'transitive_import' ELSE 'source_annotation' END as reference_type", "CASE l_linestatus WHEN 'F' THEN 'patch_ref' END as source", "lower(p_type) as module_name",
        "CASE l_linenumber WHEN 1 THEN ' ' || p_name || ' with ' || lower(p_type) || ' ' WHEN 2 THEN p_name WHEN 3 THEN '' ELSE p_brand || ' > ' || p_name END as class_name",
    )
    index = E.inverted_rows(rows, rows, X.label_head(F.col("class_name")))
    return index.groupBy("symbol", "test_id", "reference_type").agg(F.count("*").alias("n"))


@query(f"WITH {DEP}, nested AS (SELECT test_id, list({{'referenced_class': referenced_class, 'reference_type': reference_type}}) AS refs FROM dep GROUP BY 1) SELECT test_id, r.referenced_class, r.reference_type AS import_type, count(*) AS n FROM (SELECT test_id, unnest(refs) AS r FROM nested) GROUP BY 1, 2, 3")
def flatten_dependencies(spark, d):
    """A document for each test with its references nested, as rows."""
    part = load(spark, d, "part")
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(part, F.col("l_partkey") == F.col("p_partkey"))
    name = F.expr("CASE p_size % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN '@scope/' || lower(p_type) ELSE '../lib/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '.js' END")
    kind = F.expr("CASE l_returnflag WHEN 'A' THEN 'direct_import' WHEN 'N' THEN 'transitive_import' ELSE 'source_annotation' END")
    nested = lines.groupBy(F.col("l_orderkey").alias("test_id")).agg(F.collect_list(F.struct(name.alias("referenced_class"), kind.alias("reference_type"))).alias("refs"))
    flat = nested.select("test_id", F.explode("refs").alias("r")).select("test_id", "r.referenced_class", F.col("r.reference_type").alias("import_type"))
    return flat.groupBy("test_id", "referenced_class", "import_type").agg(F.count("*").alias("n"))


PATTERN_PATHS = "q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'src/' || lang || '/' || source || '.js' WHEN 1 THEN 'utils.js' WHEN 2 THEN 'a/b' ELSE 'x/' || source || '.api' END AS path, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN 'utils' WHEN 2 THEN '' ELSE 'api' END AS stem, source || '.' || CASE doc_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'cartItem' ELSE lang END AS symbol FROM documents)"
GENERIC = "('util', 'utils', 'index', 'main', 'test', 'tests', 'common', 'base', 'core', 'api', 'data', 'mock', 'helper', 'helpers', 'config', 'types', 'type')"


@query(f"""WITH {PATTERN_PATHS}, x AS (SELECT *, array_to_string(string_split(path, '/')[-2:], '/') AS tail, string_split(symbol, '.')[-1] AS last FROM q)
SELECT doc_id, array_to_string(list_concat(CASE WHEN contains(path, '/') AND len(tail) >= 5 THEN ['%' || tail || '%'] ELSE [] END, CASE WHEN len(stem) >= 4 AND stem NOT IN {GENERIC} THEN ['%' || stem || '%'] WHEN stem <> '' THEN [stem || '.%', '%.' || stem] ELSE [] END), ';') AS file_patterns,
 array_to_string(list_concat([symbol, symbol || '.%', '%.' || symbol], CASE WHEN len(last) >= 4 AND last NOT IN {GENERIC} THEN ['%' || last || '%'] ELSE [last || '.%', '%.' || last] END), ';') AS symbol_patterns FROM x""")
def dead_zone_patterns(spark, d):
    rows = load(spark, d, "documents").selectExpr(
        "doc_id", "CASE doc_id % 4 WHEN 0 THEN 'src/' || lang || '/' || source || '.js' WHEN 1 THEN 'utils.js' WHEN 2 THEN 'a/b' ELSE 'x/' || source || '.api' END as path",
        "CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN 'utils' WHEN 2 THEN '' ELSE 'api' END as stem", "source || '.' || CASE doc_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'cartItem' ELSE lang END as symbol",
    )
    return rows.select("doc_id", F.array_join(X.dead_zone_patterns(F.col("stem"), F.col("path")), ";").alias("file_patterns"), F.array_join(X.symbol_patterns(F.col("symbol")), ";").alias("symbol_patterns"))


@query("SELECT p_partkey, regexp_matches(name, '^[A-Z]') AND upper(name) = name AS is_constant FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN upper(replace(p_name, ' ', '_')) WHEN 1 THEN p_name ELSE '9' || upper(p_type) END AS name FROM part)")
def screaming_case(spark, d):
    name = F.expr("CASE p_size % 3 WHEN 0 THEN upper(replace(p_name, ' ', '_')) WHEN 1 THEN p_name ELSE '9' || upper(p_type) END")
    return load(spark, d, "part").select("p_partkey", X.screaming(name).alias("is_constant"))
