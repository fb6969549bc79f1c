"""Analysis of test sources as rows, over sources in three languages that are written from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import analyzer as Z
from ..operators import chunks as C
from ..operators import extract as E
from .tables import load

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

PYTHON = """import numpy as np
from {t}.core import svc as {n}, util
import os.path
@pytest.fixture(scope="module")
async def {n}_fx(x=(1, 2)):
    pass
@patch("{t}.core.run")
@pytest.mark.parametrize("a", [(1, f(2)), (3, g(h(4)))], ids="x")
@pytest.mark.asyncio
async def test_{n}(a):
    \"\"\"Checks {n}.\"\"\"
    np.zeros(1)
    {n}.go(2); util.stop()
    self.assertEqual(1)
def test_more():
    {n}.go(3)
    {n}.halt()
helper(1)"""
SCRIPT = """import api, {{ load as get, put }} from "./{t}/api"
import * as lib from "../lib"
const cfg = require("cfg/{n}")
before.all()
jest.mock("../{t}")
it("a_{n}", () => {{ api.run(); get.now(); }}); it("b_{n}", () => {{ api.stop(); api.run(); }})
test("last", async () => {{ cfg.read(); console.log(1); put.all ()
  jest.spyOn(api, "x") }})"""
JAVA = """package com.shop.test.{t};
import java.util.List;
{i}
@RunWith(Runner.class)
public class {c}Test {{
  @Autowired
  private Service<{c}> svc;
  @Test
  @DisplayName("x (y)")
  public void test{n}() {{ Service.run(); svc.go(); System.out.println(1);
    Class.forName("a.{c}"); x.invoke (1); }}
}}"""


def literal(template: str) -> str:
    """A source's template as an SQL expression over n (name), t (type), c (class) and i (import)."""
    at = {k: f"' || {k} || '" for k in "ntci"}
    return "'" + template.replace("'", "''").format(**at).replace("\n", "' || chr(10) || '") + "'"


NAMED = """SELECT p_partkey AS file_id, p_partkey, replace(p_name, ' ', '_') AS n, lower(p_type) AS t,
 CASE WHEN p_partkey % 4 < 2 THEN replace(p_brand, '#', '') ELSE 'Widget' || CAST(p_partkey AS {string}) END AS c,
 CASE WHEN p_partkey % 2 = 0 THEN 'import com.' || lower(p_type) || '.Service;' ELSE '' END AS i, replace(p_brand, '#', '') AS b FROM part"""
BODY = f"CASE p_partkey % 3 WHEN 0 THEN {literal(PYTHON)} WHEN 1 THEN {literal(SCRIPT)} ELSE {literal(JAVA)} END"
LANGUAGE = "CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'java' END"
PATH = "'app/Test_code/' || t || '/' || b || 'Test.java'"
SRC = f"src AS (SELECT file_id, {LANGUAGE} AS language, {PATH} AS path, {BODY} AS body FROM ({NAMED.format(string='VARCHAR')}))"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = f"WITH {SRC}{oracle}"
        return f

    return add


def sources(spark, d):
    part = load(spark, d, "part").selectExpr("p_partkey", "p_name", "p_type", "p_brand")
    rows = part.selectExpr("p_partkey as file_id", "p_partkey", "replace(p_name, ' ', '_') as n", "lower(p_type) as t", "CASE WHEN p_partkey % 4 < 2 THEN replace(p_brand, '#', '') ELSE 'Widget' || CAST(p_partkey AS STRING) END as c", "CASE WHEN p_partkey % 2 = 0 THEN 'import com.' || lower(p_type) || '.Service;' ELSE '' END as i", "replace(p_brand, '#', '') as b")
    return rows.selectExpr("file_id", f"{LANGUAGE} as language", f"{PATH} as path", f"{BODY} as body")


def q(rx: str) -> str:
    return "'" + rx.replace("'", "''") + "'"


NL = "(length({0}) - length(replace({0}, chr(10), '')))"


def located(rx: str, *groups: int, end: bool = False, where: str = "true") -> str:
    """DuckDB: rows (file_id, language, body, path, line, place, g1, ...) of all matches of a pattern in src."""
    own = f"list_sum(list_transform(w[:i{'' if end else ' - 1'}], lambda x: {NL.format('x')}))"
    line = f"CAST(1 + list_sum(list_transform(p[:i], lambda x: {NL.format('x')})) + coalesce({own}, 0) AS INTEGER)"
    cols = "".join(f", regexp_extract_all(body, {q(rx)}, {g})[i] AS g{k}" for k, g in enumerate(groups, 1))
    return f"""(SELECT file_id, language, body, path, {line} AS line, CAST(i AS INTEGER) AS place{cols} FROM (
      SELECT *, regexp_split_to_array(body, {q(rx)}) AS p, regexp_extract_all(body, {q(rx)}, 0) AS w, unnest(range(1, len(regexp_extract_all(body, {q(rx)}, 0)) + 1)) AS i FROM src WHERE {where}))"""


def tests_sql() -> str:
    every = [f"SELECT file_id, line, g1 FROM {located(p, 1, end=True, where=f'language = {q(lang)}')}" for lang in ("python", "javascript", "java") for p in E.TESTS[lang]]
    return f"tests AS (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line, g1) - 1 AS INTEGER) AS test_no, g1 AS test_name, line FROM ({' UNION '.join(every)}))"


def listed(rx: str, names: int, module: int, between: str, name: str, where: str) -> str:
    """Rows (file_id, alias, module) of lists of names; name: the module that one name stands for."""
    part = f"list_transform(string_split(trim(regexp_replace(x, '[()\\s]+', ' ', 'g')), {q(between)}), lambda y: trim(y))"
    return f"SELECT file_id, {part}[-1] AS alias, {name.format(m='m', first=f'{part}[1]')} AS module FROM (SELECT file_id, g2 AS m, unnest(string_split(g1, ',')) AS x FROM {located(rx, names, module, where=where)}) WHERE trim(x) <> ''"


QUOTED = r"['\"]([^'\"]+)['\"]"
PY, JS, JV = "language = 'python'", "language = 'javascript'", "language = 'java'"
BOUND = "bound AS (" + " UNION ALL ".join([
    f"SELECT file_id, g2 AS alias, g1 AS module FROM {located(r'(?m)^[ \t]*import[ \t]+([\w.]+)[ \t]+as[ \t]+(\w+)', 1, 2, where=PY)}",
    f"SELECT file_id, g2, g2 FROM {located(r'(?m)^[ \t]*import[ \t]+((\w+)[\w.]*)[ \t]*$', 1, 2, where=PY)}",
    listed(r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+([^\n]+)$", 2, 1, " as ", "{m} || '.' || {first}", PY),
    f"SELECT file_id, g1, g2 FROM {located(rf'import\s+(\w+)\s*(?:,\s*\{{[^}}]*\}}\s*)?from\s*{QUOTED}', 1, 2, where=JS)}",
    f"SELECT file_id, g1, g2 FROM {located(rf'import\s*\*\s*as\s+(\w+)\s+from\s*{QUOTED}', 1, 2, where=JS)}",
    listed(rf"import\s*(?:\w+\s*,\s*)?\{{([^}}]*)\}}\s*from\s*{QUOTED}", 1, 2, " as ", "{m}", JS),
    f"SELECT file_id, g1, g2 FROM {located(rf'(?:const|let|var)\s+(\w+)\s*=\s*require\s*\(\s*{QUOTED}', 1, 2, where=JS)}",
    f"SELECT file_id, g2, g1 FROM {located(r'(?m)^import[ \t]+(?:static[ \t]+)?([\w.]+\.(\w+))[ \t]*;', 1, 2, where=JV)}",
]) + ")"


@query(f", {BOUND} SELECT file_id, alias, module FROM bound")
def import_bindings(spark, d):
    """The names that each file's imports bind."""
    return sources(spark, d).select("file_id", F.explode(A.bindings(F.col("body"), F.col("language"))).alias("b")).select("file_id", "b.alias", "b.module")


def skipped(value: str, table: dict[str, tuple[str, ...]]) -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN list_contains({list(v)}, lower({value}))" for k, v in table.items()) + " END"


CALLS = f"""calls AS (SELECT file_id, line, 1 AS kind, place, g1 AS object_name, g2 AS function_name, 'method' AS call_type, 'method_call' AS source FROM {located(A.METHOD_CALL, 1, 2)} WHERE NOT {skipped('g1', A.SKIPPED_OBJECTS)}
 UNION ALL SELECT file_id, line, 2, place, '', g1, 'direct', 'method_call' FROM {located(A.LINE_CALL, 1, where=PY)} WHERE NOT list_contains({list(A.SKIPPED_FUNCTIONS)}, lower(g1))
 UNION ALL SELECT file_id, line, 3, place, regexp_replace(g1, '\\.[^.]*$', ''), regexp_extract(g1, '([^.]*)$', 1), 'patch_ref', 'patch_ref' FROM {located(A.PATCH, 1, where=PY)} WHERE contains(g1, '.'))"""
OWNED = """owned AS (SELECT c.*, coalesce((SELECT arg_max((t.test_no, t.test_name), (t.line, t.test_no)) FROM tests t WHERE t.file_id = c.file_id AND t.line <= c.line),
  (SELECT arg_min((t.test_no, t.test_name), (t.line, t.test_no)) FROM tests t WHERE t.file_id = c.file_id)) AS owner,
  CASE WHEN call_type = 'patch_ref' THEN object_name ELSE coalesce((SELECT min(module) FROM bound b WHERE b.file_id = c.file_id AND b.alias = c.object_name), object_name) END AS module_name FROM calls c)"""


@query(f", {tests_sql()}, {BOUND}, {CALLS}, {OWNED} " + """SELECT file_id, owner[2] AS test_name, object_name, module_name, function_name, call_type, source, line FROM owned WHERE owner IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY file_id, owner[1], object_name, call_type, source, CASE WHEN call_type <> 'method' THEN function_name END ORDER BY line, kind, place) = 1""")
def call_owner(spark, d):
    """Each call's owning test, objects resolved by the file's imports; the first of each test and object."""
    return A.call_owners(sources(spark, d)).drop("test_no")


@query(f", {tests_sql()} SELECT f.file_id, test_name, g3 AS fixture_name, CASE WHEN regexp_extract(g1, 'scope\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1) = '' THEN 'function' ELSE regexp_extract(g1, 'scope\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1) END AS fixture_scope, CASE WHEN starts_with(g2, 'async') THEN 'async' ELSE 'sync' END AS fixture_type FROM {located(A.FIXTURE, 1, 2, 3, where=PY)} f JOIN tests USING (file_id)")
def test_fixtures(spark, d):
    """Fixtures of a file belong to all its tests."""
    src = sources(spark, d)
    return A.fixtures(src).join(A.tests(src), "file_id").select("file_id", "test_name", "fixture_name", "fixture_scope", "fixture_type")


def marks_sql(rx: str, kind: str, where: str) -> str:
    names, args = (f"regexp_extract_all(g1, {q(A.MARK)}, {g})" for g in (1, 2))
    return f"SELECT file_id, '{kind}' AS target_type, g2 AS target_name, CAST(unnest(range(len({names}))) AS INTEGER) AS mark_no, unnest({names}) AS name, unnest(list_transform({args}, lambda a: CASE WHEN a <> '' THEN a[2:-2] END)) AS args FROM {located(rx, 1, 2, where=where)}"


PAIRS = """array_to_string(list_transform(list_filter(string_split(coalesce(args, ''), ','), lambda p: contains(p, '=')), lambda p: trim(split_part(p, '=', 1)) || '=' || trim(trim(p[instr(p, '=') + 1:]), chr(34) || chr(39))), ';')"""


@query(f""" SELECT file_id, target_name AS function_name, mark_no, name AS decorator_name, args, {PAIRS} AS decorator_args FROM ({marks_sql(A.DECORATED, 'function', PY)})
WHERE starts_with(name, 'pytest.') OR len(list_filter({list(A.TEST_DECORATORS)}, lambda d: contains(name, d))) > 0""")
def test_decorators(spark, d):
    """The stacks above Python functions, with their key=value arguments."""
    pairs = F.transform(F.map_entries("decorator_args"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    rows = A.decorators(sources(spark, d))
    return rows.select("file_id", "function_name", "mark_no", "decorator_name", "args", F.array_join(pairs, ";").alias("decorator_args"))


@query(f" SELECT file_id, target_type, target_name, mark_no, name AS annotation_name, args FROM ({marks_sql(A.ANNOTATED, 'method', JV)} UNION ALL {marks_sql(A.ANNOTATED_CLASS, 'class', JV)})")
def test_annotations(spark, d):
    return A.annotations(sources(spark, d))


@query(" " + " UNION ALL ".join(f"SELECT file_id, '{name}' AS reflection_method, {q(kind) if kind else 'NULL'} AS target_kind, {'g1' if kind else 'NULL'} AS target, line FROM {located(rx, *((1,) if kind else ()), where=JV)}" for rx, name, kind in A.REFLECTION))
def reflection_calls(spark, d):
    return A.reflection(sources(spark, d))


@query(f" SELECT file_id, g1 AS annotation_name, trim(g2) AS field_type, g3 AS field_name, line FROM {located(A.FIELD, 1, 2, 3, where=JV)}")
def injected_fields(spark, d):
    return A.injected_fields(sources(spark, d))


@query(" " + " UNION ALL ".join(f"SELECT file_id, '{name}' AS mock_type, {'trim(trim(g1), chr(34) || chr(39))' if some else 'NULL'} AS mock_target, line FROM {located(rx, *((1,) if some else ()), where=JS)}" for rx, name, some in A.MOCKS))
def mock_targets(spark, d):
    return A.mocks(sources(spark, d))


HAS = "CASE WHEN {0} THEN {1}"


@query(f""", {tests_sql()}, m AS (SELECT *, regexp_replace(test_name, '\\W', '.', 'g') AS plain FROM tests JOIN src USING (file_id)),
a AS (SELECT *, CASE language WHEN 'python' THEN regexp_matches(body, 'async\\s+def\\s+' || plain || '\\s*\\(') WHEN 'javascript' THEN regexp_matches(body, 'async\\s+\\([^)]*\\)\\s*=>') OR regexp_matches(body, 'async\\s+(?:function\\s+)?' || plain || '\\b') ELSE false END AS is_async FROM m)
SELECT file_id, test_name, line, CASE language WHEN 'python' THEN trim(regexp_extract(body, '(?s)def\\s+' || plain || '[^:]*:\\s*["'']{{3}}(.*?)["'']{{3}}', 1)) ELSE '' END AS description,
CASE language WHEN 'python' THEN array_to_string(regexp_extract_all(body, '@pytest\\.mark\\.(\\w+)', 1), ',') ELSE '' END AS markers, is_async,
CASE WHEN is_async THEN CASE WHEN language = 'python' THEN CASE WHEN contains(body, '@pytest.mark.asyncio') THEN 'pytest-asyncio' WHEN contains(body, 'asyncio.run') OR contains(body, 'await') THEN 'asyncio' ELSE 'pytest-asyncio' END
 WHEN contains(body, 'done()') OR contains(body, 'done =>') THEN 'callback' WHEN contains(body, 'Promise') THEN 'promise' ELSE 'async/await' END END AS async_pattern,
CASE WHEN starts_with(test_name, 'test_') THEN 'test_prefix' ELSE 'annotation_based' END AS pattern FROM a""")
def test_metadata(spark, d):
    rows = A.metadata(sources(spark, d)).drop("test_no")
    return rows.withColumn("markers", F.array_join("markers", ","))


#: Classes that production code declares, made of suppliers.
DECLARED = "CASE s_suppkey % 3 WHEN 0 THEN 'com.shop.service.Brand' WHEN 1 THEN 'com.shop.model.Brand' ELSE 'com.shop.Brand' END || CAST(s_suppkey AS {0})"
SUBPACKAGES = list(A.SUBPACKAGES)


@query(f""", declared AS (SELECT DISTINCT {DECLARED.format('VARCHAR')} AS production_class FROM supplier),
j AS (SELECT file_id, body, path, regexp_extract(body, '(?m)^package\\s+([\\w.]+)\\s*;', 1) AS package, regexp_extract(regexp_extract(body, '(?:public\\s+)?class\\s+(\\w+)', 1), '^(.+?)(?:Test|Tests)$', 1) AS own, regexp_extract(regexp_extract(path, '([^/]*?)(?:\\.[^./]*)?$', 1), '^(.+?)(?:Test|Tests)$', 1) AS named
  FROM src WHERE language = 'java' AND len(list_filter(regexp_extract_all(body, '(?m)^import\\s+([\\w.]+)\\s*;', 1), lambda m: NOT list_contains(['java', 'javax', 'sun', 'jdk'], string_split(m, '.')[1]) AND NOT regexp_matches(lower(m), '^(org\\.junit|org\\.mockito|junit|mockito)'))) = 0),
c AS (SELECT *, replace(package, '.test', '') AS pack, regexp_replace(replace(package, '.test', ''), '\\.[^.]*$', '') AS base FROM j),
e AS (SELECT file_id, list_concat([pack, own], list_transform({SUBPACKAGES}, lambda s: base || '.' || s || '.' || own), [base || '.' || own], list_transform({SUBPACKAGES[:5]}, lambda s: base || '.' || s || '.' || named)) AS every FROM c),
u AS (SELECT file_id, unnest(every) AS candidate, generate_subscripts(every, 1) AS no FROM e),
k AS (SELECT candidate, min(production_class) AS production_class FROM (SELECT production_class AS candidate, production_class FROM declared UNION SELECT regexp_extract(production_class, '([^.]*)$', 1), production_class FROM declared) GROUP BY 1)
SELECT file_id, k.production_class, candidate, 'inferred' AS reference_type FROM u JOIN k USING (candidate) WHERE NOT contains(lower(candidate), 'test') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY no) = 1""")
def java_inference(spark, d):
    """What Java tests without production imports stand for, among declared classes."""
    declared = load(spark, d, "supplier").select(F.expr(DECLARED.format("STRING")).alias("production_class"))
    return A.inferred_classes(sources(spark, d), declared)


#: Whole documents as files of three languages: as they are, and with a test's head for every end of a sentence.
FILES = """CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, '. ', '.' || chr(10) || '  def test_it(self): # ') ELSE replace(text, '. ', '.' || chr(10) || 'it("says so", () => { // ') END"""
FILE_LANGUAGE = "CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'python' ELSE 'javascript' END"
BEGINS = "CASE language " + " ".join(f"WHEN '{k}' THEN regexp_matches(line, {q('(?i)^[^\\S\\n]*(?:' + C.BOUNDARIES[k] + ')')})" for k in ("python", "javascript")) + f" ELSE regexp_matches(line, {q('(?i)^[^\\S\\n]*(?:' + C.OTHER + ')')}) END"
FILES_SQL = f"""f AS (SELECT doc_id AS file_id, {FILE_LANGUAGE} AS language, {FILES} AS body FROM documents WHERE text <> ''),
l AS (SELECT file_id, language, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS no FROM f),
o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY file_id ORDER BY no) - length(line) - 1 AS pos FROM l),
b AS MATERIALIZED (SELECT f.*, length(body) AS n, coalesce((SELECT list(CAST(pos AS BIGINT) ORDER BY pos) FROM o WHERE o.file_id = f.file_id AND pos > 0 AND {BEGINS}), []) AS marks FROM f)"""
STOP = """CASE WHEN n <= 2000 THEN n WHEN len(marks) > 0 THEN least({s} + 2000, coalesce(list_min(list_filter(marks, lambda x: x > {s})), n))
 WHEN {s} + 2000 >= n THEN n WHEN instr(reverse(substr(body, {s} + 2, 1999)), chr(10)) > 0 THEN {s} + 2001 - instr(reverse(substr(body, {s} + 2, 1999)), chr(10)) ELSE {s} + 2000 END"""


@query(f""", {FILES_SQL}, r AS (WITH RECURSIVE c AS (SELECT file_id, 0 AS chunk_no, CAST(0 AS BIGINT) AS start, CAST({STOP.format(s='0')} AS BIGINT) AS stop FROM b
 UNION ALL SELECT c.file_id, chunk_no + 1, c.stop, CAST({STOP.format(s='c.stop')} AS BIGINT) FROM c JOIN b USING (file_id) WHERE c.stop < n) SELECT * FROM c)
SELECT file_id, CAST(chunk_no AS INTEGER) AS chunk_no, CASE WHEN n <= 2000 THEN 'single' WHEN len(marks) = 0 THEN 'character_split' WHEN coalesce(list_min(list_filter(marks, lambda x: x > start)), n) - coalesce(list_max(list_filter(marks, lambda x: x <= start)), 0) <= 2000 THEN 'method_boundary' ELSE 'method_boundary_split' END AS chunk_type,
sha256(substr(body, start + 1, stop - start)) AS content_sha256, CAST(length(left(body, start)) - length(replace(left(body, start), chr(10), '')) + 1 AS INTEGER) AS start_line, CAST(length(left(body, stop)) - length(replace(left(body, stop), chr(10), '')) + 1 AS INTEGER) AS end_line FROM r JOIN b USING (file_id)""")
def chunk_files(spark, d):
    """Whole documents cut as test files."""
    docs = load(spark, d, "documents").where("text <> ''")
    files = docs.select(F.col("doc_id").alias("file_id"), F.expr(FILE_LANGUAGE).alias("language"), F.expr(FILES).alias("body"))
    return C.chunk(files).select("file_id", "chunk_no", "chunk_type", F.sha2("content", 256).alias("content_sha256"), "start_line", "end_line")


#: The sources as a repository: paths by language, some in excluded folders, some that are no tests.
REPO_PATH = "CASE WHEN file_id % 7 = 0 THEN 'build/' ELSE 'mod' || CAST(file_id % 5 AS {0}) || '/' END || CASE file_id % 4 WHEN 0 THEN 'e2e/' WHEN 1 THEN 'api/' ELSE 'src/' END || CASE language WHEN 'python' THEN 'test_' || CAST(file_id AS {0}) || '.py' WHEN 'javascript' THEN 'f' || CAST(file_id AS {0}) || CASE WHEN file_id % 2 = 0 THEN '.test.js' ELSE '.js' END ELSE 'F' || CAST(file_id AS {0}) || 'Test.java' END"
REPO = f"""repo AS (SELECT language, body, {REPO_PATH.format('VARCHAR')} AS path FROM src),
scanned AS (SELECT *, language <> 'javascript' OR regexp_matches(path, 'test[^/]*[.]js$') AS is_test, CASE WHEN contains(path, 'e2e') THEN 'e2e' WHEN contains(path, 'api') THEN 'integration' ELSE 'unit' END AS category FROM repo WHERE NOT starts_with(path, 'build/'))"""


def repository(spark, d):
    return sources(spark, d).select(F.expr(REPO_PATH.format("STRING")).alias("file_path"), F.col("body").alias("content"))


@query(f", {REPO} SELECT language, count(*) AS n_files, count(*) FILTER (is_test) AS n_tests, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM scanned GROUP BY 1 QUALIFY share >= 0.05")
def active_languages(spark, d):
    """The languages of a repository, by a scan with the built-in configuration."""
    return Z.detection_report(Z.scan(repository(spark, d), Z.built_in())).drop("frameworks")


@query(f""", {REPO} SELECT category, count(*) AS file_count, sum(CASE language WHEN 'python' THEN 2 WHEN 'javascript' THEN 3 ELSE 1 END)::BIGINT AS test_count, sum(len(string_split(body, chr(10))))::BIGINT AS total_lines FROM scanned WHERE is_test GROUP BY 1""")
def analyzed_structure(spark, d):
    """Categories with their files and tests, as the analyser maps them; of each source the number of tests is known."""
    return Z.analyze(repository(spark, d))["structure"]
