"""Program analysis over sources that are written from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as E
from ..operators import programs as P
from .semantic import production_sql
from .tables import load
from .texts import diff_bodies

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
BODY = """CASE p_partkey % 3
WHEN 0 THEN 'import os' || chr(10) || 'from ' || lower(p_type) || '.core import ' || replace(p_name, ' ', '_') || chr(10) || '@pytest.fixture' || chr(10) || 'def fx():' || chr(10) || '    pass' || chr(10) || 'async def test_' || replace(p_name, ' ', '_') || '():' || chr(10) || '    svc.' || replace(p_name, ' ', '_') || '(1)' || chr(10) || 'def other():' || chr(10) || '    pass'
WHEN 1 THEN 'import x from "./' || lower(p_type) || '/api"' || chr(10) || 'jest.mock("a")' || chr(10) || 'it("' || p_name || '", () => { api.' || replace(p_name, ' ', '_') || '(); })' || chr(10) || 'test("more", () => { await api.load(); })'
ELSE 'import java.util.List;' || chr(10) || 'import com.' || lower(p_type) || '.Service;' || chr(10) || '@Autowired private Service svc' || chr(10) || '@Test public void ' || replace(p_name, ' ', '_') || '() { svc.run(); Class.forName("com.x.Y"); }' END"""
SRC = f"src AS (SELECT p_partkey AS file_id, list_extract(['python', 'javascript', 'java'], p_partkey % 3 + 1) AS language, {BODY} AS body FROM part)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = f"WITH {SRC} {oracle}"
        return f

    return add


def sources(spark, d):
    language = F.expr("element_at(array('python', 'javascript', 'java'), cast(p_partkey % 3 + 1 as int))")
    return load(spark, d, "part").select(F.col("p_partkey").alias("file_id"), language.alias("language"), F.expr(BODY).alias("body"))


def _found(table: dict[str, tuple[str, ...]]) -> str:
    """Distinct matches of a language's patterns, pattern by pattern."""
    every = {k: "list_concat(" + ", ".join(f"regexp_extract_all(body, '{p.replace(chr(39), chr(39) * 2)}', 1)" for p in table[k]) + ")" for k in ("python", "javascript", "java")}
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in every.items()) + " END"


FIRST = "list_filter(v, lambda x, i: list_position(v, x) = i)"


@query(f"SELECT file_id, generate_subscripts({FIRST}, 1)::INT - 1 AS ordinal, unnest({FIRST}) AS test_name FROM (SELECT file_id, {_found(E.TESTS)} AS v FROM src)")
def extract_tests(spark, d):
    return P.tests(sources(spark, d))


@query(f"SELECT DISTINCT file_id, module, {production_sql()} AS production FROM (SELECT file_id, language, unnest({_found(E.IMPORTS)}) AS module FROM src)")
def extract_imports(spark, d):
    return P.imports(sources(spark, d))


@query(f"SELECT DISTINCT file_id, unnest(regexp_extract_all(body, '{P.CALL}', 1)) AS object, unnest(regexp_extract_all(body, '{P.CALL}', 2)) AS function FROM src")
def extract_calls(spark, d):
    return P.calls(sources(spark, d))


@query(f"SELECT file_id, len(regexp_extract_all(body, '{P.DECORATOR}')) AS n_decorators, len(regexp_extract_all(body, '{P.MOCK}')) AS n_mocks, len(regexp_extract_all(body, '{P.REFLECTION}')) AS n_reflection, len(regexp_extract_all(body, '{P.INJECTED}')) AS n_injected, regexp_matches(body, '{P.ASYNC}') AS is_async FROM src")
def language_features(spark, d):
    return P.flags(sources(spark, d))


@query()
def parse_source(spark, d):
    return P.parse_sources(sources(spark, d))


@query()
def test_bodies(spark, d):
    return P.bodies(sources(spark, d))


@query()
def diff_parse(spark, d):
    return P.parse_diffs(diff_bodies(spark, d))
