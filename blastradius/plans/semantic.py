"""Texts for embeddings and queries, references of sources, and the search terms of many diffs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import change as K
from ..operators import describe as W
from ..operators import extract as E
from ..operators import programs as P
from .extract import IMPORTS_SQL, SRC, sources
from .tables import REGISTRY, load, registry, sql
from .texts import diff_bodies

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def production_sql() -> str:
    out = []
    for lang, packages in E.TEST_PACKAGES.items():
        sep = "/" if lang == "javascript" else "."
        first = f"string_split(module, '{sep}')[1]"
        first = f"string_split({first}, '@')[-1]" if lang == "javascript" else first
        framework = " OR ".join(f"starts_with(lower(module), '{p}')" for p in packages)
        parts = f" OR list_has_any(string_split(lower(module), '{sep}'), {list(E.TEST_PARTS[lang])})" if E.TEST_PARTS[lang] else ""
        out.append(f"WHEN '{lang}' THEN NOT ({first} IN {tuple(E.STANDARD[lang])} OR {framework}{parts})")
    return "CASE language " + " ".join(out) + " ELSE true END"


@query(f"""WITH {SRC}, i AS (SELECT DISTINCT file_id, language, CASE language WHEN 'java' THEN regexp_replace(module, '\\.\\*$', '') WHEN 'javascript' THEN regexp_replace(module, '^@[^/]*/', '') ELSE module END AS module FROM ({IMPORTS_SQL}))
SELECT file_id, module, CASE WHEN language = 'java' AND NOT regexp_matches(string_split(module, '.')[-1], '^[A-Z]') THEN NULL WHEN language = 'javascript' THEN string_split(module, '/')[-1] ELSE nullif(string_split(module, '.')[-1], '') END AS class_name, 'direct_import' AS reference_type FROM i WHERE module <> '' AND {production_sql()}""")
def production_references(spark, d):
    return E.references(sources(spark, d))


def q(rx: str) -> str:
    return "'" + rx.replace("'", "''") + "'"


#: DuckDB: a long text as its assertions, calls and first lines, cut to 8000 characters at a blank.
ASSERTS = "list_concat(" + ", ".join(f"list_transform(regexp_extract_all(body, {q('(?im)' + rx)}, 0), lambda x: trim(x))" for rx in E.ASSERTIONS) + ")"
SUMMARY = f"""parts AS (SELECT test_id, body, {ASSERTS} AS a, list_filter(regexp_extract_all(body, {q(E.CALL)}, 0), lambda c: NOT regexp_matches(lower(c), {q(E.NOT_CALLS)})) AS c, left(array_to_string(string_split(body, chr(10))[:{E.SETUP_LINES}], chr(10)), {E.SETUP_CHARS}) AS setup FROM r),
lists AS (SELECT test_id, body, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), chr(10)) AS a, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i)[:{E.MOST_CALLS}], chr(10)) AS c, setup FROM parts),
whole AS (SELECT test_id, CASE WHEN length(body) < 200 AND NOT regexp_matches(body, 'def |assert |self\\.|import |=') THEN body ELSE concat_ws(chr(10) || chr(10), CASE WHEN a <> '' THEN 'Assertions:' || chr(10) || a END, CASE WHEN c <> '' THEN 'Function calls:' || chr(10) || c END, CASE WHEN setup <> '' THEN 'Setup:' || chr(10) || setup END) END AS w FROM lists),
told AS (SELECT test_id, CASE WHEN length(w) <= 8000 THEN w ELSE left(w, 8000) || '...' END AS told FROM whole)"""


@query(sql(REGISTRY) + f""", r AS (SELECT test_id, file_path, 'lib.' || language AS module, coalesce(class_name, '') AS class_name, test_type, language, trim(coalesce(text, '')) AS body, test_id % 3 AS mode FROM registry JOIN documents ON doc_id = test_id), {SUMMARY},
t AS (SELECT r.*, told, 'Identifiers: ' || concat_ws(' | ', CASE WHEN class_name <> '' THEN 'Class: ' || class_name END, 'File: ' || file_path) AS ids FROM r JOIN told USING (test_id))
SELECT test_id, sha256(trim(CASE mode
 WHEN 0 THEN concat_ws(chr(10), ids, CASE WHEN class_name <> '' THEN 'Component: ' || class_name END, 'Language: ' || language, CASE WHEN body <> '' THEN 'Test code: ' || CASE WHEN length(body) > 6000 THEN told ELSE body END END)
 WHEN 1 THEN concat_ws(chr(10), ids, 'Test file: ' || string_split(file_path, '/')[-1], 'Module: ' || module, 'Language: ' || language, 'Chunk 2 of 3', CASE WHEN body <> '' THEN 'Test code: ' || CASE WHEN length(body) > 500 THEN told ELSE body END END)
 ELSE concat_ws(chr(10), ids, CASE WHEN class_name <> '' THEN 'Component: ' || replace(replace(class_name, 'Test', ''), '_', ' ') END, CASE WHEN length(body) > 200 THEN 'Test code: ' || told WHEN body <> '' THEN 'Purpose: ' || body END, 'Module under test: ' || module, 'Test type: ' || test_type, 'Markers: slow, db', 'Async test') END)) AS body_sha256 FROM t""")
def embedding_text(spark, d):
    """What stands for each whole document as a test, a piece of a file, or a description."""
    body = load(spark, d, "documents").select(F.col("doc_id").alias("test_id"), F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    none = F.lit(None).cast("string")
    rows = registry(spark, d).join(body, "test_id").select(
        "test_id", none.alias("method_name"), "class_name", "file_path", F.element_at(F.split("file_path", "/"), -1).alias("file_name"), F.concat(F.lit("lib."), "language").alias("module"), "language",
        F.col("text").alias("content"), F.col("text").alias("description"), F.lit(1).alias("chunk_index"), F.when(F.col("test_id") % 3 == 1, 3).otherwise(1).alias("total_chunks"),
        "test_type", F.array(F.lit("slow"), F.lit("db")).alias("markers"), F.lit(True).alias("is_async"),
    )
    mode = F.when(F.col("test_id") % 3 == 0, "analysis").when(F.col("test_id") % 3 == 1, "chunk").otherwise("legacy")
    return rows.select("test_id", F.sha2(E.embedding_text(mode), 256).alias("body_sha256"))


@query("""WITH t AS (SELECT doc_id, trim(text) AS d, lang FROM documents)
SELECT doc_id, CASE WHEN d = '' THEN '' ELSE 'Code change (git diff):' || chr(10) || CASE WHEN len(d) <= 12000 THEN d ELSE left(d, 6000) || chr(10) || chr(10) || '... [diff truncated] ...' || chr(10) || chr(10) || right(d, 6000) END || CASE WHEN trim(lang) <> '' THEN chr(10) || chr(10) || 'Context: ' || trim(lang) ELSE '' END END AS anchor FROM t""")
def diff_anchor(spark, d):
    return load(spark, d, "documents").select("doc_id", E.diff_anchor(F.col("text"), F.col("lang")).alias("anchor"))


@query("""SELECT p_partkey, CASE WHEN p_size % 8 = 0 THEN p_name ELSE rtrim(p_name) || chr(10) || chr(10) || '[Diff symbols] ' || concat_ws(' ', CASE WHEN p_size % 2 = 1 THEN 'Removed or deleted symbols (tests may still reference these): ' || array_to_string(list_transform(range(0, p_size), lambda i: 's' || i)[:35], ', ') END,
 CASE WHEN p_size % 4 > 1 THEN 'Newly added symbols: ' || p_brand END, CASE WHEN p_size % 8 > 3 THEN 'Renamed symbols: a -> ' || p_type END) END AS query FROM part""")
def symbol_query(spark, d):
    none, s = F.array().cast("array<string>"), F.col("p_size")
    deleted = F.when(s % 2 == 1, F.transform(F.sequence(F.lit(0), s - 1), lambda i: F.concat(F.lit("s"), i.cast("string")))).otherwise(none)
    added, renamed = F.when(s % 4 > 1, F.array("p_brand")).otherwise(none), F.when(s % 8 > 3, F.array(F.concat(F.lit("a -> "), "p_type"))).otherwise(none)
    return load(spark, d, "part").select("p_partkey", E.with_symbols(F.col("p_name"), deleted, added, renamed).alias("query"))


#: Diffs of three kinds, made of parts: a changed function of a script, a changed function of a new Python file, and a renamed constant.
DIFF_OF = """CASE p_partkey % 3
WHEN 0 THEN 'diff --git a/src/' || t || '/' || n || '.js b/src/' || t || '/' || n || '.js' || chr(10) || '--- a/x' || chr(10) || '+++ b/x' || chr(10) || '@@ -60,3 +60,3 @@ function ' || b || '() {' || chr(10) || '-  return price(1);' || chr(10) || '+  return price(2);'
WHEN 1 THEN 'diff --git a/backend/' || t || '/' || n || '.py b/backend/' || t || '/' || n || '.py' || chr(10) || 'new file mode 100644' || chr(10) || '@@ -0,0 +1,2 @@' || chr(10) || '+def ' || b || '(x):' || chr(10) || '+    pass'
ELSE 'diff --git a/src/' || n || '.ts b/src/' || n || '.ts' || chr(10) || '@@ -10,1 +10,1 @@' || chr(10) || '-export const OLD_' || b || ' = 1' || chr(10) || '+export const NEW_' || b || ' = 1' END"""
PART_NAMES = "SELECT p_partkey, replace(p_name, ' ', '_') AS n, lower(p_type) AS t, lower(replace(p_brand, '#', '')) AS b FROM part"


def terms_of(b: K.Bundle) -> list[tuple[str, str]]:
    lists = {"exact": b.exact, "module_exact": b.module_exact, "module": b.modules, "function": [":".join(f) for f in b.functions], "deleted": b.deleted, "added": b.added, "renamed": [":".join(r) for r in b.renamed]}
    return [(k, v) for k, vs in lists.items() for v in vs]


def bundles(diffs: DataFrame) -> DataFrame:
    """diffs(diff_id, body) -> diff_id, kind, value: the search terms of many diffs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(i, *t) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in terms_of(K.bundle(text or ""))]
            ids, kinds, values = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["diff_id", "kind", "value"])

    return diffs.select("diff_id", "body").mapInArrow(run, "diff_id long, kind string, value string")


@query()
def diff_search_terms(spark, d):
    """The search terms of every document's diff."""
    return bundles(diff_bodies(spark, d))


@query(f"""WITH p AS ({PART_NAMES}), x AS (SELECT p_partkey % 3 AS k, p.* FROM p),
r AS (SELECT p_partkey, 'exact' AS kind, unnest(list_distinct([b, t || '.' || n, t, n])) AS value FROM x WHERE k = 0 UNION ALL SELECT p_partkey, 'exact', unnest(list_distinct([b, t || '.' || n, t])) FROM x WHERE k = 1
UNION ALL SELECT p_partkey, 'module_exact', unnest(list_distinct([t || '.' || n, t, n])) FROM x WHERE k = 0 UNION ALL SELECT p_partkey, 'module_exact', unnest(list_distinct([t || '.' || n, t])) FROM x WHERE k = 1
UNION ALL SELECT p_partkey, 'module', t || '.*' FROM x WHERE k < 2 UNION ALL SELECT p_partkey, 'function', t || '.' || n || ':' || b FROM x WHERE k < 2
UNION ALL SELECT p_partkey, 'added', b FROM x WHERE k = 1 UNION ALL SELECT p_partkey, 'renamed', 'OLD_' || b || ':NEW_' || b FROM x WHERE k = 2)
SELECT p_partkey AS diff_id, kind, value FROM r""")
def search_terms(spark, d):
    """The search terms of a table of diffs; the twin states them by rule."""
    return bundles(part_diffs(spark, d))


def part_diffs(spark, d):
    part = load(spark, d, "part").selectExpr("p_partkey", "replace(p_name, ' ', '_') as n", "lower(p_type) as t", "lower(replace(p_brand, '#', '')) as b")
    return part.select(F.col("p_partkey").alias("diff_id"), F.expr(DIFF_OF).alias("body"))


@query(f"""WITH p AS ({PART_NAMES})
SELECT p_partkey AS diff_id, CASE p_partkey % 3 WHEN 0 THEN 'Changed in module: ' || t || '.' || n || '. Changed functions: ' || b || '().' WHEN 1 THEN 'Changed in module: ' || t || '.' || n || '. Changed functions: ' || b || '(). File: backend/' || t || '/' || n || '.py. Status: New file.'
ELSE 'Changed file: ' || n || '. In: src. Changed symbols: NEW_' || b || '.' END AS description FROM p""")
def change_description(spark, d):
    """Each diff in words; the twin states them by rule."""
    diffs = part_diffs(spark, d)
    split = F.split("value", ":")
    functions = bundles(diffs).where("kind = 'function'").groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct(split[0].alias("module"), split[1].alias("function")))).alias("functions"))
    files = P.parse_diffs(diffs).groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct("file", "status", "classes", "methods"))).alias("files"))  # of one diff each
    rows = diffs.join(files, "diff_id", "left").join(functions, "diff_id", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    fs, xs = empty(F.col("functions"), "array<struct<module:string,function:string>>"), empty(F.col("files"), "array<struct<file:string,status:string,classes:array<string>,methods:array<string>>>")
    return rows.select("diff_id", W.description(fs, xs, F.col("body")).alias("description"))


@query(f"""WITH p AS ({PART_NAMES}), f AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS found FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45 GROUP BY 1)
SELECT p_partkey AS diff_id, coalesce(CASE WHEN p_partkey % 10 = 1 THEN 0.33::DOUBLE END, CASE WHEN coalesce(found, 0) = 0 THEN CASE WHEN p_partkey % 3 < 2 THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END ELSE 0.45::DOUBLE END) AS threshold,
coalesce(CASE WHEN p_partkey % 10 = 2 THEN 2 END, CASE WHEN coalesce(found, 0) = 0 THEN 5 WHEN p_partkey % 3 < 2 THEN 3 ELSE 4 END) AS variations FROM p LEFT JOIN f ON l_partkey = p_partkey""")
def adaptive_config(spark, d):
    """Threshold and number of query variations of each diff, by its terms and the tests that the index has for its part."""
    diffs, kind = part_diffs(spark, d), F.col("kind")
    terms = bundles(diffs).groupBy("diff_id").agg(F.count_if(kind == "function").alias("functions"), F.count_if(kind == "exact").alias("exact"), F.count_if(kind == "module").alias("modules"))
    found = load(spark, d, "lineitem").where("l_returnflag = 'A' AND l_quantity > 45").groupBy(F.col("l_partkey").alias("diff_id")).agg(F.countDistinct("l_orderkey").alias("found"))
    rows = diffs.select("diff_id").join(terms, "diff_id", "left").join(found, "diff_id", "left").na.fill(0)
    given, fixed = F.when(F.col("diff_id") % 10 == 1, 0.33), F.when(F.col("diff_id") % 10 == 2, 2)
    threshold, variations = W.adaptive(F.col("found"), F.col("functions"), F.col("exact"), F.col("modules"), F.lit(1), given, fixed)
    return rows.select("diff_id", threshold.alias("threshold"), variations.alias("variations"))


@query("""WITH l AS (SELECT trim(n_name) AS name, n_nationkey % 2 = 0 AS protected, sha256(n_name)[:8] AS commit_id, n_nationkey FROM nation WHERE n_nationkey < 20 AND trim(n_name) <> '' QUALIFY row_number() OVER (PARTITION BY trim(n_name) ORDER BY n_nationkey) = 1)
SELECT name, name = (SELECT trim(n_name) FROM nation WHERE n_nationkey = 22) AS is_default, protected, commit_id, name AS commit_message, false AS fetched FROM l
UNION ALL SELECT trim(n_name), n_nationkey = 22, n_nationkey % 2 = 0, sha256(n_name)[:8], trim(n_name), true FROM nation WHERE n_nationkey IN (22, 23) AND trim(n_name) NOT IN (SELECT name FROM l)""")
def branch_rows(spark, d):
    """Branches as listed, those that are wanted and weren't, and the one that is the default now."""
    n = load(spark, d, "nation")
    rows = n.select(F.concat(F.lit(" "), "n_name").alias("name"), F.lit(True).alias("is_default"), (F.col("n_nationkey") % 2 == 0).alias("protected"), F.sha2("n_name", 256).alias("commit_id"), F.trim("n_name").alias("commit_message"), F.col("n_nationkey").alias("place"))
    wanted = n.where("n_nationkey IN (3, 22, 23)").select(F.col("n_name").alias("name"))
    default = n.where("n_nationkey = 22").select(F.trim("n_name").alias("__default"))  # one row
    found = W.branches(rows.where("place < 20"), rows.where("place >= 20"), wanted, None).crossJoin(default)
    return found.withColumn("is_default", F.col("name") == F.col("__default")).drop("__default")
