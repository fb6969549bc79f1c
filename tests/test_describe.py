"""Changes in words, by hand."""

import pytest
from pyspark.sql import functions as F

from blastradius.operators import describe as W

FUNCTIONS = "array<struct<module:string,function:string>>"
FILES = "array<struct<file:string,status:string,classes:array<string>,methods:array<string>>>"
CASES = [
    ([("a.b", "f")], [("src/a/b.py", "added", ["K"], [])], "", "Changed in module: a.b. Changed functions: f(). File: src/a/b.py. Classes: K. Status: New file."),
    ([("a.b", "f"), ("a.b", "g")], [("x.js", "modified", [], [])], "", "Changed in module: a.b. Changed functions: f(), g(). Total functions changed: 2."),
    ([("a", "f"), ("b", "g"), ("a", "h")], [], "", "Changed across multiple modules:.   - a: f(), h().   - b: g(). Total functions changed: 3."),
    ([], [("top.json", "modified", [], []), ("src/x/Consts.ts", "modified", ["C"], ["m", "n"])], "+export const A = 1\n+// const NO\n+enum E {\n-const B\n+let A = 2", "Changed file: top. Changed file: Consts. In: x. Classes: C. Methods: m, n. Changed symbols: A, E."),
    ([], [], "", ""),
]


@pytest.mark.parametrize("functions, files, body, want", CASES)
def test_descriptions(spark, functions, files, body, want):
    row = spark.createDataFrame([(functions, files, body)], f"functions {FUNCTIONS}, files {FILES}, body string")
    assert row.select(W.description(F.col("functions"), F.col("files"), F.col("body")).alias("d")).first().d == want


def test_branches(spark):
    schema = "name string, is_default boolean, protected boolean, commit_id string, commit_message string, place int"
    listed = spark.createDataFrame([(" main ", True, None, "0123456789", "m" * 300, 1), ("main", False, True, "x", "later", 2), ("", None, None, None, None, 3), (None, None, None, None, None, 4), ("dev", None, True, None, None, 5)], schema)
    fetched = spark.createDataFrame([("rel", True, False, "abc", "r", 1), ("other", True, False, "abc", "r", 2)], schema)
    wanted = spark.createDataFrame([("rel",), ("dev",), ("none",)], "name string")
    got = {r.name: tuple(r)[1:] for r in W.branches(listed, fetched, wanted, "rel").collect()}
    assert got == {"main": (False, False, "01234567", "m" * 200, False), "dev": (False, True, "", "", False), "rel": (True, False, "abc", "r", True)}
    assert {r.name for r in W.branches(listed, fetched, wanted, None).where("is_default").collect()} == {"main", "rel"}
