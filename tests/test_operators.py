"""Hand-checked cases: scoring traps, diffs, program analysis, sources, streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from blastradius.functions import text as X
from blastradius.operators import change as K
from blastradius.operators import diff as D
from blastradius.operators import extract as E
from blastradius.operators import lookup as L
from blastradius.operators import mutation as M
from blastradius.operators import plugins as PL
from blastradius.operators import programs as P
from blastradius.operators import score as C
from blastradius.operators import stats as S
from blastradius.operators import store as ST
from blastradius.operators import vector as V
from blastradius.sources import files


def score(spark, rows, kind):
    ev = spark.createDataFrame([(1, i, t, ref, src, sim, None, False) for i, (t, ref, src, sim) in enumerate(rows)], C.EVIDENCE)
    out = C.confidence(C.profile(ev).withColumn("test_type", F.lit(kind))).first()
    return out["ast"], out["score"]


@pytest.mark.parametrize(
    ("rows", "kind", "want"),
    [
        ([("function_level", None, "patch_ref", None)], "unit", (100, 60)),
        ([("exact", "direct_import", None, None)], "unit", (80, 48)),
        ([("exact", "transitive_import", None, None)], "e2e", (58, 34)),
        ([("module", "direct_import", None, None)], "e2e", (40, 24)),
        ([("exact", "direct_import", None, None), ("module", "direct_import", None, None)], "e2e", (80, 48)),
        ([("direct_file", None, None, None)], "e2e", (45, 45)),
        ([("semantic", None, None, 0.65)], "e2e", (0, 26)),
    ],
)
def test_scores(spark, rows, kind, want):
    assert score(spark, rows, kind) == want


def test_double_arithmetic(spark):
    got = spark.createDataFrame([(6, 1), (31, 1), (48, 3)], "a int, v int").select(F.floor(F.col("a") * F.lit(0.6) + F.col("v") * F.lit(0.4)).alias("t"))
    assert [r["t"] for r in got.collect()] == [3, 18, 29]
    sims = spark.createDataFrame([(s,) for s in (0.29, 0.57, 0.58)], "s double").select(F.floor(F.col("s") * F.lit(100.0)).alias("t"))
    assert [r["t"] for r in sims.collect()] == [28, 56, 57]


def test_no_evidence_has_no_score(spark):
    assert C.profile(spark.createDataFrame([], C.EVIDENCE)).count() == 0


def test_top_p_excludes_the_row_that_crosses(spark):
    rows = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2), (0, 3, 0.7, 3)], "query_id int, vec_id int, similarity double, rank int")
    assert [r["vec_id"] for r in V.top_p(rows, 1.8).collect()] == [1, 2]


def test_zero_norm_is_zero(spark):
    row = spark.sql("SELECT array(0.0D, 0.0D) AS a, array(1.0D, 2.0D) AS b")
    assert row.select(V.cosine(F.col("a"), F.col("b"), V.norm(F.col("a")) * V.norm(F.col("b"))).alias("c")).first()["c"] == 0.0


def test_symbol_kinds(spark):
    index = spark.createDataFrame([("a.b.c",), ("b",), ("x.b",), ("b.y",)], "production_class string")
    got = L.match_symbols(index, "production_class", spark.createDataFrame([("b",)], "term string"))
    assert {(r["symbol"], r["kind"]) for r in got.collect()} == {("b", 1), ("b.y", 2), ("x.b", 3)}


def test_closure_keeps_the_smallest_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("c", "a")], "src string, dst string")
    got = {r["node"]: r["depth"] for r in L.closure(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}


def test_tokens(spark):
    row = spark.range(1).select(X.tokenize(F.lit("parseXMLFile_v2 isOK")).alias("t")).first()
    assert row["t"] == ["parse", "xml", "file"]


DIFF = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -10,3 +10,4 @@ def outer():
 x = 1
-y = 2
+y = 3
+class New:
@@ -30,1 +31,3 @@ def other():
+def fresh():
+    return 1
diff --git a/b.js b/b.js
new file mode 100644
--- /dev/null
+++ b/b.js
@@ -0,0 +1,2 @@
+export const make = () => 1
+const z = 2
"""


def test_parse_diff():
    a, b = P.parse_diff(DIFF)
    assert (a["file"], a["status"], a["additions"], a["deletions"], a["classes"], a["methods"]) == ("src/a.py", "modified", 4, 1, ["New"], ["outer", "fresh"])
    assert a["changed_lines"] == [11, 11, 12, 31, 32]
    assert (b["file"], b["status"], b["additions"], b["methods"]) == ("b.js", "added", 2, ["make"])
    assert P.parse_diff("") == []


def test_diff_operators(spark):
    table = D.lines(spark.createDataFrame([(1, "diff --git a/f b/f\n-export const OLD = 1\n-x\n+export const NEW = 1\n-class Gone\n+# note")], "k int, body string"), "k", "body")
    assert [tuple(r) for r in D.renames(table, "k").collect()] == [(1, "OLD", "NEW")]
    delta = {(r["symbol"], r["change"]) for r in D.symbol_delta(table, "k", K.DECLARATIONS, K.PROPERTY).collect()}
    assert delta == {("Gone", "deleted")}  # renamed names neither come nor go
    stats = D.file_stats(table, "k").first()
    assert (stats["file"], stats["additions"], stats["deletions"]) == ("f", 2, 3)


def test_parse_python_and_bodies():
    body = "class A:\n    '''Doc.'''\n    async def test_x(self):\n        a.b()\n\n    def other(self):\n        pass\n"
    assert [x[:3] for x in P.parse_python(body)] == [("A", "class", 1), ("test_x", "test", 3), ("other", "function", 6)]
    assert P.parse_python("def (") == []
    assert P.cut_body(body, body.index("def test_x")) == "def test_x(self):\n        a.b()"
    assert P.cut_body("it('a', () => { f('}'); }) x", 0) == "it('a', () => { f('}'); }"


def test_mutations(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {tuple(r) for r in M.upsert_coalesce(old, new, "k", ["v"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {r["k"] for r in M.delete(old, new, "k").collect()} == {1}


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "node_modules").mkdir(parents=True)
    (tmp_path / "in" / "a.py").write_text("x\ny")
    (tmp_path / "in" / "node_modules" / "b.py").write_text("z")
    assert [r["content"] for r in files.scan(spark, str(tmp_path / "in"), "*.py").collect()] == ["x\ny"]
    assert files.whole_texts(spark, str(tmp_path / "in" / "a.py")).first()["line_count"] == 2
    (tmp_path / "d.json").write_text('{"generated_at": "t",\n "data": [{"id": 1}, {"id": 2}]}')
    assert [r["id"] for r in files.read_documents(spark, str(tmp_path / "d.json"), "id: long").orderBy("id").collect()] == [1, 2]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("k/t.txt", "hello")
    first = files.ingest_archive(str(tmp_path / "z.zip"), str(tmp_path / "out"))
    assert files.ingest_archive(str(tmp_path / "z.zip"), str(tmp_path / "out")) == first
    assert (tmp_path / "out" / first / "k" / "t.txt").read_text() == "hello"
    files.write_documents(spark.range(5).coalesce(1), str(tmp_path / "out.json"), "now", 2)
    back = spark.read.json(str(tmp_path / "out.json"))
    assert sorted(len(r["data"]) for r in back.collect()) == [1, 2, 2] and {r["generated_at"] for r in back.collect()} == {"now"}
    for name, tests in (("js", [1, 2]), ("py", [3])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "03_test_registry.json").write_text('{"generated_at": "t", "data": {"tests": [' + ", ".join(f'{{"test_id": {t}}}' for t in tests) + "]}}")
    merged = files.merge_analyzers(spark, [str(tmp_path / n) for n in ("js", "py", "none")], "tests", "test_id: long")
    assert sorted(tuple(r) for r in merged.collect()) == [("js", 1), ("js", 2), ("py", 3)]
    assert files.merge_analyzers(spark, [str(tmp_path / "js")], "calls", "test_id long").count() == 0
    assert files.namespace_of(first) == f"test_repo_{first[:8]}" and files.namespaces("a", [" b ", ""], "c") == ["b"] and files.namespaces(" ", [], "c") == ["c"]
    (tmp_path / "p").mkdir()
    for n, t in (("b.diff", "+b\n"), ("a.diff", "+a")):
        (tmp_path / "p" / n).write_text(t)
    assert files.diff_text(spark, str(tmp_path / "p")) == "+a\n+b"
    assert files.valid_namespace("test_repo_1") and not files.valid_namespace("a-b") and not files.valid_namespace("")
    assert files.table_columns(spark, "no_such_table") == []


def test_kinds_of_change(spark):
    assert [K.kind(*x) for x in [("deleted", True, 1, [60]), ("added", False, 0, []), ("modified", False, 0, [3]), ("modified", False, 2, [3, 50]), ("modified", False, 2, [3, 51]), ("modified", True, 0, [3]), ("modified", False, 1, [])]] == [
        "deleted", "added", "comment_only", "import_only", "code", "code", "code",
    ]
    head = "diff --git a/{0} b/{0}\n"
    diffs = [
        (1, head.format("a.js") + "@@ -10,2 +10,3 @@\n x\n+y = 1\n+z = 2"), (2, head.format("a.js") + "@@ -50,2 +50,3 @@\n x\n+y = 1"), (3, head.format("a.js") + "@@ -1 +1 @@\n-// gone"),
        (4, head.format("a.js") + "@@ -1 +1 @@\n-class A {"), (5, head.format("a.js") + "deleted file mode 100644\n@@ -1 +0,0 @@\n-class A {"), (6, head.format("a.js") + "new file mode 100644"),
    ]
    table = D.lines(spark.createDataFrame(diffs, "k int, body string"), "k", "body")
    assert {r["k"]: r["change_type"] for r in D.change_type(table, "k").collect()} == {1: "import_only", 2: "code", 3: "comment_only", 4: "code", 5: "deleted", 6: "added"}
    assert [(r["k"], r["number"]) for r in D.numbered(table, "k").where("k < 4").orderBy("k", "line_no").collect()] == [(1, 11), (1, 12), (2, 51), (3, 1)]


def test_module_names_and_test_names():
    assert K.modules("backend/agent/pool.py") == ["agent.pool", "agent"]
    assert K.modules("src/components/ChatPage.tsx") == ["components.ChatPage", "components", "ChatPage"]
    assert K.modules("src/promo.js") == ["promo"] and K.modules("notes.md") == [] and K.modules("lib/build/x.js") == [] and K.modules("a/pool_test.py") == []
    assert K.test_names("agent/pool.py") == ["agent_pool_test.py", "pool_test.py", "test_agent_pool.py", "test_pool.py"]
    assert K.is_cochanged(["src/a.js", "tests/a.test.js"]) and not K.is_cochanged(["src/a.js", "src/b.js"]) and not K.is_cochanged(["tests/a.test.js", "readme.md"])


BUNDLE = """diff --git a/src/reducers/cart.js b/src/reducers/cart.js
--- a/src/reducers/cart.js
+++ b/src/reducers/cart.js
@@ -70,2 +70,3 @@
-export const oldName = 1
+export const newName = 1
+function addItem() {
-  total: 3,
diff --git a/src/only/imports.js b/src/only/imports.js
--- a/src/only/imports.js
+++ b/src/only/imports.js
@@ -1,1 +1,1 @@
-import a from 'a'
+import b from 'b'
diff --git a/lib/fresh.py b/lib/fresh.py
new file mode 100644
--- /dev/null
+++ b/lib/fresh.py
@@ -0,0 +1,2 @@
+def start():
+    return 1
"""


def test_search_terms_of_a_diff():
    b = K.bundle(BUNDLE)
    assert b.files == ("lib/fresh.py", "src/only/imports.js", "src/reducers/cart.js")
    assert b.module_exact == ("cart", "lib", "lib.fresh", "reducers.cart")  # no general folder by itself
    assert b.modules == ("lib.*",) and b.stems == ("cart", "fresh")
    assert b.functions == (("lib.fresh", "start"), ("reducers.cart", "addItem"), ("reducers.cart", "newName"), ("reducers.cart", "oldName")) or b.functions == (("lib.fresh", "start"), ("reducers.cart", "addItem"))
    assert b.deleted == ("total",) and b.added == ("addItem", "start") and b.renamed == (("oldName", "newName"),)
    assert set(b.exact) >= {"cart", "lib", "lib.fresh", "reducers.cart", "addItem", "start", "total"}
    assert "cart" in b.tokens() and "item" in b.tokens() and "add" not in b.tokens()


def test_headerless_hunks_are_dealt_to_files():
    hunks = "@@ -1,1 +1,1 @@\n+a\n@@ -5,1 +5,1 @@\n+b\n@@ -9,1 +9,2 @@\n+c\n-d\n@@ -20,1 +20,1 @@\n+e\n@@ -30,1 +30,1 @@\n-f"
    got = P.parse_diff(hunks, ["x.js", "", "y.js"])
    assert [(g["file"], g["additions"], g["deletions"], g["changed_lines"]) for g in got] == [("x.js", 2, 0, []), ("y.js", 2, 2, [])]
    assert [(g["file"], g["additions"]) for g in P.parse_diff("@@ -1,1 +1,1 @@\n+a", ["x.js", "y.js"])] == [("x.js", 1), ("y.js", 0)]


def test_headers_from_status():
    got = K.with_status([
        {"new_path": "a.js", "old_path": "a.js", "status": "added", "diff": "@@ -0,0 +1 @@\n+x"}, {"old_path": "b.js", "status": "removed", "diff": "@@ -1 +0,0 @@\n-y\n-z"}, {"new_path": "c.bin"},
    ])
    assert (got["changed_files"], got["additions"], got["deletions"]) == (["a.js", "b.js", "c.bin"], 1, 2)
    assert [(c["file"], c["status"], c["additions"], c["deletions"]) for c in P.parse_diff(got["diff"])] == [("a.js", "added", 1, 0), ("b.js", "deleted", 0, 2)]
    assert K.with_status([{"new_path": "a", "diff": "diff --git a/a b/a\n+q", "added_lines": 5}])["additions"] == 5


def test_suites(spark):
    paths = {"app/unit/tests/foo/x.js": "unit", "tests/a.py": "a.py", "tests/unit/a.py": "unit", "a/test//b.js": "root", "src/e2e": "e2e", "src/a.js": "other", "a/contests/b.js": "other", None: "other", "x\\tests\\ui\\a.js": "ui", "tests": "other"}
    rows = spark.createDataFrame([(k, v) for k, v in paths.items()], "path string, want string")
    assert [r for r in rows.select("path", "want", S.suite(F.col("path")).alias("got")).collect() if r["want"] != r["got"]] == []


def test_paths_and_stems(spark):
    paths = {"c:\\x\\test_repository\\unit\\a.py": "unit/a.py", "x/unit/a.py": "unit/a.py", "x/src1/a.py": "a.py", "a.py": "a.py", "test_repository": ""}
    rows = spark.createDataFrame([(k, v) for k, v in paths.items()], "path string, want string")
    assert [r for r in rows.select("path", "want", X.normalize_path(F.col("path")).alias("got")).collect() if r["want"] != r["got"]] == []
    assert X.stems(("src/index.js", "a/Constants.ts", "lib/toastReducer.js", "x/hooks.js", "b\\test.js")) == ["constants", "toastreducer", "test"]
    one = spark.range(1)
    pats = lambda c: one.select(c.alias("p")).first()["p"]
    assert pats(X.dead_zone_patterns(F.lit("cart"), F.lit("src/a/cart.js"))) == ["%a/cart.js%", "%cart%"]
    assert pats(X.dead_zone_patterns(F.lit("utils"), F.lit("utils.js"))) == ["utils.%", "%.utils"]
    assert pats(X.symbol_patterns(F.lit("a.b.cartItem"))) == ["a.b.cartItem", "a.b.cartItem.%", "%.a.b.cartItem", "%cartItem%"]
    assert pats(X.symbol_patterns(F.lit("a.api"))) == ["a.api", "a.api.%", "%.a.api", "api.%", "%.api"]


def test_module_patterns(spark):
    rows = [(1, "m", "describe_label"), (2, "m.a", "transitive_normalized"), (3, "m.a", "source_annotation"), (4, "mm.a", "direct_import"), (5, "m", "source_annotation_normalized"), (6, "m.C", "describe_label")]
    index = spark.createDataFrame(rows, "test_id long, production_class string, reference_type string")
    got = lambda *a: sorted((r["test_id"], r["exact_priority"], r["ref_priority"]) for r in L.module_pattern(index, "m", *a).collect())
    assert got() == [(1, 1, 3), (2, 2, 2), (5, 1, 3)]
    assert got("specific", ("m.C",)) == [(5, 1, 3), (6, 2, 3)]
    assert sorted(r["test_id"] for r in L.module_pattern(index, "m", "broad").collect()) == [2, 3, 6]


def test_confidence_gate(spark):
    ev = [
        (1, 1, "semantic", None, None, 0.9, None, False), (2, 1, "semantic", None, None, 0.9, None, False), (3, 1, "exact", "direct_import", None, None, None, True), (4, 1, "exact", "direct_import", None, None, None, True),
        (5, 1, "direct_file", None, None, None, "colocated_in_same_file", False), (6, 1, "semantic_colocation", None, None, None, "semantic_colocated_file", False), (7, 1, "exact", "transitive_import", None, None, None, False),
        (8, 1, "exact", "transitive_import", None, None, None, False), (8, 2, "semantic", None, None, 0.2, None, False), (9, 1, "semantic", None, None, 0.1, None, False),
    ]
    labels = {1: "payment flow", 2: "CartItem adds", 3: "payment flow", 4: "cart_total", 5: "cart", 6: "other", 7: "cart", 8: "other", 9: None}
    known = spark.createDataFrame([(i, "unit", label) for i, label in labels.items()], "test_id long, test_type string, label string")
    rows = C.confidence(C.profile(spark.createDataFrame(ev, C.EVIDENCE)).join(known, "test_id"))
    fits = C.relevant(F.col("label"), ["cart"])
    risk = {r["test_id"]: r["r"] for r in rows.select("test_id", C.false_positive_risk(fits).alias("r")).collect()}
    assert {r["test_id"] for r in rows.where(C.keep(fits, fits)).collect()} == {2, 4, 6, 8, 9}
    assert risk[1] == "HIGH" and risk[2] == "MEDIUM_HIGH" and risk[3] == "LOW"


def test_scenarios(spark):
    head = "diff --git a/{0} b/{0}\n@@ -1 +1 @@\n"
    diffs = [
        (1, head.format("a.js") + "+if (x == null) return\n+y?.z\n+q"), (2, "".join(head.format(f"f{i}.js") for i in range(12))), (3, head.format("a.js") + head.format("b.py") + "+def f():"),
        (4, head.format("a.md") + head.format("b.js") + "+q"), (5, "".join(head.format(f"f{i}.js") for i in range(5)) + "\n".join(f"+class C{i}:" for i in range(20))),
    ]
    table = D.lines(spark.createDataFrame(diffs, "k int, body string"), "k", "body")
    got = {r["k"]: r["t"] for r in D.scenario(table, "k", K.SOURCE).select("k", D.scenario_tags().alias("t")).collect()}
    assert got == {1: ["TIGHT_FEATURE_ISOLATION", "MICRO_GUARD_HOTFIX"], 2: ["MAXIMUM_BLAST_RADIUS"], 3: ["MIXED_LANGUAGE_DIFF", "SYMBOL_LEVEL_CHANGES"], 4: [], 5: ["MAXIMUM_BLAST_RADIUS"]}


def test_ids_are_allocated_in_order(spark):
    new = spark.createDataFrame([(i * i % 1009,) for i in range(1, 400)], "k long").distinct()
    got = M.allocate(new, "k", spark.sql("SELECT 9998L AS last_id"), runs=7).orderBy("k").collect()
    assert [r["new_id"] for r in got] == [f"test_{9999 + i:04d}" for i in range(len(got))]


def test_flagship_has_all_kinds(spark):
    from blastradius.plans import registry

    kinds = {r["match_type"] for r in registry.QUERIES["select_entities"](spark, "/root/testdata/sf0.001").select("match_type").distinct().collect()}
    assert kinds == {"Both", "AST", "Semantic"}


def test_paths_of_tests(spark):
    rows = [
        ("a/test_x.py", "python", True, True, "unit", "unit"), ("a/x.py", "python", True, False, "unit", "unit"), ("node_modules/x.test.js", "javascript", False, True, "unit", "unit"),
        ("api/UserTest.JAVA", "java", True, True, "integration", "unit"), ("cypress/Integration/x.spec.tsx", "typescript", True, True, "e2e", "integration"), ("x/acceptance/t.py", "python", True, False, "e2e", "e2e"),
        ("build", None, True, False, "unit", "unit"), ("README", None, True, False, "unit", "unit"), ("w\\e2e\\a_test.go", "go", True, True, "e2e", "e2e"), ("a.b/c", None, True, False, "unit", "unit"),
    ]
    df = spark.createDataFrame(rows, "path string, lang string, scan boolean, test boolean, category string, type string")
    p = F.col("path")
    got = df.select("path", E.language_of(p), E.should_scan(p), E.is_test_file(p), E.category(p), E.test_type(p, F.coalesce(E.language_of(p), F.lit(""))))
    assert [tuple(r) for r in got.collect()] == rows


def test_tests_of_every_language(spark):
    bodies = {
        "python": ("async def test_a():\n  pass\ndef helper(): pass\nclass X:\n  def testB(self): pass", ["test_a", "testB"]),
        "java": ("@Test\npublic void one() {}\n@Test(x = 1)\nvoid testTwo() {}\nprotected void testThree() {}\nvoid four() {}", ["one", "testTwo", "testThree"]),
        "javascript": ("it('one', f)\ntest(\"two\", g)\ndescribe(`box`, h)\nit.each([1, 2])('row %s', k)\nsubmit('x')", ["one", "two", "box", "row %s"]),
        "kotlin": ("@Test fun testA() {}\nfun testB() {}\nfun other() {}", ["testA", "testB"]),
        "go": ("func TestA(t *testing.T) {}\nfunc TestB(b *testing.B) {}", ["TestA"]),
        "ruby": ("it 'works' do\ndef test_b", ["works", "test_b"]),
        "csharp": ("[Fact]\npublic void One() {}\n[Theory] async Task Two() {}\npublic void Three() {}", ["One", "Two"]),
        "c": ("void test_a(void) {}\nstatic void test_b(void) {}", ["test_a"]),
        "cpp": ("TEST(S, A) {}\nTEST_P(S, B) {}\nTYPED_TEST(S, C) {}\ninline void test_d() {}", ["A", "C", "B", "test_d"]),
    }
    df = spark.createDataFrame([(i, k, v[0]) for i, (k, v) in enumerate(bodies.items())], "file_id long, language string, body string")
    got = {}
    for r in E.declared_tests(df).orderBy("file_id", "ordinal").collect():
        got.setdefault(r["language"], []).append(r["test_name"])
    assert got == {k: v[1] for k, v in bodies.items()}
    plugged = {(r["language"], r["test_name"]) for r in PL.scan(df).collect()}
    assert {("go", "TestA"), ("cpp", "B"), ("ruby", "works")} <= plugged


def test_references_and_production(spark):
    bodies = [
        (1, "python", "import os\nimport app.core\nfrom app.tests import x\nfrom pytest_cov import y\nmock.patch('app.core.Run')"),
        (2, "java", "import java.util.List;\nimport com.x.Login;\nimport com.y.*;\nimport org.junit.Test;\nClass.forName(\"com.z.Late\")"),
        (3, "javascript", "require('fs')\nimport './lib/cart'\nrequire('@scope/pay')\nrequire('jest-x')\nimport('./spec/a')"),
    ]
    got = {tuple(r) for r in E.references(spark.createDataFrame(bodies, "file_id long, language string, body string")).collect()}
    assert got == {
        (1, "app.core", "core", "direct_import"), (1, "app.core.Run", "Run", "string_ref"), (2, "com.x.Login", "Login", "direct_import"), (2, "com.y", None, "direct_import"), (2, "com.z.Late", "Late", "string_ref"),
        (3, "./lib/cart", "cart", "direct_import"), (3, "pay", "pay", "direct_import"),
    }


def test_chunks_by_test(spark):
    body = "import a\ndescribe('Box', () => {\n  it('one', () => {\n    x()\n  })\n\n  test('two', () => {})\n})\n"
    df = spark.createDataFrame([(1, "javascript", body), (2, "python", "x = 1"), (3, "python", "def test_a(): pass\n\nclass TestB:\n  def test_c(self):\n    pass"), (4, "other", "it('a')")], "file_id long, language string, body string")
    got = [tuple(r) for r in E.chunks_by_test(df).orderBy("file_id", "chunk_no").collect()]
    assert got == [
        (1, 0, "  it('one', () => {\n    x()\n  })\n\n", 3, 7, "one", ""), (1, 1, "  test('two', () => {})\n})\n", 7, 9, "two", ""), (3, 0, "  def test_c(self):\n    pass", 4, 5, "test c", ""),
    ]


def test_inverted_index_has_five_sources(spark):
    dep = [(1, "../lib/cart.js", "direct_import", "Cart with items"), (1, "src/deep.js", "transitive_import", "Cart with items"), (2, "notes", "source_annotation", ""), (2, "x/notes", "source_annotation", None)]
    deps = spark.createDataFrame(dep, "test_id long, referenced_class string, reference_type string, class_name string")
    calls = spark.createDataFrame([(1, "cart", None), (2, "pay", "patch_ref"), (2, "", None)], "test_id long, module_name string, source string")
    got = sorted(tuple(r) for r in E.inverted_rows(deps, calls, X.label_head(F.col("class_name"))).collect())
    assert got == sorted([
        ("../lib/cart.js", 1, "direct_import"), ("cart", 1, "normalized_import"), ("src/deep.js", 1, "transitive_import"), ("deep", 1, "transitive_normalized"), ("notes", 2, "source_annotation"),
        ("x/notes", 2, "source_annotation"), ("notes", 2, "source_annotation_normalized"), ("cart", 1, "method_call"), ("pay", 2, "patch_ref"), ("Cart", 1, "describe_label"), ("Cart with items", 1, "describe_label"),
    ])


def test_texts_for_embeddings(spark):
    code = "def test_a():\n    assert run(1) == 2\n    pay(3)\n" + "# filler words here\n" * 400
    got = spark.createDataFrame([(code,)], "body string").select(E.summarized(F.col("body")).alias("t")).first()["t"]
    assert got.startswith("Assertions:\nassert run(1) == 2\n\nFunction calls:\ntest_a()\nrun(1)\npay(3)\n\nSetup:\ndef test_a():") and len(got) < 800
    cut = spark.createDataFrame([("aa " * 40,), ("a" * 120,), ("short",)], "t string").select(E.cut_at_blank(F.col("t"), 100).alias("t"))
    assert [r["t"] for r in cut.collect()] == ["aa " * 32 + "aa...", "a" * 100 + "...", "short"]


def test_stores(spark, tmp_path):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 1), (2, "z", 3), (2, "y", 2)], "k int, v string, o int")
    assert sorted(tuple(r) for r in ST.insert_ignore(old, new, ["k"], "o").collect()) == [(1, "a"), (2, "y")]
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, n int")
    changes = spark.createDataFrame([(1, None, 9), (3, "q", 1)], "k int, v string, n int")
    assert sorted(tuple(r) for r in ST.partial_update(base, changes, "k").collect()) == [(1, "a", 9), (2, "b", 6)]
    for _ in range(2):
        ST.append(old, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_plugins(spark, tmp_path):
    PL.LANGUAGES.add("zig", PL.Language("zig", (".zig",), (r'test "([^"]+)"',), (r'@import\("([^"]+)"\)',), r"^std$"))
    try:
        df = spark.createDataFrame([(1, "zig", 'const s = @import("std"); const c = @import("cart"); test "adds" {}')], "file_id long, language string, body string")
        assert [r["test_name"] for r in PL.scan(df).collect()] == ["adds"]
        assert {(r["module"], r["production"]) for r in PL.imports(df).collect()} == {("std", False), ("cart", True)}
        assert spark.createDataFrame([("x.zig",), ("x.py",), ("x.md",)], "p string").select(PL.language_of(F.col("p")).alias("l")).collect() == [("zig",), ("python",), (None,)]
        with pytest.raises(ValueError, match="known already"):
            PL.LANGUAGES.add("zig", None)
        with pytest.raises(KeyError, match="no model"):
            PL.MODELS.get("none")
    finally:
        PL.LANGUAGES.known.pop("zig")
    store = PL.STORES.get("parquet")(spark, str(tmp_path / "vectors"), 2)
    store.upsert(spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [1.0, 1.0])], "id int, repo string, embedding array<float>"))
    store.upsert(spark.createDataFrame([(4, "a", [1.0, 0.1])], "id int, repo string, embedding array<float>"))
    found = store.search(spark.createDataFrame([(0, 1.0, [1.0, 0.0])], "query_id int, weight double, q array<float>"), 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [4, 3]
    with pytest.raises(Exception, match="another dimension"):
        store.upsert(spark.createDataFrame([(9, "c", [1.0])], "id int, repo string, embedding array<float>"))
    store.delete_repository("a")
    assert [r["id"] for r in store.rows().collect()] == [3]
    model = PL.MODELS.get("hashing")(8)
    assert len(model.embed(spark.createDataFrame([(1, "some words")], "test_id long, body string")).first()["embedding"]) == 8
    assert model.chat(spark.createDataFrame([(1, "hi")], "prompt_id long, prompt string")).first()["answer"] is None


def test_first_failures(spark, tmp_path):
    from blastradius.streaming.incremental import first_failures

    kinds = ["error", "error", "view", "error", "error", "error", "error"]
    rows = [(7, i, f"2024-01-01 00:00:{i:02d}", k) for i, k in enumerate(kinds)] + [(8, 50, "2024-01-01 00:00:50", "error")]
    for part, some in enumerate((rows[:5], rows[5:])):
        spark.createDataFrame(some, "user_id long, event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = first_failures(stream).writeStream.format("memory").queryName("failures").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("failures").collect()] == [(7, 5, 3)]


def test_upsert_stream(spark, tmp_path):
    from blastradius.streaming.incremental import upsert_stream

    for i, rows in enumerate([[(1, "a", 1), (1, "b", 2)], [(2, "c", 1), (1, "d", 3)]]):
        spark.createDataFrame(rows, "k int, v string, o int").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    store: dict = {}
    stream = spark.readStream.schema("k int, v string, o int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    kept = lambda: spark.createDataFrame(store["rows"], "k int, v string, o int") if store else None
    q = upsert_stream(stream, "k", "o", kept, lambda df: store.update(rows=[tuple(r) for r in df.collect()]), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {r[0]: r[1] for r in store["rows"]} in ({1: "d", 2: "c"}, {1: "b", 2: "c"})


def test_upsert_folder(spark, tmp_path):
    from blastradius.operators.versions import Versions
    from blastradius.streaming.incremental import upsert_folder

    store, schema = str(tmp_path / "store"), "k int, v string, o int"
    for i, rows in enumerate([[(1, "a", 1), (1, "b", 2), (5, "q", 1)], [(2, "c", 1), (1, "d", 3)], [(1, "late", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        upsert_folder(stream, "k", "o", store, str(tmp_path / "cp"), 4).awaitTermination(120)
    rows = Versions(spark, store).read("rows")
    assert sorted((r["k"], r["v"]) for r in rows.collect()) == [(1, "d"), (2, "c"), (5, "q")]


def test_windowed_counts(spark, tmp_path):
    from blastradius.streaming.incremental import audit_counts

    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'view' AS event_type, 1.5D AS value").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "ev"))
    q = audit_counts(stream).writeStream.format("memory").queryName("audit").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    row = spark.table("audit").first()
    assert (row["event_type"], row["n"], row["total"]) == ("view", 1, 1.5)


def test_hashed_embeddings_see_whole_texts(spark, tmp_path):
    import math
    import re

    import xxhash

    from blastradius.plans import reports

    head = "the same words at the start " * 60
    rows = [(1, head + "one ending"), (2, head + "another, longer ENDING"), (3, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["test_id"]: r["embedding"] for r in reports.hashed_embeddings(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and got[1] != got[2]
    for i, text in rows:
        v = [0.0] * 32
        for w in re.findall(r"\w+", text.lower(), re.ASCII):
            h = xxhash.xxh64_intdigest(w.encode(), 42)
            h -= (h >> 63) << 64
            v[h % 32] += 1.0 if (h >> 40) % 2 == 0 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        assert all(abs(a - x / norm) < 1e-6 for a, x in zip(got[i], v, strict=True))


def test_definitions_of_new_files(spark, tmp_path):
    import duckdb

    from blastradius.plans import reports

    new, old = "diff --git a/{0} b/{0}\nnew file mode 100644\n@@ -0,0 +1 @@\n", "diff --git a/{0} b/{0}\n@@ -1 +1 @@\n"
    diffs = [
        (1, new.format("a.js") + "+function one() {} function two() {}\n+  class Three {\n-function gone()\n function context()"), (2, new.format("b.py") + "+class A: def b(self): def c\n+class subclass last"),
        (3, new.format("C.java") + "+public class C {"), (4, old.format("d.js") + "+function d() {"), (5, new.format("e.ts") + "+export async function e() {\n" + old.format("f.ts") + "+class F {\n+++ class G"),
    ]
    table = D.lines(spark.createDataFrame(diffs, "k int, body string"), "k", "body")
    got = {tuple(r) for r in D.new_definitions(table, "k", K.NAMED, K.DEFINED).collect()}
    assert got == {(1, "a.js", n) for n in ("one", "two", "Three")} | {(2, "b.py", n) for n in ("A", "b", "c", "subclass", "last")} | {(3, "C.java", "C"), (5, "e.ts", "e")}
    # by its number, document 4 is a diff of a new file, of which line 4 is added as it stands and line 5 is +function f1()
    text = "\n".join(["", "", "", "", "class subclass foo def a def\x0bb\rfunction c class D", "", "function not_added"])
    spark.createDataFrame([(4, text), (5, text), (6, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in reports.new_file_definitions(spark, str(tmp_path)).collect()]
    assert rows == [(4, "f0.py", "D,a,b,c,f1,subclass")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert con.sql(reports.ORACLE_SQL["new_file_definitions"]).fetchall() == rows


def test_new_file_definitions_are_found_in_the_tables(spark):
    from blastradius.plans import reports

    names = {n for r in reports.new_file_definitions(spark, "/root/testdata/sf0.001").collect() for n in r["definitions"].split(",")}
    assert names >= {"f0", "f1", "f2"}
