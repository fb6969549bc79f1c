"""Analysis of test sources: rows written by hand for what the generated sources don't hold."""

import pytest

from blastradius.operators import analysis as A

PY = '''from app.core import run as go, stop
import app.db.pool as pool
import json

@pytest.fixture(
    scope="session", params=[1, 2])
def box(): ...

pool.open()

@pytest.mark.parametrize("x", [f(1), (g(2), h(i(3)))])
@patch("app.core.run", return_value="a")
@other
async def test_one(x):
    """First.
    More."""
    await go.fast()
    go.slow()

def test_two(): stop.now(); pool.open(); go.fast()
'''
JS = """import def, { a as b } from 'm'
const { c: d, e } = require("n")
it('x', () => { b.one(); d.two() }); it('y', () => { b.three()
  e . nope; e.four
  () })
"""
JAVA = """package a.test.b;
@Suite
@Tag("x")
public class OrderTests {
  @MockBean(name = "n")
  private final List<Order> orders = null;
  @Test(timeout = f(1))
  public void testIt() throws Exception { o.getMethod("run"); }
}
"""


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(1, "python", "t/test_a.py", PY), (2, "javascript", "t/a.test.js", JS), (3, "java", "src/test/x/Cart Test.java", JAVA), (4, "python", "e.py", ""), (5, "java", "n.java", None), (6, None, None, "x.y()")]
    return spark.createDataFrame(rows, "file_id long, language string, path string, body string")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_calls_have_owners(sources):
    got = rows(A.call_owners(sources), "file_id", "test_name", "object_name", "module_name", "function_name", "line")
    assert [r for r in got if r[0] == 1] == sorted([
        (1, "test_one", "pool", "app.db.pool", "open", 9), (1, "test_one", "app.core", "app.core", "run", 12),
        (1, "test_one", "go", "app.core.run", "fast", 17), (1, "test_one", "mark", "mark", "parametrize", 11),
        (1, "test_two", "stop", "app.core.stop", "now", 20), (1, "test_two", "pool", "app.db.pool", "open", 20), (1, "test_two", "go", "app.core.run", "fast", 20),
    ], key=repr)
    # two tests on one line: the last one owns what stands there
    assert [r for r in got if r[0] == 2] == [(2, "y", "b", "m", "one", 3), (2, "y", "d", "n", "two", 3), (2, "y", "e", "n", "four", 4)]
    assert not [r for r in got if r[0] > 3]


def test_owner_is_the_last_test_above(spark):
    known = spark.createDataFrame([(1, 0, "a", 5), (1, 1, "b", 9), (1, 2, "c", 9), (2, 0, "z", 3)], "file_id long, test_no int, test_name string, line int")
    calls = spark.createDataFrame([(1, 1, "w"), (1, 5, "x"), (1, 8, "y"), (1, 9, "v"), (1, 99, "u"), (3, 1, "none")], "file_id long, line int, object_name string")
    assert rows(A.owners(calls, known), "object_name", "test_name") == [("u", "c"), ("v", "c"), ("w", "a"), ("x", "a"), ("y", "a")]
    assert A.owners(calls.limit(0), known).count() == 0 and A.owners(calls, known.limit(0)).count() == 0


def test_fixtures_and_decorators(sources):
    assert rows(A.fixtures(sources), "file_id", "fixture_name", "fixture_scope", "fixture_type", "line") == [(1, "box", "session", "sync", 5)]
    got = A.decorators(sources).where("function_name = 'test_one'").orderBy("mark_no").collect()
    assert [(r.mark_no, r.decorator_name, r.args, r.decorator_args) for r in got] == [
        (0, "pytest.mark.parametrize", '"x", [f(1), (g(2), h(i(3)))]', {}), (1, "patch", '"app.core.run", return_value="a"', {"return_value": "a"}),
    ]


def test_java_rows(sources):
    assert rows(A.annotations(sources), "target_type", "target_name", "annotation_name", "args") == [
        ("class", "OrderTests", "Suite", None), ("class", "OrderTests", "Tag", '"x"'), ("method", "testIt", "Test", "timeout = f(1)"),
    ]
    assert rows(A.injected_fields(sources), "annotation_name", "field_type", "field_name", "line") == [("MockBean", "List<Order>", "orders", 5)]
    assert rows(A.reflection(sources), "reflection_method", "target_kind", "target", "line") == [("getMethod", "target_method", "run", 8)]


def test_metadata(sources):
    got = {r.test_name: r for r in A.metadata(sources).collect()}
    assert got["test_one"].description == "First.\n    More." and got["test_one"].is_async and got["test_one"].async_pattern == "asyncio"
    assert got["test_one"].markers == ["parametrize"] and not got["test_two"].is_async and got["test_two"].description == ""
    assert got["testIt"].pattern == "annotation_based" and got["testIt"].line == 8


def test_java_inference(spark, sources):
    got = [r.candidate for r in A.inferred(sources).where("file_id = 3").orderBy("candidate_no").collect()]
    own = [f"a.{s}.Order" for s in ("service", "controller", "request", "response", "model", "entity", "dto")]
    assert got == ["a.b", "Order", *own, "a.Order", *[f"a.{s}.Cart " for s in ("service", "controller", "request", "response", "model")]]
    declared = spark.createDataFrame([("a.dto.Order",), ("z.Order",), ("a.b",)], "production_class string")
    assert rows(A.inferred_classes(sources, declared), "file_id", "candidate", "production_class") == [(3, "a.b", "a.b")]
    assert rows(A.inferred_classes(sources, declared.where("production_class <> 'a.b'")), "candidate", "production_class") == [("Order", "a.dto.Order")]
    assert A.inferred_classes(sources, declared.limit(0)).count() == 0


def test_java_inference_stands_back_for_imports(spark):
    row = (1, "java", "src/test/x/ATest.java", "package a.test;\nimport com.shop.Real;\nclass ATest {}")
    assert A.inferred(spark.createDataFrame([row], "file_id long, language string, path string, body string")).count() == 0


def test_references_in_strings(spark):
    rows = [
        (1, "java", 'Class.forName("a.B"); String x = "com.shop.Cart"; y = "com.shop.cart"; z = "someThing"; w = "org.junit.Test";'),
        (2, "python", 'patch("app.core.run"); mock.patch(\'app.x\'); open("a.b")'), (3, "javascript", "const m = await import('./lazy/Page')"),
    ]
    got = A.E.references(spark.createDataFrame(rows, "file_id long, language string, body string"))
    assert {(r.file_id, r.module, r.class_name) for r in got.where("reference_type = 'string_ref'").collect()} == {
        (1, "a.B", "B"), (1, "com.shop.Cart", "Cart"), (2, "app.core.run", "run"), (2, "app.x", "x"), (3, "./lazy/Page", "Page"),
    }


def test_references_of_a_plugged_language(spark):
    from blastradius.operators import plugins

    plugins.LANGUAGES.add("lua", plugins.Language("lua", (".lua",), (), (r"require\s*\(?['\"]([\w.]+)['\"]",), r"^busted"), replace=True)
    rows = [(1, "lua", "require('app.cart') require 'busted.core'"), (2, "python", "import shop.cart\nimport os"), (3, "none", "require('x')")]
    got = plugins.references(spark.createDataFrame(rows, "file_id long, language string, body string"))
    del plugins.LANGUAGES.known["lua"]
    assert {(r.file_id, r.module, r.class_name) for r in got.collect()} == {(1, "app.cart", "cart"), (2, "shop.cart", "cart")}
