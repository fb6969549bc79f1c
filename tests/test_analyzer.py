"""The analyser from files to documents and back, and its configuration."""

import json

import pytest

from blastradius.operators import analyzer as Z
from blastradius.sources import files as S

FILES = [
    ("app/tests/unit/test_cart.py", "import pytest\nfrom shop.cart import Cart as C\n\nclass TestCart:\n    def test_add(self):\n        C.add(1)\n    async def test_sum(self):\n        C.total()\n"),
    ("web/integration/cart.test.js", "import { pay } from './pay/api'\ndescribe('cart', () => {\n  it('pays', () => { pay.now(); client.call() })\n})\n"),
    ("src/e2e/CartTest.java", "import com.shop.Cart;\nimport org.junit.Test;\npublic class CartTest {\n  @Test\n  public void testAll() { Cart.open(); }\n}\n"),
    ("src/main/Cart.java", "class Cart {}"), ("node_modules/x/a.test.js", "it('no', () => {})"), ("README.md", "test"), ("tests/test_empty.py", None),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "file_path string, content string")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_documents_come_back_equal(spark, files, tmp_path):
    folder = f"file://{tmp_path}/all"
    found = Z.analyze(files)
    schemas = Z.run(files, folder, "now")
    assert list(schemas) == list(S.DOCUMENTS)
    for kind, schema in schemas.items():
        back = S.merge_analyzers(spark, [folder, f"file://{tmp_path}/none"], kind, schema)
        assert {r.analyzer for r in back.collect()} <= {"all"}
        assert rows(back, *found[kind].columns) == rows(found[kind], *found[kind].columns), kind
    with pytest.raises(Exception):  # noqa: B017 (documents aren't overwritten)
        Z.run(files, folder, "later")


def test_relations(files):
    found = Z.analyze(files)
    assert rows(found["files"], "file_path", "category", "line_count") == [
        ("app/tests/unit/test_cart.py", "unit", 9), ("src/e2e/CartTest.java", "e2e", 7), ("tests/test_empty.py", "unit", 1), ("web/integration/cart.test.js", "integration", 5),
    ]
    assert rows(found["tests"], "method_name", "class_name", "test_type", "line_number") == [
        ("cart", "cart", "integration", 2), ("pays", "cart", "integration", 3), ("testAll", "CartTest", "e2e", 5), ("test_add", "TestCart", "unit", 5), ("test_sum", "TestCart", "unit", 7),
    ]
    assert rows(found["calls"], "module_name", "function_name", "line_number") == [
        ("./pay/api", "now", 3), ("client", "call", 3), ("com.shop.Cart", "open", 5), ("shop.cart.Cart", "add", 6), ("shop.cart.Cart", "total", 8),
    ]
    assert ("Cart", "direct_import") in rows(found["index"], "production_class", "reference_type")
    assert rows(found["structure"], "category", "file_count", "test_count", "total_lines") == [("e2e", 1, 1, 7), ("integration", 1, 2, 5), ("unit", 2, 2, 10)]
    assert len({r.test_id for r in found["tests"].collect()}) == 5


def test_no_files(files):
    for rows_ in Z.analyze(files.limit(0)).values():
        assert rows_.count() == 0


def test_detection_report(files):
    got = {r.language: r for r in Z.detection_report(Z.scan(files, Z.built_in())).collect()}
    assert {k: (r.n_files, r.n_tests) for k, r in got.items()} == {"python": (2, 2), "javascript": (1, 1), "java": (2, 1)}
    assert [f.framework for f in got["java"].frameworks] == ["junit5"] and got["javascript"].frameworks == []
    assert {r.language for r in Z.active_languages(Z.scan(files, Z.built_in()), 0.3).collect()} == {"python", "java"}


def test_configuration(spark, files, tmp_path):
    said = {"languages": {"markdown": {"extensions": [".md"], "test_patterns": ["READ*.md"], "tests": [r"(?m)^(test)$"]}, "python": {"test_patterns": ["*_cart.py"]}}}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(said, indent=1))
    config = Z.load_config(spark, f"file://{path}")
    assert config.values("markdown", "extensions") == (".md",) and config.values("java", "tests") == Z.built_in().values("java", "tests")
    assert config.of("cobol") is None and config.values("cobol", "tests") == ()
    found = Z.analyze(files, config)
    assert ("README.md", "markdown") in rows(found["files"], "file_path", "language") and "tests/test_empty.py" not in {r.file_path for r in found["files"].collect()}
    assert ("test", "README.md") in rows(found["tests"], "method_name", "file_path")
    assert config.rows(spark).where("language = 'markdown'").count() == 3
    path.write_text("[1]")
    with pytest.raises(ValueError):
        Z.load_config(spark, f"file://{path}")
