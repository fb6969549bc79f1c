"""Relations of an index: creation, rows made to fit, differences and faults of rows."""

from blastradius.operators import schema as M
from blastradius.operators import versions as V


def test_create_and_verify(spark, tmp_path):
    store = V.Versions(spark, f"file://{tmp_path}/s")
    assert M.create(store) == sorted(M.CORE) and M.create(store, "java") == sorted(M.BY_LANGUAGE["java"])
    number = store.manifest()["number"]
    assert M.create(store, "java") == [] and store.manifest()["number"] == number
    wanted = M.relations("java", "javascript")
    found = {n: store.read(n).schema for n in store.manifest()["relations"]}
    assert M.differences(found, wanted) == [("js_mocks", "*", "relation", "missing")]
    found["test_structure"] = spark.createDataFrame([], "directory_path string, category string, file_count string").schema
    assert M.differences(found, {"test_structure": wanted["test_structure"]}) == [
        ("test_structure", "file_count", "int", "string"), ("test_structure", "test_count", "int", "missing"), ("test_structure", "total_lines", "int", "missing"),
    ]


def test_conform(spark):
    rows = spark.createDataFrame([("t1", "a.py", "m", "7", "x"), ("t2", "b.py", None, "no number", "y")], "test_id string, file_path string, method_name string, line_number string, extra string")
    got = M.conform(rows, M.CORE["test_registry"])
    assert got.schema.simpleString() == M.CORE["test_registry"].schema().simpleString()
    assert [(r.test_id, r.line_number, r.language, r.created_at is not None) for r in got.orderBy("test_id").collect()] == [("t1", 7, "python", True), ("t2", None, "python", True)]


def test_faults_of_rows(spark):
    rows = spark.createDataFrame([("a", "f", "m"), ("a", "f", "m"), ("b", None, "m"), (None, "f", "m"), (None, "f", "m")], "test_id string, file_path string, method_name string")
    full = M.conform(rows, M.CORE["test_registry"])
    none = full.limit(0)
    assert [tuple(r) for r in M.verify({"test_registry": full}, M.CORE).collect()] == [("test_registry", 5, 3, 2)]
    assert [tuple(r) for r in M.verify({"test_registry": none}, M.CORE).collect()] == [("test_registry", 0, 0, 0)]
    index = M.conform(spark.createDataFrame([("c", "t"), ("c", "t"), (None, "t")], "production_class string, test_id string"), M.CORE["reverse_index"])
    assert [tuple(r) for r in M.verify({"reverse_index": index}, M.CORE).collect()] == [("reverse_index", 3, 1, 0)]
