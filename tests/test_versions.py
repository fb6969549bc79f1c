"""The versioned store: commits of several relations, batches that die or come again, cascades."""

import pytest

from blastradius.operators import versions as V

REFS = [("dependencies", "test_id", "registry", "test_id"), ("metadata", "test_id", "registry", "test_id"), ("reverse_index", "test_id", "registry", "test_id"), ("hits", "symbol", "reverse_index", "symbol_id")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    store = V.Versions(spark, f"file://{tmp_path}/store")
    make = spark.createDataFrame
    store.commit({
        "registry": make([(1, "a"), (2, "b"), (3, "c")], "test_id long, name string"),
        "dependencies": make([(1, "x"), (2, "y"), (None, "z")], "test_id long, class string"),
        "metadata": make([(1, "m"), (3, "n")], "test_id long, note string"),
        "reverse_index": make([(1, 10), (1, 11), (2, 12)], "test_id long, symbol_id long"),
        "hits": make([(10, "h"), (12, "i"), (12, "j")], "symbol long, hit string"),
    })
    return store


def test_cascade_is_one_version(spark, store):
    ids = spark.createDataFrame([(1,), (99,), (None,)], "test_id long")
    before = store.manifest()["number"]
    assert V.delete_cascade(store, REFS, "registry", ids) and store.manifest()["number"] == before + 1
    assert rows(store.read("registry")) == [(2, "b"), (3, "c")]
    assert rows(store.read("dependencies")) == [(2, "y"), (None, "z")] and rows(store.read("metadata")) == [(3, "n")]
    assert rows(store.read("reverse_index")) == [(2, 12)] and rows(store.read("hits")) == [(12, "i"), (12, "j")]
    left = {n: store.read(n) for n in ("registry", "dependencies", "metadata", "reverse_index", "hits")}
    assert {r.n for r in V.orphans(left, REFS).collect()} == {0}
    assert rows(store.read("registry", before)) == [(1, "a"), (2, "b"), (3, "c")]  # the earlier version is still there


def test_a_failure_on_the_way_leaves_the_old_state(spark, store, monkeypatch):
    before, write, made = {n: rows(store.read(n)) for n in ("registry", "hits")}, V.Versions._write, []

    def dies(self, name, *rest):
        if len(made) == 3:
            raise OSError("lost")
        made.append(name)
        return write(self, name, *rest)

    monkeypatch.setattr(V.Versions, "_write", dies)
    with pytest.raises(OSError):
        V.delete_cascade(store, REFS, "registry", spark.createDataFrame([(1,)], "test_id long"))
    monkeypatch.undo()
    assert made[0] == "hits" and {n: rows(store.read(n)) for n in before} == before  # children are written first
    assert store.vacuum() == 3 and {n: rows(store.read(n)) for n in before} == before


def test_orphans_are_seen(spark, store):
    store.commit({"registry": store.read("registry").where("test_id <> 2")})
    left = {n: store.read(n) for n in ("registry", "dependencies", "metadata", "reverse_index", "hits")}
    assert {(r.child, r.n) for r in V.orphans(left, REFS).collect()} == {("dependencies", 1), ("metadata", 0), ("reverse_index", 1), ("hits", 0)}


def test_references_in_a_circle():
    with pytest.raises(ValueError):
        V._parents_first([("a", "x", "b", "y"), ("b", "y", "a", "x")], "a")


def test_upsert_rewrites_touched_buckets_and_knows_its_batches(spark, tmp_path):
    store, schema = V.Versions(spark, f"file://{tmp_path}/s"), "k long, v string, o long"
    make = lambda some: spark.createDataFrame(some, schema)
    assert store.upsert("t", make([(i, "a", 1) for i in range(40)]), "k", "o", 8, ("stream", 0))
    first = {p["bucket"]: p["path"] for p in store.manifest()["relations"]["t"]["parts"]}
    assert store.upsert("t", make([(3, "b", 2), (3, "old", 0), (77, "n", 1)]), "k", "o", 8, ("stream", 1))
    second = {p["bucket"]: p["path"] for p in store.manifest()["relations"]["t"]["parts"]}
    assert 0 < sum(first[b] != second[b] for b in first) <= 2
    state = rows(store.read("t"))
    assert (3, "b", 2) in state and (77, "n", 1) in state and len(state) == 41
    number = store.manifest()["number"]
    assert not store.upsert("t", make([(3, "again", 9)]), "k", "o", 8, ("stream", 1))  # the same batch given again
    assert store.manifest()["number"] == number and rows(store.read("t")) == state
    with pytest.raises(ValueError):
        store.upsert("t", make([(1, "x", 1)]), "v", "o")
    assert store.upsert("t", make([]), "k", "o", 8, ("stream", 2)) and rows(store.read("t")) == state


def test_a_version_is_written_once(spark, store):
    state = store.manifest()
    with pytest.raises(RuntimeError):
        store._publish(state)
    assert store.manifest() == state
