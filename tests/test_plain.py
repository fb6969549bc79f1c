"""Registered queries that SQL has no words for, against plain readings of the same tables; and late rows of windows."""

import re
from collections import Counter

import pytest

from blastradius.operators import extract as E
from blastradius.plans import programs, registry, texts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bodies(spark):
    return {r.diff_id: r.body for r in texts.diff_bodies(spark, SF).collect()}


def counted(body):
    """Added and removed lines of each file's hunks, file by file."""
    out, at, hunk = [], None, False
    for line in body.split("\n"):
        if m := re.match(r"diff --git a/(\S+) b/(\S+)", line):
            at, hunk = [m[2], 0, 0], False
            out.append(at)
        elif at and re.match(r"@@ -\d+(,\d+)? \+\d+(,\d+)? @@", line):
            hunk = True
        elif at and hunk and line[:1] in ("+", "-") and line[:3] not in ("+++", "---"):
            at[1 if line[0] == "+" else 2] += 1
    return Counter(map(tuple, out))


def test_diff_parse(spark, bodies):
    found = {}
    for r in registry.QUERIES["diff_parse"](spark, SF).collect():
        found.setdefault(r.diff_id, Counter())[(r.file, r.additions, r.deletions)] += 1
        assert len(r.changed_lines) == r.additions + r.deletions and r.classes == sorted(set(r.classes))
    assert found == {i: c for i, b in bodies.items() if (c := counted(b))}


def test_diff_search_terms(spark):
    """Deleted and added symbols are those that the line table gives, which has a twin in SQL."""
    want = {(r.doc_id, r.change, r.symbol) for r in registry.QUERIES["symbol_delta"](spark, SF).collect()}
    rows = registry.QUERIES["diff_search_terms"](spark, SF).collect()
    assert {(r.diff_id, r.kind, r.value) for r in rows if r.kind in ("added", "deleted")} == want
    renamed = {(r.doc_id, f"{r.old}:{r.new}") for r in registry.QUERIES["symbol_renames"](spark, SF).collect()}
    assert {(r.diff_id, r.value) for r in rows if r.kind == "renamed"} == renamed
    exact = {(r.diff_id, r.value) for r in rows if r.kind == "exact"}
    assert {(i, v) for i, k, v in want if k == "deleted"} <= exact and {(r.diff_id, r.value) for r in rows if r.kind == "module_exact"} <= exact


@pytest.fixture(scope="module")
def sources(spark):
    return {r.file_id: (r.language, r.body) for r in programs.sources(spark, SF).collect()}


def test_parse_source(spark, sources):
    found = {}
    for r in registry.QUERIES["parse_source"](spark, SF).collect():
        found.setdefault(r.file_id, set()).add((r.name, r.line, r.kind))
    for i, (lang, body) in sources.items():
        lines = body.split("\n")
        if lang == "python":
            want = {(m[1], n, "fixture" if "fixture" in lines[n - 2] else "test" if m[1].startswith("test_") else "function") for n, line in enumerate(lines, 1) if (m := re.search(r"def (\w+)", line))}
        else:
            names = {m[1] for p in E.TESTS[lang] for m in re.finditer(p, body)}
            want = {(name, next(n for n, line in enumerate(lines, 1) if re.search(rf"\b{name}\b['\"]?\s*[,(]", line)), "test") for name in names}
        assert found.get(i, set()) == want, (lang, body)


def test_test_bodies(spark, sources):
    rows = registry.QUERIES["test_bodies"](spark, SF).collect()
    names = {(i, m[1]) for i, (lang, body) in sources.items() for p in E.TESTS[lang] for m in re.finditer(p, body)}
    assert {(r.file_id, r.test_name) for r in rows} == names
    for r in rows:
        lang, body = sources[r.file_id]
        assert r.body_text in body and r.test_name in r.body_text
        if lang != "python":
            assert r.body_text.count("{") == r.body_text.count("}") > 0


def test_late_rows_are_left_out(spark, tmp_path):
    """A row below the watermark changes no window that was given out."""
    from blastradius.streaming.incremental import audit_counts

    schema, parts = "ts timestamp, event_type string, value double", (
        ["2024-01-01 00:10", "2024-01-01 00:20"], ["2024-01-01 09:00"], ["2024-01-01 00:30", "2024-01-01 09:10"], ["2024-01-02 00:00"],
    )
    for i, times in enumerate(parts):
        spark.createDataFrame([(t, "view", 1.0) for t in times], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        q = audit_counts(source, late="1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    got = {(str(r.start), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01 00:00:00", 2), ("2024-01-01 09:00:00", 2)}
