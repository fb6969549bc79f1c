"""Pattern matching by postings against LIKE on every pair."""

import random
import re

from blastradius.operators import grams as G


def fits(symbol, pattern):
    rx = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return re.fullmatch(rx, symbol, re.IGNORECASE | re.DOTALL) is not None


def test_ilike_equals_all_pairs(spark):
    r = random.Random(7)
    text = lambda letters, n: "".join(r.choice(letters) for _ in range(r.randrange(n)))
    symbols = sorted({text("abAB.c_é", 9) for _ in range(300)})
    patterns = [(f"n{i % 40}", text("abB.%%_cé", 8)) for i in range(150)] + [("all", "%"), ("empty", ""), ("one", "_"), ("two", "%ab%"), ("dot", "%.%")]
    df = spark.createDataFrame([(s,) for s in symbols] * 2 + [(None,)], "symbol string")
    got = {tuple(x) for x in G.ilike(df, "symbol", spark.createDataFrame([*patterns, ("null", None)], "name string, pattern string")).collect()}
    assert got == {(s, n) for s in symbols for n, p in patterns if fits(s, p)}
    assert G.ilike(df.limit(0), "symbol", spark.createDataFrame(patterns, "name string, pattern string")).count() == 0


def test_dead_zones_have_no_nested_loop(spark):
    from blastradius.plans import registry

    for name in ("dead_zone_files", "dead_zone_symbols"):
        df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
