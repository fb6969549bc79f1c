"""What a change reaches: all evidence of one change, from one reading of the index.

Every distinct symbol is marked once with all strategies by which the change finds it (an array, exploded), so that the
index is joined once, whatever the number of strategies. A test's evidence is a short array, bounded by
the terms of the change; files that evidence leads to are found from those arrays, merged before they are shuffled.

Rows: seq orders strategies (1 function, 2 test file, 3 integration, 4 symbol, 5 module, 6 neighbour, 7 stem,
8 vector, 9 neighbour of what was found).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import change as K
from . import lookup as L
from . import score as C

MARK = "struct<seq:int,type:string,term:string,kind:int,weak:boolean>"
ITEM = ("seq", "type", "term", "reference_type", "source", "similarity", "weak")
DIRECT = ("exact", "function_level")


def weak_modules(change: K.Bundle) -> tuple[str, ...]:
    """Lower-case module names, which files elsewhere may share."""
    return tuple(m for m in change.module_exact if m == m.lower())


def marks(change: K.Bundle) -> Column:
    """Of a symbol (module_name, function_name, production_class): every strategy by which the change finds it."""
    weak, c = weak_modules(change), F.col("production_class")
    mark = lambda seq, kind, term, rank, w: F.struct(F.lit(seq), F.lit(kind), term, F.lit(rank), w).cast(MARK)
    none, no = F.lit(None).cast("string"), F.lit(False)
    named = F.concat_ws(":", "module_name", "function_name").isin(*[":".join(f) for f in change.functions])
    primary = [m[0] for m in map(K.modules, change.files) if m]
    single = [F.when(named, mark(1, "function_level", none, 0, no)), F.when(c.isin(*primary), mark(3, "integration", none, 0, no))]
    for m in change.modules if change.runs_modules() else ():
        name = m.removesuffix(".*")
        at = lambda rank, name=name: mark(5, "module", F.lit(name), rank, F.lit(name in weak))
        single.append(F.when(c == name, at(1)).when(c.startswith(name + "."), at(2)))
    hit = F.filter(L.keys_of(c), lambda k: k["key"].isin(*change.exact))
    exact = F.transform(hit, lambda k: F.struct(F.lit(4), F.lit("exact"), k["key"], k["kind"], k["key"].isin(*weak)).cast(MARK))
    return F.concat(F.array_compact(F.array(*single)), exact)


def by_test(index: DataFrame, hits: DataFrame) -> DataFrame:
    """test_id, items: each test's evidence from the marked index (test_id, reference_type, source, mark) and from vectors.

    A symbol's best kind counts once for each term, a function once with its surest source, modules and integration once for
    each kind of reference.
    """
    kind, ref = F.col("mark.type"), F.col("reference_type")
    rows = index.where((kind != "module") | (F.col("mark.kind") == 1) | ref.isin(*L.BELOW_KINDS))
    apart = kind.isin("module", "integration")
    rank = lambda a, b, r, s: F.struct(a, b, r, s).cast("struct<a:int,b:int,reference_type:string,source:string>")
    none, zero = F.lit(None).cast("string"), F.lit(0)
    function = rank(F.when(F.col("source") == "patch_ref", 1).otherwise(2), zero, none, F.col("source"))
    exact = rank(F.col("mark.kind"), F.when(ref == "string_ref", 0).otherwise(1), ref, none)
    surest = F.when(kind == "function_level", function).when(kind == "exact", exact).otherwise(rank(zero, zero, ref, none))
    rows = rows.select("test_id", "mark.seq", "mark.type", "mark.term", "mark.weak", F.when(apart, ref).alias("__apart"), surest.alias("__rank"))
    best = rows.groupBy("test_id", "seq", "type", "term", "weak", "__apart").agg(F.min("__rank").alias("r"))
    best = best.select("test_id", "seq", "type", "term", "r.reference_type", "r.source", F.lit(None).cast("double").alias("similarity"), "weak")
    found = hits.selectExpr("test_id", "8 as seq", "'semantic' as type", "cast(null as string) as term", "cast(null as string) as reference_type", "cast(null as string) as source", "similarity", "false as weak")
    return best.unionByName(found).groupBy("test_id").agg(F.collect_list(F.struct(*ITEM)).alias("items"))


def leads(change: K.Bundle) -> Column:
    """Whether a test's direct hits lead to its file's other tests: not if all of them are constants, or all whole modules."""
    direct = F.filter("items", lambda x: x["type"].isin(*DIRECT))
    constant = lambda x: (x["type"] == "exact") & (F.upper(x["term"]) == x["term"]) & ~x["term"].rlike("^.?[0-9]")
    module = lambda x: (x["type"] == "exact") & x["term"].isin(*change.module_exact)
    return (F.size(direct) > 0) & ~F.forall(direct, constant) & ~F.forall(direct, module)


def evidence(index: DataFrame, entities: DataFrame, hits: DataFrame, change: K.Bundle, near: float, fits: dict[str, Column]) -> DataFrame:
    """All evidence as one long table (score.EVIDENCE), with each test's type, known (it is registered) and what fits says
    of its label; fits needs label_fits. hits: test_id, similarity."""
    tests, path = by_test(index, hits), F.col("file_path")
    own = F.filter("items", lambda x: F.when(x["type"] == "function_level", F.col("known")).when(x["type"] == "integration", F.col("test_type").isin("integration", "e2e")).otherwise(True))
    known = entities.select("test_id", "test_type", "file_path", *[c.alias(n) for n, c in fits.items()], F.lit(True).alias("known"))
    reached = tests.join(known.select("test_id", "test_type", "file_path", "known"), "test_id").withColumn("items", own)
    strong = F.exists("items", lambda x: (x["type"] != "semantic") | (x["similarity"] >= near))
    files = reached.select("file_path", leads(change).alias("__leads"), strong.alias("__found")).where("__leads OR __found")
    files = files.groupBy(F.col("file_path").alias("__path")).agg(F.max("__leads").alias("__leads"), F.max("__found").alias("__found"))
    rows = known.join(tests, "test_id", "full_outer").withColumn("known", F.coalesce("known", F.lit(False)))
    rows = rows.withColumn("items", F.coalesce(own, F.array().cast(f"array<{C.ITEM}>"))).join(files, path == F.col("__path"), "left")
    named, stem = L.any_like(path, [f"%{n}" for n in change.test_files]), L.any_stem(path, X.stems(change.files))
    searched = F.exists("items", lambda x: x["type"] == "semantic")
    item = lambda seq, kind, ref, source, sim, way, weak: F.struct(seq, kind, ref, source, sim, way, weak).cast(C.ROW)
    plain = lambda seq, kind, way: item(F.lit(seq), F.lit(kind), F.lit(None), F.lit(None), F.lit(None), F.lit(way), F.lit(False))
    derived = F.array(
        F.when(named, plain(2, "direct_file", "exact_filename")),
        F.when(F.col("__leads") & ~leads(change), plain(6, "direct_file", "colocated_in_same_file")),
        F.when(stem, plain(7, "direct_file", "file_stem")),
        F.when(F.col("label_fits") & (F.col("__found") | named | stem) & ~searched, plain(9, "semantic_colocation", "semantic_colocated_file")),
    )
    given = F.transform("items", lambda x: item(x["seq"], x["type"], x["reference_type"], x["source"], x["similarity"], F.lit(None), x["weak"]))
    every = F.explode(F.concat(given, F.array_compact(derived))).alias("e")
    return rows.select("test_id", "test_type", "known", *fits, every).select("test_id", "e.*", "test_type", "known", *fits)
