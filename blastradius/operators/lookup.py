"""Structural lookups: changed symbols, functions, modules and files to the tests they reach.

Term lists are small relations; every lookup is one set-based join, and OR-ed prefix and suffix predicates are
turned into equi-joins on exploded prefixes and suffixes of the distinct symbols.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem_match, tail_match
from .store import cut

# Reference kinds that a symbol below a module may have, and the module itself beside named classes.
BELOW_KINDS = ("direct_import", "string_ref", "transitive_import", "transitive_normalized")
MODULE_KINDS = (*BELOW_KINDS, "source_annotation", "source_annotation_normalized")


def keys_of(c: Column) -> Column:
    """array of (key, kind): a dotted name under itself (1), its proper prefixes (2) and suffixes (3)."""
    parts = F.split(c, r"\.")
    n = F.size(parts)
    cut = lambda a, b: F.array_join(F.slice(parts, a, b), ".")
    inner = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(
        F.array(F.struct(c.alias("key"), F.lit(1).alias("kind"))),
        F.transform(inner, lambda i: F.struct(cut(F.lit(1), i).alias("key"), F.lit(2).alias("kind"))),
        F.transform(inner, lambda i: F.struct(cut(i + 1, n - i).alias("key"), F.lit(3).alias("kind"))),
    )


def symbol_keys(symbols: DataFrame, column: str) -> DataFrame:
    """symbol, key, kind of each distinct symbol."""
    return symbols.select(column).distinct().select(F.col(column).alias("symbol"), F.explode(keys_of(F.col(column))).alias("k")).select("symbol", "k.key", "k.kind")


def match_symbols(symbols: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """term, symbol, kind: the best kind of match."""
    keys = symbol_keys(symbols, column)
    return keys.join(terms, F.col("key") == F.col("term")).groupBy("term", "symbol").agg(F.min("kind").alias("kind"))


def lookup_symbols(index: DataFrame, terms: DataFrame) -> DataFrame:
    """term, test_id, production_class, reference_type, kind: one row for each term and test.

    Best kind first, then string references, then the smallest reference type and symbol.
    """
    found = index.join(match_symbols(index, "production_class", terms), F.col("production_class") == F.col("symbol"))
    order = [F.col("kind"), F.when(F.col("reference_type") == "string_ref", 0).otherwise(1), F.col("reference_type"), F.col("production_class")]
    w = Window.partitionBy("term", "test_id").orderBy(*order)
    best = found.select("term", "test_id", "production_class", "reference_type", "kind").distinct().withColumn("__r", F.row_number().over(w))
    return best.where("__r = 1").drop("__r")


def function_level(mapping: DataFrame, entities: DataFrame, terms: DataFrame) -> DataFrame:
    """test_id, test_type, source, priority: tests of the changed (module, function) pairs, patched references first."""
    found = mapping.join(terms, ["module_name", "function_name"]).select("test_id", "source").distinct()
    found = found.withColumn("priority", F.when(F.col("source") == "patch_ref", 1).otherwise(2))
    best = found.groupBy("test_id").agg(F.min(F.struct("priority", "source")).alias("b"))
    return best.join(entities, "test_id").select("test_id", "test_type", "b.source", "b.priority")


def module_pattern(index: DataFrame, module: str, mode: str = "direct", classes: tuple[str, ...] = ()) -> DataFrame:
    """Distinct test_id, production_class, reference_type, exact_priority, ref_priority of a module.

    direct: the module, and symbols below it with a kind of BELOW_KINDS; specific: the classes, and the module itself
    with a kind of MODULE_KINDS; broad: all symbols below it, without priorities.
    """
    c, kind = F.col("production_class"), F.col("reference_type")
    below = c.startswith(module + ".")
    pick = {"direct": (c == module) | (below & kind.isin(*BELOW_KINDS)), "specific": c.isin(*classes) | ((c == module) & kind.isin(*MODULE_KINDS)), "broad": below}[mode]
    exact = F.when(c == module, 1).otherwise(2)
    ref = F.when(kind.isin("direct_import", "string_ref"), 1).when(kind.isin("transitive_import", "transitive_normalized"), 2).otherwise(3)
    out = index.where(pick).select("test_id", "production_class", "reference_type").distinct()
    return out if mode == "broad" else out.withColumn("exact_priority", exact).withColumn("ref_priority", ref)


def any_like(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, p: a | path.like(p), patterns, F.lit(False))


def any_stem(path: Column, stems: list[str]) -> Column:
    return reduce(lambda a, s: a | stem_match(path, s), stems, F.lit(False))


def any_tail(path: Column, changed: list[str]) -> Column:
    return reduce(lambda a, c: a | tail_match(path, c), changed, F.lit(False))


def integration_lookup(index: DataFrame, entities: DataFrame, *symbols: str) -> DataFrame:
    hit = index.where(F.col("production_class").isin(*symbols)).select("test_id", "reference_type").distinct()
    return hit.join(entities.where(F.col("test_type").isin("integration", "e2e")), "test_id").select("test_id", "test_type", "reference_type")


def direct_strategies(path: Column, candidates: tuple[str, ...], module: str | None = None, stem: str | None = None) -> list[tuple[str, Column]]:
    """The ways in which a test file may belong to a changed one, the surest first."""
    exact = any_like(path, ["%" + c.replace("*.py", ".py") for c in candidates])
    bases = [c.replace("test_", "").replace("_*.py", "").replace("*.py", "") for c in candidates if "*.py" in c]
    out = [("exact_filename", exact), ("pattern_match", any_like(path, [p for b in bases for p in (f"%test_{b}_%", f"%test_%{b}%")]))]
    name = (module or "").split(".")[-1]
    return out + ([("module_basename", any_like(path, [f"%test_{name}%", f"%{name}%"]))] if name else []) + ([("file_path_based", any_like(path, [f"%{stem}%"]))] if stem else [])


def first_strategy(rows: DataFrame, strategies: list[tuple[str, Column]]) -> DataFrame:
    """rows with the first strategy (in the given order) whose predicate holds, and its place."""
    name = place = F.lit(None)
    for i, (label, test) in reversed(list(enumerate(strategies))):
        name, place = F.when(test, F.lit(label)).otherwise(name), F.when(test, F.lit(i)).otherwise(place)
    return rows.withColumn("strategy", name.cast("string")).withColumn("strategy_ord", place.cast("int")).where("strategy IS NOT NULL")


def colocated(registry: DataFrame, seeds: DataFrame) -> DataFrame:
    """The other tests of the seeds' files."""
    files = registry.join(seeds, "test_id", "left_semi").select("file_path").distinct()
    return registry.join(files, "file_path", "left_semi").join(seeds, "test_id", "left_anti")


def closure(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """node, depth: everything within so many hops of the seeds(node), each at its smallest depth.

    Edges and the front of each hop are cut from their lineage, so that the plan doesn't grow with the hops.
    """
    edges = cut(edges)
    reached = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = reached
    for d in range(1, hops + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(reached, "node", "left_anti").withColumn("depth", F.lit(d)))
        reached = reached.unionByName(frontier)
    return reached


def last_before(rows: DataFrame, key: str, order: list[str], label: Column, name: str) -> DataFrame:
    """As-of: the latest label strictly before each row of its key, null if there is none."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(label, ignorenulls=True).over(w))


def breakage(evidence: DataFrame, deleted: DataFrame, renamed: DataFrame) -> DataFrame:
    """test_id, symbol, reason: exact evidence on symbols that are gone; deleted beats renamed, then the first row."""
    gone = deleted.select("symbol", F.lit("deleted").alias("reason"), F.lit(0).alias("p")).unionByName(renamed.select(F.col("old").alias("symbol"), F.lit("renamed").alias("reason"), F.lit(1).alias("p")))
    hit = evidence.where(F.col("type") == "exact").join(gone, "symbol")
    return hit.groupBy("test_id").agg(F.min(F.struct("p", "seq", "symbol", "reason")).alias("b")).select("test_id", "b.symbol", "b.reason")
