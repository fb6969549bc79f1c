"""Confidence from evidence. Evidence is one long table: test_id, seq, type, reference_type, source, similarity,
match_strategy, weak; seq orders a test's rows (ties: reference_type). weak marks a hit on a lower-case module name,
which files elsewhere may share.

Scores are computed in DOUBLE and floored; per test everything is one hash aggregate over fixed-size buffers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize

#: Evidence types, in bit order, and the base scores.
TYPES = (
    "function_level", "exact", "direct_file", "integration", "module", "semantic", "semantic_colocation", "cochanged_test_suite",
    "direct_test_file", "direct_file_match", "module_pattern",
)
SEMANTIC = ("semantic", "semantic_colocation")
STRUCTURAL = tuple(t for t in TYPES if t not in SEMANTIC)
BASE_PATCH, BASE_FUNCTION = 95, 85
BASE_EXACT, BASE_STRING, BASE_TRANSITIVE, BASE_OTHER = 75, 65, 58, 60
BASE_FILE, BASE_INTEGRATION = 50, 40
BASE_MODULE_DIRECT, BASE_MODULE = 55, 45
DIRECT_KINDS = ("direct_import", "source_annotation", "source_annotation_normalized", "describe_label")
ITEM = "struct<seq:int,type:string,term:string,reference_type:string,source:string,similarity:double,weak:boolean>"
ROW = "struct<seq:int,type:string,reference_type:string,source:string,similarity:double,match_strategy:string,weak:boolean>"
EVIDENCE = "test_id long, seq int, type string, reference_type string, source string, similarity double, match_strategy string, weak boolean"


def base_value(transitive: int = BASE_TRANSITIVE) -> Column:
    kind, ref = F.col("type"), F.col("reference_type")
    exact = F.when(ref == "direct_import", BASE_EXACT).when(ref == "string_ref", BASE_STRING).when(ref.startswith("transitive_"), transitive).otherwise(BASE_OTHER)
    return (
        F.when(kind == "function_level", F.when(F.col("source") == "patch_ref", BASE_PATCH).otherwise(BASE_FUNCTION))
        .when(kind == "exact", exact)
        .when(kind == "direct_file", BASE_FILE)
        .when(kind == "integration", BASE_INTEGRATION)
        .when(kind == "module", F.when(ref == "direct_import", BASE_MODULE_DIRECT).otherwise(BASE_MODULE))
        .otherwise(0)
    )


def type_bits() -> Column:
    out = F.lit(0)
    for i, t in enumerate(TYPES):
        out = F.when(F.col("type") == t, F.lit(1 << i)).otherwise(out)
    return out


def has(*kinds: str) -> Column:
    """Whether there is evidence of any of these types."""
    return F.col("types").bitwiseAND(F.lit(sum(1 << TYPES.index(k) for k in kinds))) != 0


def has_semantic() -> Column:
    return has(*SEMANTIC)


def profile(evidence: DataFrame, *carry: str) -> DataFrame:
    """test_id, what else evidence says of the test (carry), and base, base_v1, types (bits), first_base, vec, n_evidence, direct (a direct reference exists), strong
    (structural evidence that is not weak), coloc flags."""
    value = base_value()
    not_semantic = F.col("type") != "semantic"
    return evidence.groupBy("test_id", *carry).agg(
        F.max(value).alias("base"), F.max(base_value(BASE_OTHER)).alias("base_v1"), F.bit_or(type_bits()).alias("types"),
        F.min_by(F.when(value > 0, F.col("type")), F.when(value > 0, F.struct("seq", F.coalesce("reference_type", F.lit(""))))).alias("first_base"),
        F.coalesce(F.max(F.when(F.col("type") == "semantic", F.floor(F.col("similarity") * F.lit(100.0)))), F.lit(0)).alias("vec"),
        F.count("*").alias("n_evidence"), F.max(F.coalesce(not_semantic & F.col("reference_type").isin(*DIRECT_KINDS), F.lit(False))).alias("direct"),
        F.min(F.when(not_semantic, F.coalesce(F.col("match_strategy") == "colocated_in_same_file", F.lit(False)))).alias("coloc_only"),
        F.max(F.coalesce(F.col("match_strategy") == "semantic_colocated_file", F.lit(False))).alias("sem_coloc"),
        F.max(F.col("type").isin(*STRUCTURAL) & ~F.coalesce(F.col("weak"), F.lit(False))).alias("strong"),
    )


def _ast(base: Column) -> Column:
    kind = F.lower(F.coalesce("test_type", F.lit("")))
    score = base + F.when(has("function_level"), 10).otherwise(0) + F.when(F.bit_count("types") > 1, 5).otherwise(0)
    score = score - F.when(F.col("first_base") == "module", 10).otherwise(0) - F.when(has("function_level") | has("exact"), 0).otherwise(5)
    score = score + F.when(kind == "unit", 5).when(kind == "integration", 3).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(c))).cast("int")


def confidence(profiled: DataFrame) -> DataFrame:
    """Adds ast, score, ast_part, vec_part. Needs test_type."""
    rows = profiled.withColumn("ast", _ast(F.col("base")))
    total = F.floor(F.col("ast") * F.lit(0.6) + F.col("vec") * F.lit(0.4))
    total = F.when(has("direct_file") & (F.col("vec") == 0), F.greatest(total, F.lit(45))).otherwise(total)
    return rows.withColumn("score", clamp(total)).withColumn("ast_part", F.round(F.col("ast") * F.lit(0.6), 1)).withColumn("vec_part", F.round(F.col("vec") * F.lit(0.4), 1))


def confidence_v1(profiled: DataFrame) -> DataFrame:
    """Adds score_v1, which orders structural results only."""
    exact, sem = has("exact") | has("function_level"), F.col("vec") > 0
    confirmed = exact | has("direct_file")
    rows = profiled.withColumn("__a", F.when(confirmed, F.greatest(_ast(F.col("base_v1")), F.lit(55))).otherwise(_ast(F.col("base_v1"))))
    a, v = F.col("__a"), F.col("vec")
    total = F.when(confirmed & sem, a * F.lit(0.45) + v * F.lit(0.3)).when(confirmed, a * F.lit(0.75)).when(sem, v * F.lit(0.75)).otherwise(F.lit(0.0))
    total = total + F.when(sem & exact, 15.0).otherwise(0.0)
    total = F.when(~exact & (a == 0) & (v >= 70), F.greatest(total, F.floor(v * F.lit(0.75)).cast("double"))).otherwise(total)
    rows = rows.withColumn("__t", total)
    t = F.col("__t")
    lifted = F.when(~sem & (a > 0) & (t < 50), F.greatest(F.lit(50.0), F.floor(a * F.lit(0.6)).cast("double"))).otherwise(t)
    return rows.withColumn("score_v1", clamp(lifted)).drop("__a", "__t")


def band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 50, "medium").otherwise("low")


def evidence_quality() -> Column:
    return (
        F.when(has("function_level"), "CONFIRMED_FUNCTION").when(has("direct_file", "direct_test_file"), "CONFIRMED_FILE").when(has("exact"), "CONFIRMED_SYMBOL")
        .when(has("integration"), "INTEGRATION_SCOPE").when(has("module"), "BROAD_MODULE").when(has("semantic"), "SEMANTIC_SUPPLEMENT").otherwise("UNKNOWN")
    )


def false_positive_risk(relevant: Column, hotfix: Column | None = None) -> Column:
    """relevant: whether the test's label shares a word with the change; hotfix: whether the change is a guard edit."""
    strong = has("exact", "function_level")
    hotfix = F.lit(False) if hotfix is None else hotfix
    return (
        F.when(has_semantic() & ~is_structural() & ~relevant, "HIGH").when(has("semantic") & ~strong, F.when(has("module"), "MEDIUM").otherwise("MEDIUM_HIGH"))
        .when(has("module") & ~strong, F.when(hotfix, "MEDIUM_HIGH").otherwise("MEDIUM")).when(strong, "LOW").otherwise("LOW_MEDIUM")
    )


def is_structural() -> Column:
    return has(*STRUCTURAL)


def dependency_hint() -> Column:
    only_exact = has("exact") & ~has("semantic")
    return F.when(is_structural() & (F.col("direct") | has("function_level") | only_exact), "independent").otherwise("cross_dependent")


def relevant(label: Column, tokens: list[str]) -> Column:
    """Whether a test's label shares a word of four letters or more with the change; true where it has no label."""
    return (F.coalesce(label, F.lit("")) == "") | F.arrays_overlap(tokenize(label, 4), F.array(*map(F.lit, tokens)).cast("array<string>"))


def keep(label_fits: Column, symbol_fits: Column, minimum: int = 42, both: int = 30) -> Column:
    """The confidence gate. Structural and semantic evidence: from `both` on; semantic co-location: always; structural
    alone: from `minimum` on; semantic alone: whatever the score, if the label fits the changed symbols.

    Tests that are only co-located go without semantic evidence. Tests with weak structural evidence only go unless
    their label fits the change.
    """
    semantic = has_semantic()
    gate = F.when(is_structural() & semantic, F.col("score") >= both).when(F.col("sem_coloc"), True).when(is_structural(), F.col("score") >= minimum)
    gate = gate.when(semantic, symbol_fits).otherwise(F.col("score") >= minimum)
    only_near = F.coalesce("coloc_only", F.lit(False)) & ~semantic & ~F.col("sem_coloc")
    return gate & ~only_near & (~is_structural() | F.col("strong") | label_fits)
