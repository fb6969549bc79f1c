"""Reports and small control relations: impact bundles, hints, KPIs, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def false_negative_hints(tags: Column, dead: Column) -> Column:
    """What may have been missed, in a fixed order."""
    # The texts of the hints.
    large = "FN_RISK: Large change set — run area suites or full test job in addition to listed tests."
    unmapped = "FN_RISK: %d changed symbol(s) have no mapped tests — manual review."
    mixed = "FN_RISK: Verify each language's test pipeline was indexed for this repo."
    return F.array_compact(F.array(
        F.when(F.array_contains(tags, "MAXIMUM_BLAST_RADIUS"), large), F.when(dead > 0, F.format_string(unmapped, dead)), F.when(F.array_contains(tags, "MIXED_LANGUAGE_DIFF"), mixed),
    ))


# Notes on precision, by tag, and the one where no tag says anything.
NOTES = (
    "Diff looks like small null/guard edits: prefer function-level and exact-symbol matches; module-wide matches may include false positives.",
    "Large blast radius: listed tests may miss some affected areas (false negatives). Consider broader suites or full CI.",
    "Multiple languages in one diff: ensure analysis ran for each language; semantic search may bridge gaps.",
    "Small, focused change: AST matches are usually reliable; semantic hits are optional.",
    "Review tests tagged semantic-only or module-pattern with extra care (FP risk).",
)
NOTED = ("MICRO_GUARD_HOTFIX", "MAXIMUM_BLAST_RADIUS", "MIXED_LANGUAGE_DIFF", "TIGHT_FEATURE_ISOLATION")


def precision_notes(tags: Column) -> Column:
    """array of what a change's tags say of the precision of its matches."""
    said = F.array_compact(F.array(*[F.when(F.array_contains(tags, t), n) for t, n in zip(NOTED, NOTES, strict=False)]))
    return F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(NOTES[-1])))


def impact(tests: DataFrame, change: DataFrame, gaps: DataFrame) -> DataFrame:
    """One bundle of a change as rows (part, key, value): its tags, notes and hints, its symbols without tests, and of each
    test its linkage, quality and risk. change: tags (one row); gaps: symbol; tests: test_id, linkage, quality, risk."""
    n = gaps.agg(F.count("*").cast("int").alias("__gaps"))
    shape = change.crossJoin(n)  # one row each
    lists = F.array(*[F.struct(F.lit(p).alias("part"), v.alias("values")) for p, v in (
        ("tag", F.col("tags")), ("note", precision_notes(F.col("tags"))), ("hint", false_negative_hints(F.col("tags"), F.col("__gaps"))), ("gaps", F.array(F.col("__gaps").cast("string"))),
    )])
    told = shape.select(F.explode(lists).alias("x")).select("x.part", F.posexplode("x.values").alias("key", "value"))
    per = F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("value")) for c in ("linkage", "quality", "risk")])
    each = tests.select(F.col("test_id").cast("string").alias("key"), F.explode(per).alias("x")).select("x.part", "key", "x.value")
    return told.select("part", F.col("key").cast("string").alias("key"), "value").unionByName(each).unionByName(gaps.select(F.lit("gap").alias("part"), F.col("symbol").alias("key"), F.lit("no test").alias("value")))


def fallbacks(defaults: dict[str, str]) -> list[Column]:
    """n_tests, n_modules, n_production, framework: each from the first of its sources that says something."""
    zero, named = F.lit(0), F.try_element_at(F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]), F.col("lang"))
    chain = lambda name, *xs: F.coalesce(*xs).alias(name)
    return [
        chain("n_tests", F.col("n_tests"), zero), chain("n_modules", F.col("n_classes"), F.col("n_dirs"), zero), chain("n_production", F.col("n_direct"), F.col("n_classes"), zero),
        chain("framework", F.col("framework"), named, F.lit("unknown")),
    ]


def first_k(pairs: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """group, values: the k smallest distinct values of each group; the others go before any list is made."""
    w = Window.partitionBy(group).orderBy(value)
    kept = pairs.select(group, value).distinct().withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return kept.groupBy(group).agg(F.sort_array(F.collect_list(value)).alias("values"))


def threshold(default: Column, override: Column, preset: Column) -> Column:
    """An override, clamped to [0.05, 0.92]; else a preset (lenient, balanced, strict); else the default."""
    named = F.when(preset == "lenient", 0.22).when(preset == "balanced", 0.32).when(preset == "strict", 0.50)
    return F.coalesce(F.when(override.isNotNull(), F.greatest(F.lit(0.05), F.least(F.lit(0.92), override))), named, default)


def resolve_imports(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(src, target) -> src, target, file_path: the first of target, target.js, target.ts, target/index.js that exists."""
    endings = F.array(*[F.struct(F.lit(i).alias("p"), F.concat("target", F.lit(e)).alias("file_path")) for i, e in enumerate(["", ".js", ".ts", "/index.js"])])
    tried = wanted.select("src", "target", F.explode(endings).alias("c")).select("src", "target", "c.p", "c.file_path")
    found = tried.join(files.select("file_path").distinct(), "file_path", "left_semi")
    return found.groupBy("src", "target").agg(F.min_by("file_path", "p").alias("file_path"))


def path_fallback(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(path) -> path, file_path, how: exact match, else by the last two segments, else by name; smallest path first."""
    name, tail = (lambda c: F.element_at(F.split(c, "/"), -1)), (lambda c: F.array_join(F.slice(F.split(c, "/"), -2, 2), "/"))
    known = files.select("file_path").distinct()
    keys = lambda c: F.array(F.struct(F.lit(0).alias("how"), c.alias("k")), F.struct(F.lit(1).alias("how"), tail(c).alias("k")), F.struct(F.lit(2).alias("how"), name(c).alias("k")))
    w = wanted.where(F.size(F.split("path", "/")) > 1).select("path", F.explode(keys(F.col("path"))).alias("x")).select("path", "x.how", "x.k")
    f = known.where(F.size(F.split("file_path", "/")) > 1).select("file_path", F.explode(keys(F.col("file_path"))).alias("x")).select("file_path", "x.how", "x.k")
    # the smallest file of each key is all that a match needs, so that common names stay one row
    f = f.groupBy("how", "k").agg(F.min("file_path").alias("file_path"))
    best = w.join(f, ["how", "k"]).groupBy("path").agg(F.min(F.struct("how", "file_path")).alias("b"))
    return best.select("path", "b.file_path", "b.how")


def hashing_vectors(texts: DataFrame, dims: int = 32) -> DataFrame:
    """test_id, embedding: a deterministic stand-in for a model, signed counts of hashed words, L2-normalised."""
    words = texts.select("test_id", F.explode(F.split(F.lower("body"), r"\W+")).alias("w")).where("w <> ''")
    slot, sign = F.pmod(F.xxhash64("w"), F.lit(dims)).cast("int"), F.when(F.pmod(F.shiftright(F.xxhash64("w"), 40), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    parts = words.select("test_id", slot.alias("slot"), sign.alias("v")).groupBy("test_id", "slot").agg(F.sum("v").alias("v"))
    rows = parts.groupBy("test_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    every = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")))
    return rows.select("test_id", F.transform(every, lambda x: x.cast("float")).alias("embedding"))


def vector_rows(vectors: DataFrame, dims: int, most: int = 1000) -> DataFrame:
    """What a vector store takes of (test_id, embedding, repo, description, is_async, markers): an id by repository and
    test, and flat metadata of strings, descriptions cut to `most` characters. Any other dimension is an error when the
    rows are read, so that no batch is stored in part."""
    checked = F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.lit("embedding of another dimension")))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return vectors.where("test_id IS NOT NULL").select(
        F.concat_ws("_", F.nullif("repo", F.lit("")), F.col("test_id").cast("string")).alias("id"), checked.alias("embedding"), text(F.col("test_id")).alias("test_id"),
        F.left(text(F.col("description")), F.lit(most)).alias("description"), F.when(F.col("is_async"), "true").otherwise("false").alias("is_async"), F.array_join("markers", ",").alias("markers"), text(F.col("repo")).alias("test_repo_id"),
    )


def first_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
