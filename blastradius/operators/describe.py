"""A change in words, as a query for semantic search: from its changed functions, else from its files and what its lines declare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an added line declares, where no function changed.
DECLARED = r"(?m)^\+(?!#|//).*?\b(?:const|let|var|export\s+const|export\s+default)\s+([A-Za-z_][A-Za-z0-9_]*)"
TYPED = r"(?m)^\+.*?\b(?:enum|interface|type)\s+([A-Za-z_][A-Za-z0-9_]*)"
MOST_FILES, MOST_SYMBOLS = 3, 10


def _listed(title: str, names: Column) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit(f"{title}: "), F.array_join(names, ", ")))


def _calls(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda f: F.concat(f, F.lit("()"))), ", ")


def by_functions(functions: Column, files: Column) -> Column:
    """array of sentences; functions: array of (module, function), files: array of (file, status, classes, methods)."""
    modules = F.array_distinct(F.transform(functions, lambda f: f["module"]))
    of = lambda m: F.transform(F.filter(functions, lambda f: f["module"] == m), lambda f: f["function"])
    first = modules[0]
    path = F.concat(F.replace(first, F.lit("."), F.lit("/")), F.lit(".py"))
    own = F.try_element_at(F.filter(files, lambda x: x["file"].endswith(".py") & F.contains(x["file"], path)), F.lit(1))
    one = F.array(
        F.concat(F.lit("Changed in module: "), first), F.concat(F.lit("Changed functions: "), _calls(of(first))),
        F.concat(F.lit("File: "), own["file"]), _listed("Classes", own["classes"]), F.when(own["status"] == "added", "Status: New file"),
    )
    many = F.concat(F.array(F.lit("Changed across multiple modules:")), F.transform(modules, lambda m: F.concat(F.lit("  - "), m, F.lit(": "), _calls(of(m)))))
    total = F.when(F.size(functions) > 1, F.concat(F.lit("Total functions changed: "), F.size(functions).cast("string")))
    return F.array_compact(F.concat(F.when(F.size(modules) == 1, one).otherwise(many), F.array(total)))


def by_files(files: Column, body: Column) -> Column:
    """array of sentences where no function changed."""
    def of(x: Column) -> Column:
        parts = F.split(x["file"], "/")
        stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
        return F.array(F.concat(F.lit("Changed file: "), stem), F.concat(F.lit("In: "), F.try_element_at(parts, F.lit(-2))), _listed("Classes", x["classes"]), _listed("Methods", x["methods"]))

    named = F.filter(files, lambda x: x["file"] != "")
    symbols = F.array_distinct(F.concat(*[F.regexp_extract_all(body, F.lit(rx), F.lit(1)) for rx in (DECLARED, TYPED)]))
    told = F.flatten(F.transform(F.slice(named, 1, MOST_FILES), of))
    return F.array_compact(F.concat(told, F.array(_listed("Changed symbols", F.slice(symbols, 1, MOST_SYMBOLS)))))


def description(functions: Column, files: Column, body: Column) -> Column:
    parts = F.when(F.size(functions) > 0, by_functions(functions, files)).otherwise(by_files(files, body))
    return F.transform(F.array(parts), lambda p: F.when(F.size(p) > 0, F.concat(F.array_join(p, ". "), F.lit("."))).otherwise(""))[0]


def adaptive(found: Column, functions: Column, exact: Column, modules: Column, n_files: Column, threshold: Column, variations: Column) -> tuple[Column, Column]:
    """Threshold and number of query variations, by what the index found and the change holds (counts); values that the
    user set (or null) stand."""
    base = F.when(found == 0, F.when(exact > 0, 0.40).otherwise(0.50)).otherwise(0.45)
    n = F.when(found == 0, 5).when((functions > 0) | (exact > 0), 3).otherwise(4)
    return F.coalesce(threshold, base), F.coalesce(variations, F.when(n_files > 3, F.least(n + 1, F.lit(6))).otherwise(n))


def branches(listed: DataFrame, fetched: DataFrame, wanted: DataFrame, default: str | None) -> DataFrame:
    """name, is_default, protected, commit_id, commit_message, fetched: a repository's branches, one row for each trimmed name.

    listed: name, is_default, protected, commit_id, commit_message, place (the first one of a name counts); of wanted(name) those
    that aren't listed are taken from fetched (same columns). With a default known, that one alone is flagged.
    """
    rows = listed.withColumn("name", F.trim("name")).where("name <> ''")
    first = rows.groupBy("name").agg(F.min_by(F.struct("is_default", "protected", "commit_id", "commit_message"), "place").alias("b"))
    rows = first.select("name", "b.*", F.lit(False).alias("fetched"))
    missing = wanted.select(F.trim("name").alias("name")).distinct().join(rows, "name", "left_anti")
    more = fetched.withColumn("name", F.trim("name")).join(missing, "name", "left_semi").groupBy("name").agg(F.min_by(F.struct("is_default", "protected", "commit_id", "commit_message"), "place").alias("b"))
    every = rows.unionByName(more.select("name", "b.*", F.lit(True).alias("fetched")))
    flag = F.coalesce("is_default", F.lit(False)) if default is None else F.col("name") == default
    text = lambda c, n: F.left(F.coalesce(c, F.lit("")), F.lit(n)).alias(c)
    return every.select("name", flag.alias("is_default"), F.coalesce("protected", F.lit(False)).alias("protected"), text("commit_id", 8), text("commit_message", 200), "fetched")
