"""Unified diffs as line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a changed line declares as a class or a function, and a constant.
SYMBOL = r"\b(?:class|interface|enum|def|function)\s+([A-Za-z_]\w*)"
# Marks of a defensive line.
GUARD = (
    r"(?i)(?:\?\?|\?\.|if\s*\([^)]*(?:null|undefined|None|==\s*0\b)|optional\s*\.|Optional<|@Nullable|nonnull|assert\.|guard"
    r"|isNull|isNone|is_empty|throw new (?:Illegal|NullPointer))"
)


def lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 0), line."""
    return diffs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def with_file(table: DataFrame, key: str) -> DataFrame:
    """Adds file: the nearest header at or above a line."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.regexp_extract("line", r"^diff --git a/(\S+) b/(\S+)", 2)
    return table.withColumn("file", F.last(F.when(header != "", header), ignorenulls=True).over(w))


def added() -> Column:
    return F.col("line").startswith("+") & ~F.col("line").startswith("+++")


def removed() -> Column:
    return F.col("line").startswith("-") & ~F.col("line").startswith("---")


def file_stats(table: DataFrame, key: str) -> DataFrame:
    """key, file, status, additions, deletions, hunks."""
    rows = with_file(table, key).where("file IS NOT NULL")
    out = rows.groupBy(key, "file").agg(F.count_if(added()).alias("additions"), F.count_if(removed()).alias("deletions"), F.count_if(F.col("line").startswith("@@")).alias("hunks"), F.max(F.col("line").startswith("new file")).alias("__new"), F.max(F.col("line").startswith("deleted file")).alias("__gone"))
    return out.withColumn("status", F.when(F.col("__new"), "added").when(F.col("__gone"), "deleted").otherwise("modified")).drop("__new", "__gone")


def numbered(table: DataFrame, key: str) -> DataFrame:
    """The changed lines of files: adds file, and number: in the new file for +, in the old one for -."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    start = lambda i: F.regexp_extract("line", r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", i).try_cast("int")
    hunk = F.col("line").startswith("@@")
    rows = with_file(table, key).withColumns({"__hunk": F.count_if(hunk).over(w), "__old": start(1), "__new": start(2)})
    inside = Window.partitionBy(key, "__hunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy(key, "__hunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = lambda test: F.coalesce(F.count_if(test).over(inside), F.lit(0))
    context = F.col("line").startswith(" ")
    number = F.when(added(), F.first("__new", ignorenulls=True).over(first) + before(added() | context)).otherwise(F.first("__old", ignorenulls=True).over(first) + before(removed() | context))
    return rows.withColumn("number", number.cast("int")).where("file IS NOT NULL").where(added() | removed()).drop("__hunk", "__old", "__new")


def change_type(table: DataFrame, key: str) -> DataFrame:
    """key, file, change_type: deleted or added by the file's status; comment_only: nothing added and no symbol;
    import_only: all changed lines among the first 50, and no symbol; else code."""
    per = numbered(table, key).groupBy(key, "file").agg(F.count_if(added()).alias("__a"), F.max(F.regexp_extract("line", SYMBOL, 1) != "").alias("__s"), F.max("number").alias("__m"))
    rows = file_stats(table, key).select(key, "file", "status").join(per, [key, "file"], "left")
    symbols, plus = F.coalesce("__s", F.lit(False)), F.coalesce("__a", F.lit(0))
    kind = F.when(F.col("status") != "modified", F.col("status")).when(~symbols & (plus <= 0), "comment_only").when(~symbols & (F.col("__m") <= 50), "import_only").otherwise("code")
    return rows.select(key, "file", kind.alias("change_type"))


def new_definitions(table: DataFrame, key: str, named: tuple[str, ...], patterns: dict[str, str]) -> DataFrame:
    """key, file, name: what the added lines of new files define: all that a pattern of named finds in a line, the last one in any case, and
    what the pattern of the file's extension finds (else the first of patterns)."""
    new = file_stats(table, key).where("status = 'added'").select(key, "file")
    one = lambda rx: F.regexp_extract("line", f"(?s){rx}", 1)
    own = one(next(iter(patterns.values())))
    for ext, rx in patterns.items():
        own = F.when(F.col("file").endswith(ext), one(rx)).otherwise(own)
    found = F.flatten(F.array(*[F.regexp_extract_all("line", F.lit(rx), 1) for rx in named], F.array(own, *[one(f"^.*{rx}") for rx in named])))
    return with_file(table, key).where(added()).join(new, [key, "file"], "left_semi").select(key, "file", F.explode(found).alias("name")).where("name <> ''").distinct()


def names(declarations: tuple[str, ...], last: str) -> Column:
    """array of what a changed line declares: the first pattern that fits, and the last one besides."""
    first = F.coalesce(*[F.nullif(F.regexp_extract("line", d, 1), F.lit("")) for d in declarations])
    return F.array_compact(F.array(first, F.nullif(F.regexp_extract("line", last, 1), F.lit(""))))


def renames(table: DataFrame, key: str, within: int = 4) -> DataFrame:
    """key, old, new: an exported constant that goes and, within so many lines, the next one that comes, if it has another
    name. Lines that only go, empty ones and headers lie between; a line of context ends the search."""
    name = lambda sign: F.regexp_extract("line", rf"^\{sign}\s*export\s+const\s+([A-Za-z_]\w*)", 1)
    order = Window.partitionBy(key).orderBy("line_no")
    ends = (F.trim("line") != "") & ~F.col("line").rlike("^[+@-]") | F.col("line").startswith("---")
    found = F.array(*[F.struct(F.lead(F.when(added(), name("+")).otherwise(F.lit("")), i).over(order).alias("new"), F.lead(ends, i).over(order).alias("ends")) for i in range(1, within + 1)])
    rows = table.select(key, F.when(removed(), name("-")).otherwise(F.lit("")).alias("old"), found.alias("next")).where("old <> ''")
    stop = F.struct(F.lit(True).alias("done"), F.lit("").alias("new"))
    step = lambda acc, x: F.when(acc["done"], acc).when(F.coalesce(x["new"], F.lit("")) != "", F.struct(F.lit(True).alias("done"), x["new"].alias("new"))).when(F.coalesce(x["ends"], F.lit(True)), stop).otherwise(acc)
    start = F.struct(F.lit(False).alias("done"), F.lit("").alias("new"))
    out = rows.select(key, "old", F.aggregate("next", start, step)["new"].alias("new"))
    return out.where((F.col("new") != "") & (F.col("new") != F.col("old")))


def symbol_delta(table: DataFrame, key: str, declarations: tuple[str, ...], last: str) -> DataFrame:
    """key, symbol, change: declared only on removed lines (deleted) or only on added ones (added), but for renamed ones."""
    rows = table.where(added() | removed()).select(key, F.explode(names(declarations, last)).alias("symbol"), F.when(added(), 1).otherwise(2).alias("side"))
    sides = rows.groupBy(key, "symbol").agg(F.bit_or("side").alias("s")).where("s < 3")
    moved = renames(table, key)
    gone = moved.select(key, F.col("old").alias("symbol"), F.lit(2).alias("s")).union(moved.select(key, F.col("new").alias("symbol"), F.lit(1).alias("s"))).distinct()
    return sides.join(gone, [key, "symbol", "s"], "left_anti").select(key, "symbol", F.when(F.col("s") == 1, "added").otherwise("deleted").alias("change"))


def scenario(table: DataFrame, key: str, sources: tuple[str, ...]) -> DataFrame:
    """key, n_files, n_source_kinds, n_exact (declared symbols), n_fn (functions), n_plus, n_guard of each diff."""
    ext = F.lower(F.regexp_extract("file", r"(\.[^./]+)$", 1))
    symbol, function = F.regexp_extract("line", SYMBOL, 1), F.regexp_extract("line", r"\b(?:def|function)\s+([A-Za-z_]\w*)", 1)
    changed, some = added() | removed(), lambda c, test: F.countDistinct(F.when(test & (c != ""), c))
    return with_file(table, key).groupBy(key).agg(
        F.countDistinct("file").alias("n_files"), F.countDistinct(F.when(ext.isin(*sources), ext)).alias("n_source_kinds"), some(symbol, changed).alias("n_exact"), some(function, changed).alias("n_fn"),
        F.count_if(added()).alias("n_plus"), F.count_if(added() & F.col("line").rlike(GUARD)).alias("n_guard"),
    )


def scenario_tags() -> Column:
    """array of tags over scenario()'s columns, in a fixed order."""
    n, exact = F.col("n_files"), F.col("n_exact")
    blast = (n >= 12) | ((exact >= 20) & (n >= 5))
    guard = F.col("n_plus").between(1, 20) & (F.col("n_guard") >= F.greatest(F.lit(2), F.floor(F.lit(0.45) * F.col("n_plus"))))
    return F.array_compact(F.array(
        F.when(F.col("n_source_kinds") > 1, "MIXED_LANGUAGE_DIFF"),
        F.when(blast, "MAXIMUM_BLAST_RADIUS").when((n <= 1) & (exact <= 4) & (F.col("n_fn") <= 2), "TIGHT_FEATURE_ISOLATION"),
        F.when(guard, "MICRO_GUARD_HOTFIX"), F.when(F.col("n_fn") >= 1, "SYMBOL_LEVEL_CHANGES"),
    ))
