"""Column functions on paths, symbols and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File stems that name no particular file, for the lookup of tests by stem.
GENERIC_STEMS = (
    "index", "main", "app", "config", "types", "utils", "helpers", "common", "shared", "base",
    "reducer", "reducers", "actions", "action", "store", "stores", "state", "selectors", "selector", "saga", "sagas", "epic", "epics",
    "service", "services", "middleware", "middlewares", "context", "contexts", "hooks", "hook",
)
# Names of test files by extension.
TEST_NAMES = {
    ".py": ("test_*.py", "*_test.py"),
    ".js": ("*.test.js", "*.spec.js", "*.test.jsx", "*.spec.jsx"),
    ".jsx": ("*.test.js", "*.spec.js", "*.test.jsx", "*.spec.jsx"),
    ".ts": ("*.test.ts", "*.spec.ts", "*.test.tsx", "*.spec.tsx"),
    ".tsx": ("*.test.ts", "*.spec.ts", "*.test.tsx", "*.spec.tsx"),
    ".java": ("*Test.java", "*Tests.java", "*Spec.java"),
    ".go": ("*_test.go",),
    ".rb": ("*_spec.rb", "*_test.rb"),
}
# Stems that are too general for a pattern of their own, where dead zones are looked for.
DEAD_ZONE_STEMS = ("util", "utils", "index", "main", "test", "tests", "common", "base", "core", "api", "data", "mock", "helper", "helpers", "config", "types", "type")
LEAST_STEM, LEAST_TAIL = 4, 5


def stems(paths: tuple[str, ...]) -> list[str]:
    """Lower-cased stems of changed files that are worth looking for."""
    found = [p.replace("\\", "/").rsplit("/", 1)[-1].lower() for p in paths]
    return [s for s in dict.fromkeys(f.rsplit(".", 1)[0] if "." in f[1:] else f for f in found) if s and s not in GENERIC_STEMS]


def stem_match(path: Column, stem: str) -> Column:
    """Whether a test or spec file's path holds the stem, any case; generic stems match nothing."""
    if stem.lower() in GENERIC_STEMS:
        return F.lit(False)
    return path.ilike(f"%{stem}%.test%") | path.ilike(f"%{stem}%.spec%")


def tail_match(path: Column, changed: str) -> Column:
    """Whether a path ends in the changed file's name, or holds its last two segments; any case, either slash."""
    parts = changed.replace("\\", "/").split("/")
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    out = p.ilike(f"%{parts[-1]}") if parts[-1] else F.lit(False)
    return out | p.ilike("%" + "/".join(parts[-2:]) + "%") if len(parts) > 1 else out


def classify_path(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike(r"(^|/)(tests?|__tests__)/|\.(test|spec)\."), "test").when(p.rlike(r"\.(html|js|py|java)([?#]|$)"), "production").otherwise("other")


def is_test_path(path: Column) -> Column:
    """Whether a path is a test's, by its folders and marks in its name; either slash, any case."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return p.rlike(r"(?i)(\.test\.|\.spec\.|/__tests__/|/tests?/|test_repository/|\.feature\.test\.)") | F.lower(path).rlike(r"(\.test\.js|\.spec\.ts)$")


def is_production_path(path: Column, extensions: tuple[str, ...], skipped: tuple[str, ...]) -> Column:
    """Whether a path has an extension of production code, and holds nothing that is skipped."""
    low, out = F.lower(path), F.lit(False)
    for e in extensions:
        out = out | path.endswith(e)
    out = out & ~low.endswith("test.py")
    for s in skipped:
        out = out & ~F.contains(low, F.lit(s))
    return out


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def tokenize(symbol: Column, least: int = 3) -> Column:
    """Lower-cased distinct words of a camelCase, acronym or snake_case name, in order."""
    split = F.regexp_replace(F.regexp_replace(symbol, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_distinct(F.transform(F.filter(F.split(split, "[^a-zA-Z0-9]+"), lambda t: F.length(t) >= least), F.lower))


def normalize_path(path: Column) -> Column:
    """What follows test_repository, else parent/name in a known folder, else the name."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    inner = F.regexp_extract(p, r"test_repository/*(.*)$", 1)
    known = F.regexp_extract(p, r"(?:^|/)((?:unit|integration|e2e|tests?)/[^/]+)$", 1)
    return F.when(F.contains(p, F.lit("test_repository")), inner).when(known != "", known).otherwise(basename(path))


def normalize_import(spec: Column) -> Column:
    """The stem of an import path; null for scoped packages and bare names."""
    stem = F.regexp_extract(spec, r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)
    return F.when(spec.startswith("@") | ~spec.contains("/"), F.lit(None)).otherwise(stem)


def module_candidates(path: Column) -> Column:
    """Dotted module, its first segment and, of scripts, its last one; distinct. Prefixes go one after the other."""
    dotted = F.replace(F.regexp_replace(path, r"\.[A-Za-z]+$", ""), F.lit("/"), F.lit("."))
    for prefix in ("backend", "client", "src"):
        dotted = F.regexp_replace(dotted, rf"^{prefix}\.", "")
    last = F.when(F.lower(path).rlike(r"\.(js|jsx|ts|tsx)$"), F.substring_index(dotted, ".", -1))
    return F.array_distinct(F.array_compact(F.array(dotted, F.substring_index(dotted, ".", 1), last)))


def test_file_candidates(path: Column) -> Column:
    """Sorted names that a file's tests may have, by its extension's patterns: after its stem, and its folder and stem."""
    stem, ext = F.regexp_replace(basename(path), r"\.[^.]*$", ""), F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    parent = F.try_element_at(F.split(path, "/"), F.lit(-2))
    names = F.array_compact(F.array(stem, F.concat_ws("_", parent, stem)))
    filled = lambda p: F.transform(names, lambda n: F.replace(F.lit(p), F.lit("*"), n))
    out = F.array().cast("array<string>")
    for e, patterns in TEST_NAMES.items():
        every = F.flatten(F.array(*map(filled, patterns)))
        out = F.when(ext == e, F.array_sort(F.array_distinct(every))).otherwise(out)
    return out


def head_tail(text: Column, head: int, tail: int) -> Column:
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(" ... "), F.right(text, F.lit(tail))))


def label_head(label: Column) -> Column:
    """A describe label up to the first connector word or mark between blanks."""
    first = F.trim(F.element_at(F.split(F.trim(label), r"(?i)\s+(?:with|uses|from|for|in|that|>|→|:|—|–)\s+", 2), 1))
    return F.trim(F.substring_index(first, " > ", 1))


def dead_zone_patterns(stem: Column, path: Column) -> Column:
    """array of LIKE patterns by which an index may know a file: its last two segments, and its stem (a short or general
    one only at either end of a dotted name)."""
    p = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    tail = F.array_join(F.slice(F.split(p, "/"), -2, 2), "/")
    s = F.coalesce(stem, F.lit(""))
    own = (F.length(s) >= LEAST_STEM) & ~F.lower(s).isin(*DEAD_ZONE_STEMS)
    both = F.when(s != "", F.array(F.concat(s, F.lit(".%")), F.concat(F.lit("%."), s))).otherwise(F.array().cast("array<string>"))
    first = F.when(F.contains(p, F.lit("/")) & (F.length(tail) >= LEAST_TAIL), F.array(F.concat(F.lit("%"), tail, F.lit("%")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(first, F.when(own, F.array(F.concat(F.lit("%"), s, F.lit("%")))).otherwise(both)))


def symbol_patterns(symbol: Column) -> Column:
    """array of LIKE patterns by which an index may know a symbol: itself, as either end of a dotted name, and its last part."""
    last = F.substring_index(symbol, ".", -1)
    own = (F.length(last) >= LEAST_STEM) & ~F.lower(last).isin(*DEAD_ZONE_STEMS)
    more = F.when((last == "") | (last == symbol), F.array().cast("array<string>")).when(own, F.array(F.concat(F.lit("%"), last, F.lit("%")))).otherwise(F.array(F.concat(last, F.lit(".%")), F.concat(F.lit("%."), last)))
    every = F.concat(F.array(symbol, F.concat(symbol, F.lit(".%")), F.concat(F.lit("%."), symbol)), more)
    return F.when(F.coalesce(symbol, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def screaming(name: Column) -> Column:
    """Whether a name is a constant's: it starts with a capital and has no small letter."""
    return name.rlike("^[A-Z]") & (F.upper(name) == name)


def readable(name: Column) -> Column:
    """A test's name as words: without test_, underscores as blanks."""
    return F.replace(F.replace(name, F.lit("test_"), F.lit("")), F.lit("_"), F.lit(" "))


def fixed_chunks(text: Column, width: int) -> Column:
    """array of (chunk_no, chunk) of so many characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.length(text) - 1) / width).cast("int")))
    return F.transform(starts, lambda i: F.struct(i.alias("chunk_no"), F.substring(text, i * width + 1, F.lit(width)).alias("chunk")))
