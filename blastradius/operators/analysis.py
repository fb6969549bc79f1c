"""What test sources say of their tests, as rows: calls and the tests that own them, import bindings, fixtures, decorators,
annotations, reflection, injected fields, mocks, async tests, metadata, and what Java tests without imports stand for.

Sources are rows (file_id, language, body); all matches are found by built-in functions, each with the line on which it
stands. A file's matches are bounded by its text; nothing gathers rows of several files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import extract as E

# Objects whose calls say nothing of production code, by language (lower case).
SKIPPED_OBJECTS = {
    "javascript": (
        "expect", "describe", "it", "test", "jest", "mock", "beforeeach", "aftereach", "beforeall", "afterall",
        "console", "math", "json", "object", "array", "promise",
    ),
    "python": ("pytest", "unittest", "mock", "assert", "self", "cls", "os", "sys", "json", "pathlib", "typing", "collections", "datetime", "logging", "re"),
    "java": ("mockito", "assert", "verify", "when", "then", "given", "mock", "spy", "self", "this", "super", "system", "out", "print"),
}
# Names that are no functions of their own, where a line begins with a call.
SKIPPED_FUNCTIONS = (
    "print", "len", "str", "int", "float", "list", "dict", "set", "tuple", "range", "enumerate", "zip", "map", "filter", "sorted", "reversed",
    "isinstance", "type", "hasattr", "getattr", "setattr", "delattr", "assert", "raise", "return", "yield", "pass", "break", "continue", "import",
    "from", "def", "class", "if", "elif", "else", "for", "while", "try", "except", "finally", "with", "as", "lambda",
)
METHOD_CALL, LINE_CALL = r"(\w+)\.(\w+)\s*\(", r"(?m)^(\w+)\s*\("
PATCH = r"(?:patch|mock\.patch|unittest\.mock\.patch)\s*\(\s*[\"']([^\"']+)[\"']"
# Reflection calls in Java: pattern (a group for its target), name, kind of target.
REFLECTION = (
    (r"Class\.forName\s*\(\s*[\"']([^\"']+)[\"']", "forName", "target_class"),
    (r"\.getDeclaredMethod\s*\(\s*[\"']([^\"']+)[\"']", "getDeclaredMethod", "target_method"),
    (r"\.getMethod\s*\(\s*[\"']([^\"']+)[\"']", "getMethod", "target_method"),
    (r"\.getDeclaredField\s*\(\s*[\"']([^\"']+)[\"']", "getDeclaredField", "target_field"),
    (r"\.getField\s*\(\s*[\"']([^\"']+)[\"']", "getField", "target_field"),
    (r"\.getDeclaredConstructor\s*\(", "getDeclaredConstructor", None),
    (r"\.getConstructor\s*\(", "getConstructor", None),
    (r"\.newInstance\s*\(", "newInstance", None),
    (r"\.invoke\s*\(", "invoke", None),
    (r"MethodHandles\.lookup\s*\(", "lookup", None),
    (r"MethodHandles\.findVirtual\s*\(", "findVirtual", None),
    (r"MethodHandles\.findStatic\s*\(", "findStatic", None),
    (r"ReflectionUtils\.findMethod\s*\(", "findMethod", None),
    (r"ReflectionUtils\.findField\s*\(", "findField", None),
    (r"ReflectionTestUtils\.setField\s*\(", "setField", None),
    (r"ReflectionTestUtils\.getField\s*\(", "getField", None),
    (r"ReflectionTestUtils\.invokeMethod\s*\(", "invokeMethod", None),
)
# Annotations that inject a field.
INJECTED = ("Autowired", "Inject", "Mock", "MockBean", "Spy", "SpyBean", "InjectMocks", "Captor", "Value", "Resource", "Qualifier")
FIELD = r"@(" + "|".join(INJECTED) + r")\s*(?:\([^)]*\))?\s*\n\s*(?:private|protected|public)?\s*(?:static\s+)?(?:final\s+)?([\w<>\[\].,? ]+?)\s+(\w+)\s*[;=]"
# Mocks in scripts: pattern (a group for its target), name.
MOCKS = (
    (r"jest\.mock\s*\(([^)]+)\)", "jest.mock", True),
    (r"jest\.fn\s*\(", "jest.fn", False),
    (r"jest\.spyOn\s*\(([^)]+)\)", "jest.spyOn", True),
    (r"sinon\.mock\s*\(([^)]+)\)", "sinon.mock", True),
    (r"sinon\.stub\s*\(([^)]+)\)", "sinon.stub", True),
    (r"mock\(([^)]+)\)", "mock", True),
    (r"vi\.mock\s*\(([^)]+)\)", "vi.mock", True),
    (r"vi\.fn\s*\(", "vi.fn", False),
)
# Names in decorators that concern tests.
TEST_DECORATORS = (
    "pytest.mark.parametrize", "pytest.mark.skip", "pytest.mark.skipif",
    "pytest.mark.xfail", "pytest.mark.timeout", "pytest.mark.asyncio",
    "pytest.fixture", "fixture", "mock", "patch", "unittest.mock.patch",
    "pytest.mark.usefixtures", "pytest.mark.filterwarnings",
)
#: How deep brackets within a decorator's arguments may lie.
DEPTH = 6


def balanced(depth: int) -> str:
    """A pattern of text in brackets with brackets inside, to that depth."""
    return rf"\((?:[^()]|{balanced(depth - 1)})*\)" if depth > 1 else r"\([^()]*\)"


ARGS = balanced(DEPTH)
MARK = rf"@([\w.]+)[ \t]*({ARGS})?"
#: A stack of decorators or annotations, each on lines of its own, and what it stands on.
STACK = rf"(?m)^((?:[ \t]*@[\w.]+[ \t]*(?:{ARGS})?[ \t]*\n)+)[ \t]*"
DECORATED = STACK + r"(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\("
ANNOTATED = STACK + r"(?:(?:public|protected|private|static|final|synchronized)[ \t]+)*[\w<>\[\].]+[ \t]+(\w+)[ \t]*\("
ANNOTATED_CLASS = STACK + r"(?:(?:public|abstract|final)[ \t]+)*class[ \t]+(\w+)"
FIXTURE = r"@(?:pytest\.)?fixture\s*(?:\(([^)]*)\))?\s*\n\s*((?:async\s+)?def)\s+(\w+)\s*\("
# Packages in which a tested class is looked for.
SUBPACKAGES = ("service", "controller", "request", "response", "model", "entity", "dto")


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def located(body: Column, rx: str | Column, *groups: int, end: bool = False) -> Column:
    """array of (line, g1, g2, ...): all matches of a pattern with the line (from 1) on which each starts, or ends.

    What lies between matches, and the matches themselves, give the lines before each by running sums.
    """
    rx = rx if isinstance(rx, Column) else F.lit(rx)
    whole = F.regexp_extract_all(body, rx, F.lit(0))
    between = F.transform(F.split(body, rx, -1), newlines)
    steps = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), F.transform(whole, newlines).alias("own"))
    start = F.struct(F.array().cast("array<int>").alias("lines"), F.lit(1).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        first, last = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["own"]
        return F.struct(F.concat(acc["lines"], F.array(last if end else first)).alias("lines"), last.alias("at"))

    lines = F.aggregate(steps, start, step)["lines"]
    return F.arrays_zip(lines.alias("line"), *[F.regexp_extract_all(body, rx, F.lit(g)).alias(f"g{i}") for i, g in enumerate(groups, 1)])


def _among(language: Column, table: dict[str, tuple[str, ...]], value: Column) -> Column:
    """Whether a value is in its language's list; TypeScript counts as JavaScript."""
    out = F.lit(False)
    for lang, some in table.items():
        out = F.when(_is(language, lang), value.isin(*some)).otherwise(out)
    return out


def _is(language: Column, name: str) -> Column:
    return language.isin("javascript", "typescript") if name == "javascript" else language == name


def tests(sources: DataFrame, patterns: Column | None = None) -> DataFrame:
    """file_id, test_no (from 0, in order of lines), test_name, line: the line on which a test's name stands.

    patterns: of each source its own (an array, one group each); those of its language, if none are given."""
    found = F.array().cast("array<struct<line:int,g1:string>>")
    if patterns is not None:
        own = F.transform(patterns, lambda p: located(F.col("body"), p, 1, end=True))
        return _in_order(sources, F.coalesce(F.flatten(own).cast("array<struct<line:int,g1:string>>"), found))
    for lang, some in E.TESTS.items():
        every = F.concat(*[located(F.col("body"), p, 1, end=True) for p in some])
        found = F.when(F.col("language") == lang, every).otherwise(found)
    return _in_order(sources, found)


def _in_order(sources: DataFrame, found: Column) -> DataFrame:
    rows = sources.select("file_id", F.posexplode(F.array_sort(F.array_distinct(found))).alias("test_no", "t"))
    return rows.select("file_id", "test_no", F.col("t.g1").alias("test_name"), "t.line")


def labels(sources: DataFrame) -> DataFrame:
    """file_id, class_name: the suite or class that a file's tests stand in (of several the last one that its beginning names)."""
    names = E.display_names(F.col("body"), F.col("language"))
    return sources.select("file_id", F.nullif(names["class_name"], F.lit("")).alias("class_name"))


def bindings(body: Column, language: Column) -> Column:
    """array of (alias, module): the names that a file's imports bind, and what they stand for."""
    pair = lambda alias, module: F.struct(alias.alias("alias"), module.alias("module"))

    def both(rx: str, alias: int, module: int) -> Column:
        xs, ys = (F.regexp_extract_all(body, F.lit(rx), F.lit(g)) for g in (alias, module))
        return F.zip_with(xs, ys, pair)

    def named(rx: str, names: int, module: int, between: str, joined: bool) -> Column:
        """Lists such as `a, b as c`: the name that is bound stands last."""
        def of(some: Column, m: Column) -> Column:
            parts = F.filter(F.transform(F.split(some, ","), lambda x: F.split(F.trim(F.regexp_replace(x, r"[()\s]+", " ")), between)), lambda p: F.element_at(p, 1) != "")
            return F.transform(parts, lambda p: pair(F.trim(F.element_at(p, -1)), F.concat(m, F.lit("."), F.trim(F.element_at(p, 1))) if joined else m))

        xs, ys = (F.regexp_extract_all(body, F.lit(rx), F.lit(g)) for g in (names, module))
        return F.flatten(F.zip_with(xs, ys, of))

    quoted = r"['\"]([^'\"]+)['\"]"
    python = F.concat(
        both(r"(?m)^[ \t]*import[ \t]+([\w.]+)[ \t]+as[ \t]+(\w+)", 2, 1), both(r"(?m)^[ \t]*import[ \t]+((\w+)[\w.]*)[ \t]*$", 2, 2),
        named(r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+([^\n]+)$", 2, 1, " as ", True),
    )
    script = F.concat(
        both(rf"import\s+(\w+)\s*(?:,\s*\{{[^}}]*\}}\s*)?from\s*{quoted}", 1, 2), both(rf"import\s*\*\s*as\s+(\w+)\s+from\s*{quoted}", 1, 2),
        named(rf"import\s*(?:\w+\s*,\s*)?\{{([^}}]*)\}}\s*from\s*{quoted}", 1, 2, " as ", False),
        both(rf"(?:const|let|var)\s+(\w+)\s*=\s*require\s*\(\s*{quoted}", 1, 2), named(rf"(?:const|let|var)\s*\{{([^}}]*)\}}\s*=\s*require\s*\(\s*{quoted}", 1, 2, ":", False),
    )
    java = both(r"(?m)^import[ \t]+(?:static[ \t]+)?([\w.]+\.(\w+))[ \t]*;", 2, 1)
    none = F.array().cast("array<struct<alias:string,module:string>>")
    return F.when(language == "python", python).when(_is(language, "javascript"), script).when(language == "java", java).otherwise(none)


def calls(sources: DataFrame) -> DataFrame:
    """file_id, line, call_no (order within a file and kind), object_name, module_name, function_name, call_type, source.

    module_name is what the object is bound to by an import of the same file, else the object itself; a patched name is
    its module and its last part. Calls of test frameworks and of common names are left out.
    """
    body, lang, low = F.col("body"), F.col("language"), F.lower
    kinds = "array<struct<line:int,object_name:string,function_name:string,call_type:string,source:string>>"
    kind = lambda line, obj, fn, t, s: F.struct(line.alias("line"), obj.alias("object_name"), fn.alias("function_name"), F.lit(t).alias("call_type"), F.lit(s).alias("source"))
    method = F.filter(located(body, METHOD_CALL, 1, 2), lambda x: ~_among(lang, SKIPPED_OBJECTS, low(x["g1"])))
    direct = F.filter(located(body, LINE_CALL, 1), lambda x: (lang == "python") & ~low(x["g1"]).isin(*SKIPPED_FUNCTIONS))
    patched = F.filter(located(body, PATCH, 1), lambda x: (lang == "python") & F.contains(x["g1"], F.lit(".")))
    last = lambda c: F.substring_index(c, ".", -1)
    every = F.concat(
        F.transform(method, lambda x: kind(x["line"], x["g1"], x["g2"], "method", "method_call")).cast(kinds),
        F.transform(direct, lambda x: kind(x["line"], F.lit(""), x["g1"], "direct", "method_call")).cast(kinds),
        F.transform(patched, lambda x: kind(x["line"], F.left(x["g1"], F.length(x["g1"]) - F.length(last(x["g1"])) - 1), last(x["g1"]), "patch_ref", "patch_ref")).cast(kinds),
    )
    rows = sources.select("file_id", bindings(body, lang).alias("bound"), F.posexplode(every).alias("call_no", "c")).select("file_id", "bound", "call_no", "c.*")
    module = F.array_min(F.transform(F.filter("bound", lambda b: b["alias"] == F.col("object_name")), lambda b: b["module"]))
    module = F.when(F.col("source") == "patch_ref", F.col("object_name")).otherwise(F.coalesce(module, F.col("object_name")))
    return rows.select("file_id", "line", "call_no", "object_name", module.alias("module_name"), "function_name", "call_type", "source")


def owners(found: DataFrame, known: DataFrame) -> DataFrame:
    """found with test_no, test_name: the last test of the file that stands on a call's line or above it (of several on one
    line the last), else the file's first. Calls of files without tests are left out.

    found: file_id, line, ...; known: file_id, test_no, test_name, line. One sort of both by file and line.
    """
    mine = [c for c in found.columns if c not in ("file_id", "line")]
    test = F.struct("line", "test_no", "test_name")
    both = known.select("file_id", "line", F.lit(0).alias("__call"), test.alias("__test"), *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in mine])
    both = both.unionByName(found.select("file_id", "line", F.lit(1).alias("__call"), F.lit(None).cast(both.schema["__test"].dataType).alias("__test"), *mine))
    upto = Window.partitionBy("file_id").orderBy("line", "__call", "__test.test_no").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("file_id").orderBy("line", "__call", "__test.test_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    owner = F.coalesce(F.last("__test", ignorenulls=True).over(upto), F.first("__test", ignorenulls=True).over(every))
    rows = both.withColumn("__owner", owner).where("__call = 1 AND __owner IS NOT NULL")
    return rows.select("file_id", "line", *mine, F.col("__owner.test_no").alias("test_no"), F.col("__owner.test_name").alias("test_name"))


def call_owners(sources: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row for each test and object (and function, for direct and patched ones): the first such call.

    file_id, test_no, test_name, object_name, module_name, function_name, call_type, source, line. known: the tests, as
    tests() gives them.
    """
    rows = owners(calls(sources), tests(sources) if known is None else known)
    alone = F.when(F.col("call_type") != "method", F.col("function_name"))
    first = F.min(F.struct("line", "call_no", "module_name", "function_name", "test_name")).alias("f")
    out = rows.groupBy("file_id", "test_no", "object_name", "call_type", "source", alone.alias("__alone")).agg(first)
    return out.select("file_id", "test_no", "f.test_name", "object_name", "f.module_name", "f.function_name", "call_type", "source", "f.line")


def fixtures(sources: DataFrame) -> DataFrame:
    """file_id, fixture_name, fixture_scope, fixture_type, line: fixtures belong to all tests of their file."""
    rows = sources.where("language = 'python'").select("file_id", F.explode(located(F.col("body"), FIXTURE, 1, 2, 3)).alias("m"))
    scope = F.regexp_extract("m.g1", r"scope\s*=\s*[\"'](\w+)[\"']", 1)
    return rows.select("file_id", F.col("m.g3").alias("fixture_name"), F.when(scope == "", "function").otherwise(scope).alias("fixture_scope"), F.when(F.col("m.g2").startswith("async"), "async").otherwise("sync").alias("fixture_type"), "m.line")


def _marks(rows: DataFrame, stack: str, *keep: str) -> DataFrame:
    """keep, mark_no (from the top), name, args (without the outer brackets; null if there are none)."""
    names, args = (F.regexp_extract_all(stack, F.lit(MARK), F.lit(g)) for g in (1, 2))
    rows = rows.select(*keep, F.posexplode(F.arrays_zip(names.alias("n"), args.alias("a"))).alias("mark_no", "x"))
    return rows.select(*keep, "mark_no", F.col("x.n").alias("name"), F.when(F.col("x.a") != "", F.col("x.a").substr(F.lit(2), F.length("x.a") - 2)).alias("args"))


def decorators(sources: DataFrame) -> DataFrame:
    """file_id, function_name, mark_no, decorator_name, args, decorator_args (map of key=value): the whole stack above a
    Python function, of decorators that concern tests."""
    found = sources.where("language = 'python'").select("file_id", F.explode(located(F.col("body"), DECORATED, 1, 2, end=True)).alias("m"))
    rows = _marks(found.select("file_id", F.col("m.g2").alias("function_name"), F.col("m.line").alias("line"), F.col("m.g1").alias("stack")), "stack", "file_id", "function_name", "line")
    concerns = F.col("name").startswith("pytest.")
    for d in TEST_DECORATORS:
        concerns = concerns | F.contains("name", F.lit(d))
    given = F.filter(F.split(F.coalesce("args", F.lit("")), ","), lambda p: F.contains(p, F.lit("=")))
    key = lambda p: F.trim(F.substring_index(p, "=", 1))
    value = lambda p: F.regexp_replace(F.trim(F.substr(p, F.instr(p, "=") + 1)), "^[\"']+|[\"']+$", "")
    pairs = F.transform(given, lambda p: F.struct(key(p), value(p)))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["col1"] == p["col1"]))  # of one key the last counts
    return rows.where(concerns).select("file_id", "function_name", "line", "mark_no", F.col("name").alias("decorator_name"), "args", F.map_from_entries(last).alias("decorator_args"))


def annotations(sources: DataFrame) -> DataFrame:
    """file_id, target_type (class or method), target_name, mark_no, annotation_name, args: the stacks above Java classes and methods."""
    java = sources.where("language = 'java'")
    of = lambda rx, kind: java.select("file_id", F.lit(kind).alias("target_type"), F.explode(located(F.col("body"), rx, 1, 2)).alias("m")).select("file_id", "target_type", F.col("m.g2").alias("target_name"), F.col("m.g1").alias("stack"))
    rows = _marks(of(ANNOTATED, "method").unionByName(of(ANNOTATED_CLASS, "class")), "stack", "file_id", "target_type", "target_name")
    return rows.withColumnRenamed("name", "annotation_name")


def reflection(sources: DataFrame) -> DataFrame:
    """file_id, reflection_method, target_kind, target, line of Java sources."""
    kinds = "array<struct<line:int,name:string,kind:string,target:string>>"
    one = lambda rx, name, kind: F.transform(located(F.col("body"), rx, *((1,) if kind else ())), lambda x: F.struct(x["line"], F.lit(name), F.lit(kind), x["g1"] if kind else F.lit(None))).cast(kinds)
    rows = sources.where("language = 'java'").select("file_id", F.explode(F.concat(*[one(*r) for r in REFLECTION])).alias("x"))
    return rows.select("file_id", F.col("x.name").alias("reflection_method"), F.col("x.kind").alias("target_kind"), "x.target", "x.line")


def injected_fields(sources: DataFrame) -> DataFrame:
    """file_id, annotation_name, field_type, field_name, line of Java sources."""
    rows = sources.where("language = 'java'").select("file_id", F.explode(located(F.col("body"), FIELD, 1, 2, 3)).alias("m"))
    return rows.select("file_id", F.col("m.g1").alias("annotation_name"), F.trim("m.g2").alias("field_type"), F.col("m.g3").alias("field_name"), "m.line")


def mocks(sources: DataFrame) -> DataFrame:
    """file_id, mock_type, mock_target (null where none is named), line of scripts."""
    kinds = "array<struct<line:int,name:string,target:string>>"
    bare = lambda c: F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")
    one = lambda rx, name, target: F.transform(located(F.col("body"), rx, *((1,) if target else ())), lambda x: F.struct(x["line"], F.lit(name), bare(x["g1"]) if target else F.lit(None))).cast(kinds)
    rows = sources.where(_is(F.col("language"), "javascript")).select("file_id", F.explode(F.concat(*[one(*m) for m in MOCKS])).alias("x"))
    return rows.select("file_id", F.col("x.name").alias("mock_type"), F.col("x.target").alias("mock_target"), "x.line")


def metadata(sources: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """file_id, test_no, test_name, line, description (docstring), markers (of the file, in order), is_async, async_pattern, pattern.

    Python functions alone have docstrings and markers; an async test's pattern is told by what its file holds.
    """
    body, name, lang = F.col("body"), F.col("test_name"), F.col("language")
    rows = (tests(sources) if known is None else known).join(sources.select("file_id", "language", "body"), "file_id")
    quoted = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    # names that are made of word characters stand for themselves in a pattern
    plain = F.regexp_replace(name, r"\W", ".")
    doc = F.regexp_extract_all(body, quoted(r"(?s)def\s+", plain, r"[^:]*:\s*[\"']{3}(.*?)[\"']{3}"), F.lit(1))
    marks = F.when(lang == "python", F.regexp_extract_all(body, F.lit(r"@pytest\.mark\.(\w+)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    script = body.rlike(r"async\s+\([^)]*\)\s*=>") | F.regexp_like(body, quoted(r"async\s+(?:function\s+)?", plain, r"\b"))
    is_async = F.when(lang == "python", F.regexp_like(body, quoted(r"async\s+def\s+", plain, r"\s*\("))).when(_is(lang, "javascript"), script).otherwise(False)
    has = lambda *words: F.greatest(*[F.contains(body, F.lit(w)) for w in words], F.lit(False))
    python = F.when(has("@pytest.mark.asyncio"), "pytest-asyncio").when(has("asyncio.run", "await"), "asyncio").otherwise("pytest-asyncio")
    kind = F.when(lang == "python", python).otherwise(F.when(has("done()", "done =>"), "callback").when(has("Promise"), "promise").otherwise("async/await"))
    told = F.when(lang == "python", F.trim(F.coalesce(F.try_element_at(doc, F.lit(1)), F.lit("")))).otherwise("")
    out = rows.withColumn("is_async", is_async)
    return out.select("file_id", "test_no", "test_name", "line", told.alias("description"), marks.alias("markers"), "is_async", F.when(F.col("is_async"), kind).alias("async_pattern"), F.when(name.startswith("test_"), "test_prefix").otherwise("annotation_based").alias("pattern"))


def inferred(sources: DataFrame) -> DataFrame:
    """file_id, candidate_no, candidate: what a Java test without any production import may stand for, the likeliest first.

    Sources have a column path, too. From the package without `.test`; from the class without Test or Tests, alone and in
    the packages beside its own; and from the file's name, where a folder named for tests stands above another part.
    """
    java = sources.where("language = 'java'")
    imports = E.references(java).where("reference_type = 'direct_import'").select("file_id").distinct()
    rows = java.join(imports, "file_id", "left_anti")
    first = lambda rx: F.regexp_extract("body", rx, 1)
    bare = lambda c: F.regexp_extract(c, r"^(.+?)(?:Test|Tests)$", 1)
    rows = rows.select("file_id", "path", first(r"(?m)^package\s+([\w.]+)\s*;").alias("package"), bare(first(r"(?:public\s+)?class\s+(\w+)")).alias("own"))
    package = F.when(F.contains("package", F.lit(".test")), F.replace("package", F.lit(".test"), F.lit("")))
    base = F.when(F.contains(package, F.lit(".")), F.regexp_replace(package, r"\.[^.]*$", "")).otherwise(package)
    own = F.when(F.col("own") != "", F.col("own"))
    parts = F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/")
    below = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.contains(F.lower(p), F.lit("test")))
    named = F.when(below, F.nullif(bare(F.regexp_extract(F.element_at(parts, -1), r"^(.*?)(?:\.[^.]*)?$", 1)), F.lit("")))
    within = lambda names, c: [F.concat(base, F.lit(f".{s}."), c) for s in names]
    every = F.array_distinct(F.array_compact(F.array(package, own, *within(SUBPACKAGES, own), F.concat(base, F.lit("."), own), *within(SUBPACKAGES[:5], named))))
    kept = F.filter(every, lambda c: (~F.contains(F.lower(c), F.lit("test")) | c.endswith("Test")) & (E.is_production(c, F.lit("java")) | ~F.lower(c).rlike("test|junit|mockito")))
    return rows.select("file_id", F.posexplode(kept).alias("candidate_no", "candidate"))


def inferred_classes(sources: DataFrame, declared: DataFrame) -> DataFrame:
    """file_id, production_class, candidate, reference_type: of each file's candidates the likeliest that is declared.

    declared: production_class. A candidate without a package fits the classes of that name, the first by name.
    """
    known = declared.select("production_class").distinct()
    names = known.select("production_class", F.explode(F.array_distinct(F.array("production_class", F.substring_index("production_class", ".", -1)))).alias("candidate"))
    best = names.groupBy("candidate").agg(F.min("production_class").alias("production_class"))
    hit = inferred(sources).join(best, "candidate").groupBy("file_id").agg(F.min(F.struct("candidate_no", "candidate", "production_class")).alias("b"))
    return hit.select("file_id", "b.production_class", "b.candidate", F.lit("inferred").alias("reference_type"))
