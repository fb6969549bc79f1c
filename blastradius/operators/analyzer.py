"""An analyser of test repositories: from files to the eight relations that an index is loaded from, by configuration.

A configuration is rows (language, kind, value): extensions, patterns of test files' names, declarations of tests, imports.
It is read from JSON and compiled into one plan for all languages: maps from a language to its patterns, looked
up for each file, so that a language that is added adds rows and no branches. What a configuration doesn't say of a language comes
from the built-in tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analysis as A
from . import extract as E

#: What a configuration may say of a language, each a list.
KINDS = ("extensions", "test_patterns", "tests", "imports")
CONFIG = "languages map<string, struct<" + ", ".join(f"{k}: array<string>" for k in KINDS) + ">>"
#: Fixed value: languages with a smaller share of the files aren't active.
LEAST_SHARE = 0.05


@dataclass(frozen=True)
class Config:
    """language -> kind -> values."""

    languages: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=dict)

    def of(self, language: str) -> dict[str, tuple[str, ...]] | None:
        return self.languages.get(language)

    def values(self, language: str, kind: str) -> tuple[str, ...]:
        return (self.of(language) or {}).get(kind, ())

    def rows(self, spark: SparkSession) -> DataFrame:
        """language, kind, place, value."""
        every = [(lang, kind, i, v) for lang, kinds in self.languages.items() for kind, some in kinds.items() for i, v in enumerate(some)]
        return spark.createDataFrame(every, "language string, kind string, place int, value string")

    def lists(self, kind: str) -> Column:
        """map from each language to its list of a kind."""
        known = {lang: kinds[kind] for lang, kinds in self.languages.items() if kinds.get(kind)}
        pairs = [x for lang, some in known.items() for x in (F.lit(lang), F.array(*map(F.lit, some)))]
        return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")


def built_in() -> Config:
    """The tables of extract: all languages with patterns of tests."""
    ext = lambda lang: tuple(e for e, n in E.LANGUAGES.items() if n == lang)
    names = lambda lang: tuple(p for e in ext(lang) for p in E.TEST_FILES.get(e, ()))
    return Config({lang: {"extensions": ext(lang), "test_patterns": names(lang), "tests": some, "imports": E.IMPORTS.get(lang, ())} for lang, some in E.TESTS.items()})


def load_config(spark: SparkSession, path: str) -> Config:
    """{"languages": {name: {kind: [...]}}} over the built-in tables: a kind that it states takes the place of theirs.

    Patterns of file names may be globs (`*Test.java`). A file without languages, or that is no JSON, is an error.
    """
    rows = spark.read.schema(f"{CONFIG}, _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE").collect()  # a stated file
    if len(rows) != 1 or rows[0]["languages"] is None:
        raise ValueError(f"{path}: an object with languages is needed")
    known = {lang: dict(kinds) for lang, kinds in built_in().languages.items()}
    for lang, said in rows[0]["languages"].items():
        given = {k: tuple(said[k]) for k in KINDS if said[k]}
        if "test_patterns" in given:
            given["test_patterns"] = tuple(glob(p) for p in given["test_patterns"])
        known[lang] = {**known.get(lang, {}), **given}
    return Config(known)


def glob(pattern: str) -> str:
    """A glob as an expression for a whole name; expressions stay as they are."""
    if pattern.endswith("$"):
        return pattern
    plain = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in r".+()[]{}^$|\\" else c for c in pattern)
    return f"{plain}$"


def scan(files: DataFrame, config: Config) -> DataFrame:
    """files(file_path, content) -> file_id, file_path, language, is_test, category, line_count, size_bytes, content.

    Excluded folders are left out, and files of languages that the configuration doesn't know.
    """
    extensions = {e: lang for lang in config.languages for e in config.values(lang, "extensions")}
    language = F.try_element_at(F.create_map(*[F.lit(x) for kv in extensions.items() for x in kv]), E.extension(F.col("file_path")))
    name = F.element_at(F.split("file_path", r"[/\\]"), -1)
    fits = F.exists(F.element_at(config.lists("test_patterns"), F.col("language")), lambda p: F.regexp_like(name, F.concat(F.lit("(?i)^(?:"), p, F.lit(")"))))
    rows = files.where(E.should_scan(F.col("file_path"))).withColumn("language", language).where("language IS NOT NULL")
    text = F.coalesce("content", F.lit(""))
    return rows.select(
        F.left(F.sha2("file_path", 256), F.lit(16)).alias("file_id"), "file_path", "language", F.coalesce(fits, F.lit(False)).alias("is_test"), E.category(F.col("file_path")).alias("category"),
        (A.newlines(text) + 1).alias("line_count"), F.octet_length(text).alias("size_bytes"), text.alias("content"),
    )


def active_languages(scanned: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """language, n_files, n_tests, share: languages with at least that share of the files."""
    per = scanned.groupBy("language").agg(F.count("*").alias("n_files"), F.count_if("is_test").alias("n_tests"))
    total = per.agg(F.sum("n_files").alias("__all"))
    return per.crossJoin(total).withColumn("share", F.round(F.col("n_files") / F.col("__all"), 4)).where(F.col("n_files") >= least * F.col("__all")).drop("__all")  # one row


def detection_report(scanned: DataFrame) -> DataFrame:
    """language, n_files, n_tests, share, frameworks: the active languages, each with its frameworks (name, votes,
    confidence), the surest first; an empty list where none is told."""
    sources = scanned.where("is_test").select("file_id", "language", F.col("content").alias("body"))
    key = F.struct((-F.col("votes")).alias("v"), "framework", "confidence")
    found = E.frameworks(sources).groupBy("language").agg(F.array_sort(F.collect_list(key)).alias("f"))  # a few for each language
    listed = F.transform("f", lambda x: F.struct(x["framework"].alias("framework"), (-x["v"]).alias("votes"), x["confidence"].alias("confidence")))
    rows = active_languages(scanned).join(found.select("language", listed.alias("frameworks")), "language", "left")
    return rows.withColumn("frameworks", F.coalesce("frameworks", F.array().cast("array<struct<framework:string,votes:bigint,confidence:string>>")))


def analyze(files: DataFrame, config: Config | None = None) -> dict[str, DataFrame]:
    """files(file_path, content) -> the relations of DOCUMENTS: files, frameworks, tests, dependencies, calls, metadata,
    index, structure. Everything is lazy; tests get ids of their file and place, the same in every run."""
    config = config or built_in()
    scanned = scan(files, config).where("is_test")
    sources = scanned.select("file_id", "file_path", "language", F.col("content").alias("body"))
    known = A.tests(sources, F.element_at(config.lists("tests"), F.col("language")))
    test_id = F.concat(F.lit("test_"), "file_id", F.lit("_"), F.lpad(F.col("test_no").cast("string"), 4, "0")).alias("test_id")
    places = scanned.select("file_id", "file_path", "language", "category")
    label = A.labels(sources)
    tests = known.join(places, "file_id").join(label, ["file_id"], "left").select(
        test_id, "file_path", F.coalesce("class_name", F.lit("")).alias("class_name"), F.col("test_name").alias("method_name"), E.test_type(F.col("file_path"), F.col("language")).alias("test_type"), F.col("line").alias("line_number"), "language",
    )
    ids = known.select("file_id", "test_no", test_id)
    named = E.references(sources, F.element_at(config.lists("imports"), F.col("language"))).join(ids.select("file_id", "test_id"), "file_id")
    dependencies = named.select("test_id", F.coalesce("class_name", "module").alias("referenced_class"), "module", F.col("reference_type").alias("import_type")).distinct()
    calls = A.call_owners(sources, known).join(ids, ["file_id", "test_no"]).select("test_id", "module_name", "function_name", "object_name", "call_type", "source", F.col("line").alias("line_number"))
    told = A.metadata(sources, known).join(ids, ["file_id", "test_no"]).select("test_id", "description", "markers", "is_async", "async_pattern", "pattern", F.col("line").alias("line_number"))
    paths = tests.select("test_id", F.col("file_path").alias("test_file_path"))
    linked = dependencies.select("test_id", F.col("referenced_class").alias("production_class"), F.col("import_type").alias("reference_type"))
    linked = linked.unionByName(calls.where("module_name <> ''").select("test_id", F.col("module_name").alias("production_class"), F.col("source").alias("reference_type"))).distinct()
    structure = scanned.groupBy("category").agg(F.count("*").alias("file_count"), F.sum("line_count").alias("total_lines"))
    counts = tests.join(places.select("file_path", "category"), "file_path").groupBy("category").agg(F.count("*").alias("test_count"))
    structure = structure.join(counts, "category", "left").select("category", "file_count", F.coalesce("test_count", F.lit(0)).alias("test_count"), "total_lines")
    return {
        "files": scanned.select("file_id", "file_path", "language", "category", "line_count", "size_bytes"),
        "frameworks": E.frameworks(sources), "tests": tests, "dependencies": dependencies, "calls": calls, "metadata": told,
        "index": linked.join(paths, "test_id").select("production_class", "test_id", "test_file_path", "reference_type"), "structure": structure,
    }


def run(files: DataFrame, folder: str, generated_at: str, config: Config | None = None, write: Callable | None = None) -> dict[str, str]:
    """Analyses, and writes the eight documents below a folder; kind -> schema of its rows."""
    from ..sources.files import write_analysis

    out = {}
    for kind, rows in analyze(files, config).items():
        (write or write_analysis)(rows, folder, kind, generated_at)
        out[kind] = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in rows.schema)
    return out
