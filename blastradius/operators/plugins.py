"""Where other languages, vector stores and language models are plugged in: small protocols, registries, one default each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract, vector


@dataclass(frozen=True)
class Language:
    """How tests and imports of a language are found: extensions, patterns with one group each, and what a scan adds.

    parse turns sources(file_id, language, body) into further rows; scan patterns are enough for most languages.
    """

    name: str
    extensions: tuple[str, ...]
    tests: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    not_production: str = r"(?!)"
    parse: Callable[[DataFrame], DataFrame] | None = None


class VectorStore(Protocol):
    def upsert(self, vectors: DataFrame) -> None: ...

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...

    def delete_repository(self, repo: str) -> None: ...


class Model(Protocol):
    """A language model: answers and vectors for batches of texts."""

    def chat(self, prompts: DataFrame) -> DataFrame: ...

    def embed(self, texts: DataFrame) -> DataFrame: ...


@dataclass
class Registry:
    """Named plugins; a name that is taken is an error unless it is to be replaced."""

    kind: str
    known: dict[str, object] = field(default_factory=dict)

    def add(self, name: str, plugin: object, replace: bool = False) -> None:
        if name in self.known and not replace:
            raise ValueError(f"{self.kind} {name} is known already")
        self.known[name] = plugin

    def get(self, name: str) -> object:
        if name not in self.known:
            raise KeyError(f"no {self.kind} {name}; known: {', '.join(sorted(self.known))}")
        return self.known[name]


class ParquetVectors:
    """Vectors in a Parquet folder by repository: id, repo, label, embedding."""

    def __init__(self, spark, path: str, dims: int):
        self.spark, self.path, self.dims = spark, path, dims

    def upsert(self, vectors: DataFrame) -> None:
        """Rows of a repository take the place of what it had. Another dimension is an error, and nothing is written."""
        checked = F.when(F.size("embedding") == self.dims, F.col("embedding")).otherwise(F.raise_error(F.lit("embedding of another dimension")))
        rows = vectors.withColumn("embedding", checked)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """queries(query_id, weight, q) -> the k best of each."""
        return vector.top_k(vector.similarities(self.rows().withColumnRenamed("id", "vec_id"), queries), k)

    def delete_repository(self, repo: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/repo={repo}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


class HashingModel:
    """The offline default: hashed words for vectors, and no answers."""

    def __init__(self, dims: int = 32):
        self.dims = dims

    def chat(self, prompts: DataFrame) -> DataFrame:
        return prompts.select("prompt_id", F.lit(None).cast("string").alias("answer"))

    def embed(self, texts: DataFrame) -> DataFrame:
        from .report import hashing_vectors

        return hashing_vectors(texts, self.dims)


LANGUAGES, STORES, MODELS = Registry("language"), Registry("vector store"), Registry("model")
for _name in extract.TESTS:
    LANGUAGES.add(_name, Language(_name, tuple(e for e, n in extract.LANGUAGES.items() if n == _name), extract.TESTS[_name], extract.IMPORTS.get(_name, ())))
STORES.add("parquet", ParquetVectors)
MODELS.add("hashing", HashingModel)


def language_of(path: Column) -> Column:
    """The registered language of a path's extension; null where there is none."""
    pairs = {e: p.name for p in LANGUAGES.known.values() for e in p.extensions}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), extract.extension(path))


def scan(sources: DataFrame) -> DataFrame:
    """file_id, language, test_name by the patterns of all registered languages."""
    table = {p.name: p.tests for p in LANGUAGES.known.values() if p.tests}
    return sources.select("file_id", "language", F.explode(extract.by_language(table, F.col("body"), F.col("language"))).alias("test_name"))


def imports(sources: DataFrame) -> DataFrame:
    """file_id, language, module, production."""
    table = {p.name: p.imports for p in LANGUAGES.known.values() if p.imports}
    rows = sources.select("file_id", "language", F.explode(extract.by_language(table, F.col("body"), F.col("language"))).alias("module"))
    other = F.lit(False)
    for p in LANGUAGES.known.values():
        other = other | ((F.col("language") == p.name) & F.col("module").rlike(p.not_production))
    return rows.withColumn("production", ~other)


def references(sources: DataFrame) -> DataFrame:
    """file_id, module, class_name, reference_type: imports of all registered languages, and what strings refer to."""
    pairs = [x for p in LANGUAGES.known.values() if p.imports for x in (F.lit(p.name), F.array(*map(F.lit, p.imports)))]
    rows = extract.references(sources, F.element_at(F.create_map(*pairs), F.col("language")))
    other = F.lit(False)
    for p in LANGUAGES.known.values():
        other = other | ((F.col("language") == p.name) & F.col("module").rlike(p.not_production))
    kinds = sources.select("file_id", "language")
    return rows.join(kinds, "file_id").where(~other).drop("language")
