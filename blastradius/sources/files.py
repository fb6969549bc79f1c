"""File sources and sinks: whole texts, JSON documents in an envelope, archives."""

from __future__ import annotations

import hashlib
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that no scan enters.
EXCLUDED = ("node_modules", ".git", "__pycache__", "venv", "build", "dist", "target")


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file_path, content, n_bytes of the files below a folder, without the excluded folders."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.where(~F.col("path").rlike("/(" + "|".join(e.replace(".", r"\.") for e in EXCLUDED) + ")/")).select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("n_bytes"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """file_id (from the path), file_path, content, line_count."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))
    return df.select(F.left(F.sha2("file_path", 256), F.lit(16)).alias("file_id"), "file_path", "content", F.size(F.split("content", "\n", -1)).alias("line_count"))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows in the data array of {generated_at, data: [...]} files."""
    return spark.read.schema(f"generated_at string, data array<struct<{schema}>>").json(path, multiLine=True).select("generated_at", F.explode("data").alias("row")).select("generated_at", "row.*")


def write_documents(df: DataFrame, path: str, generated_at: str, rows: int = 1000) -> None:
    """Rows in envelopes {generated_at, data: [...]} of at most so many rows, one to a line, a file for each partition."""
    block = F.expr(f"cast(monotonically_increasing_id() div {rows} as bigint)")  # never across partitions
    numbered = df.withColumn("__block", block)
    packed = numbered.groupBy("__block").agg(F.collect_list(F.struct(*df.columns)).alias("data"))
    packed.select(F.lit(generated_at).alias("generated_at"), "data").write.mode("errorifexists").json(path)


# The documents that an analyser leaves, and where their rows are.
DOCUMENTS = {
    "files": ("01_test_files.json", "files"),
    "frameworks": ("02_framework_detection.json", "frameworks"),
    "tests": ("03_test_registry.json", "tests"),
    "dependencies": ("04_static_dependencies.json", "test_dependencies"),
    "calls": ("04b_function_calls.json", "test_function_mappings"),
    "metadata": ("05_test_metadata.json", "test_metadata"),
    "index": ("06_reverse_index.json", "reverse_index"),
    "structure": ("07_test_structure.json", "structure"),
}


def merge_analyzers(spark: SparkSession, folders: list[str], kind: str, schema: str) -> DataFrame:
    """analyzer (its folder), and the rows of one kind of document of all analysers; one that lacks it gives none."""
    name, key = DOCUMENTS[kind]
    found = [f for f in folders if _exists(spark, f"{f}/{name}")]
    wanted = f"generated_at string, data struct<{key}: array<struct<{schema}>>>"
    if not found:
        return spark.createDataFrame([], f"analyzer string, {schema}")
    rows = spark.read.schema(wanted).json([f"{f}/{name}" for f in found], multiLine=True)
    folder = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{name.replace('.', '[.]')}(?:/[^/]+)?$", 1)
    return rows.select(folder.alias("analyzer"), F.explode(f"data.{key}").alias("row")).select("analyzer", "row.*")


def write_analysis(rows: DataFrame, folder: str, kind: str, generated_at: str, most: int = 1000) -> None:
    """One kind of document of an analyser, as merge_analyzers() reads it: envelopes of at most so many rows, a file each."""
    name, key = DOCUMENTS[kind]
    numbered = rows.withColumn("__block", F.expr(f"cast(monotonically_increasing_id() div {most} as bigint)"))  # never across partitions
    packed = numbered.groupBy("__block").agg(F.collect_list(F.struct(*rows.columns)).alias("r"))
    packed.select(F.lit(generated_at).alias("generated_at"), F.struct(F.col("r").alias(key)).alias("data")).write.option("maxRecordsPerFile", 1).json(f"{folder}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def namespace_of(digest: str) -> str:
    """The namespace of an archive's tables, by its SHA-256."""
    return f"test_repo_{digest[:8]}"


def namespaces(one: str | None, many: list[str] | None, default: str) -> list[str]:
    """A list of namespaces, else a single one, else the default; blanks count for nothing."""
    given = [n.strip() for n in many or [] if n and n.strip()]
    return given or ([one.strip()] if one and one.strip() else [default])


def diff_text(spark: SparkSession, path: str) -> str:
    """The one diff in a file or folder of files, in order of their names."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value").orderBy("p").collect()  # a stated diff
    return "\n".join(r["value"].rstrip("\n") for r in rows)


def ingest_archive(path: str, into: str) -> str:
    """Unpacks a zip below `into` under its content's SHA-256 and returns that id; a known id is left as it is."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    home = os.path.join(into, digest.hexdigest())
    if not os.path.isdir(home):
        with zipfile.ZipFile(path) as z:
            root = os.path.realpath(home)
            if any(not os.path.realpath(os.path.join(home, n)).startswith(root + os.sep) for n in z.namelist()):
                raise ValueError("the archive names files outside its folder")
            z.extractall(home)
    return digest.hexdigest()


def valid_namespace(name: str) -> bool:
    return name.isascii() and 0 < len(name) <= 63 and name.replace("_", "a").isalnum()


def table_columns(spark: SparkSession, name: str) -> list[str]:
    """Columns of a catalogue table; empty where there is none."""
    return [c.name for c in spark.catalog.listColumns(name)] if spark.catalog.tableExists(name) else []
