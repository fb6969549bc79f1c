"""What the training-data operators share: word rules, scratch tables, batches."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 8 << 20
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='blastradius-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Of each thread the scratch() calls that are open, the innermost last: the tables that stash() wrote within them.
_scopes = threading.local()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, survives lost executors.

    The table stays as long as a result may be read from it: until the end of the scratch() around it, if there is one.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for innermost in getattr(_scopes, "open", [])[-1:]:
        innermost.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], tuple[DataFrame, str]]]:
    """Deletes at its end what was stashed within it, but for what is kept: keep(df, name) -> the stashed table, its path."""
    mine: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), mine]

    def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        out = stash(df, name)
        return out, mine.pop()

    try:
        yield keep
    finally:
        _scopes.open = _scopes.open[:-1]
        delete_tables(spark, mine)


def whole_text(text: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, A_Z, a_z)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def valid(text: bytes) -> bytes:
    """Bytes that are not UTF-8 become replacement characters."""
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches end after BATCH_BYTES as well as after so many rows, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def batches(it: Iterator[pa.RecordBatch], most: int = 4 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the bytes of one column stay near `most` (a single row may exceed it)."""
    import numpy as np
    import pyarrow.compute as pc

    for b in it:
        if not b.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0)).astype(np.int64)
        group = (np.cumsum(size) - size) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield b.slice(lo, hi - lo)
