"""Stored relations whose changes become visible together or not at all.

Data folders are written once and never changed. A manifest names the folders of every relation, and the one with the
highest number is the state of the store: a change of several relations writes its folders first and then one manifest. A job
that dies before leaves folders that no manifest names. A relation may be kept in buckets of its key, so that an
upsert rewrites those that it touches only. A batch that carries its source and number is applied once.

    path/data/<relation>-<id>/...      path/manifests/<number>.json

One writer at a time: a manifest that is there already is an error, and is not replaced.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mutation import latest

BUCKET = "__bucket"


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        where, fs = self._at("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        """The state of the store: number, relations (name -> schema, key, buckets, parts), batches (source -> last number)."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "relations": {}, "batches": {}}
        where, fs = self._at(f"manifests/{numbers[-1] if number is None else number:010d}.json")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        """The commit: a file of another name is moved to its place."""
        draft, fs = self._at(f"manifests/.{uuid.uuid4().hex}.draft")
        final, _ = self._at(f"manifests/{state['number']:010d}.json")
        fs.mkdirs(draft.getParent())
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {state['number']} was written by another one")

    def read(self, name: str, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A relation as it stands, or stood in an earlier version; only some of its buckets, if they are given."""
        relation = self.manifest(number)["relations"][name]
        return self._rows(relation, buckets)

    def _rows(self, relation: dict, buckets: list[int] | None = None) -> DataFrame:
        parts = [p["path"] for p in relation["parts"] if buckets is None or p["bucket"] in buckets]
        reader = self.spark.read.schema(relation["schema"])
        return reader.parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], relation["schema"])

    def _write(self, name: str, rows: DataFrame, key: str | None, buckets: int) -> list[dict]:
        """Writes rows into a folder of their own, and says what it holds: one part, or one for each bucket."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        if key is None:
            rows.write.parquet(f"{self.path}/{folder}")
            return [{"bucket": None, "path": folder}]
        rows = rows.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        rows.repartition(buckets, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        where, fs = self._at(folder)
        found = [s.getPath().getName() for s in fs.listStatus(where)]
        return [{"bucket": int(n.split("=")[1]), "path": f"{folder}/{n}"} for n in sorted(found) if n.startswith(f"{BUCKET}=")]

    def commit(self, changes: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> bool:
        """Each relation becomes the given rows (which may come from its earlier version), all of them in one version.

        False, and nothing is written, if the batch (source, number) was applied before.
        """
        state = self.manifest()
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return False
        for name, rows in changes.items():
            old = state["relations"].get(name, {"key": None, "buckets": 1})
            parts = self._write(name, rows, old["key"], old["buckets"])
            state["relations"][name] = {**old, "schema": _ddl(rows), "parts": parts}
        self._finish(state, batch)
        return True

    def _finish(self, state: dict, batch: tuple[str, int] | None) -> None:
        state["number"] += 1
        if batch:
            state["batches"][batch[0]] = batch[1]
        self._publish(state)

    def upsert(self, name: str, rows: DataFrame, key: str, order: str, buckets: int = 64, batch: tuple[str, int] | None = None) -> bool:
        """Of each key the row with the greatest order stays, stored or new. Buckets without new rows are not read or written."""
        state = self.manifest()
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return False
        old = state["relations"].get(name, {"key": key, "buckets": buckets, "schema": _ddl(rows), "parts": []})
        if old["key"] != key:
            raise ValueError(f"{name} is kept by {old['key']}, not by {key}")
        touched = [r[0] for r in rows.select(F.pmod(F.xxhash64(key), F.lit(old["buckets"])).cast("int")).distinct().collect()]  # as many as buckets at most
        if touched:
            mine = self._rows(old, touched)
            new = latest(mine.unionByName(rows.select(*mine.columns)), [key], [F.desc(order)])
            rest = [p for p in old["parts"] if p["bucket"] not in touched]
            state["relations"][name] = {**old, "parts": rest + self._write(name, new, key, old["buckets"])}
        self._finish(state, batch)
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the last `keep` versions names, and older manifests; returns how many folders went."""
        numbers = self._numbers()
        kept = {p["path"].split("/")[1] for n in numbers[-keep:] for r in self.manifest(n)["relations"].values() for p in r["parts"]}
        where, fs = self._at("data")
        gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName() not in kept] if fs.exists(where) else []
        for n in numbers[:-keep]:
            manifest, _ = self._at(f"manifests/{n:010d}.json")
            fs.delete(manifest, False)
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


#: child, its column, parent, the parent's column.
Reference = tuple[str, str, str, str]


def _parents_first(refs: list[Reference], root: str) -> list[str]:
    """The relations that a delete in root reaches, each after all those that it refers to."""
    reached, order = {root}, []
    while more := {c for c, _, p, _ in refs if p in reached} - reached:
        reached |= more
    left = set(reached)
    while left:
        free = sorted(r for r in left if not any(c == r and p in left for c, _, p, _ in refs))
        if not free:
            raise ValueError(f"references go round in a circle: {', '.join(sorted(left))}")
        order += free
        left -= set(free)
    return order


def cascade(relations: dict[str, DataFrame], refs: list[Reference], root: str, ids: DataFrame) -> dict[str, DataFrame]:
    """What is left of every relation that a delete reaches, children first: root loses the rows of ids (its key column),
    all others the rows that refer to one that went. Null references stay."""
    (key,) = ids.columns
    gone, left = {}, {}
    for name in _parents_first(refs, root):
        rows = relations[name]
        mine = [(column, gone[parent], k) for child, column, parent, k in refs if child == name and parent in gone]
        hits = [(key, ids, key)] if name == root else []
        hits += mine
        keys = lambda df, k, c: df.select(F.col(k).alias(c)).where(F.col(c).isNotNull()).distinct()
        stay = rows
        for column, lost, k in hits:
            stay = stay.join(keys(lost, k, column), column, "left_anti").select(*rows.columns)
        went = [rows.join(keys(lost, k, column), column, "left_semi").select(*rows.columns) for column, lost, k in hits]
        gone[name] = _all(went)
        left[name] = stay
    return dict(reversed(left.items()))


def _all(some: list[DataFrame]) -> DataFrame:
    out = some[0]
    for df in some[1:]:
        out = out.unionByName(df)
    return out


def orphans(relations: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """child, parent, n: rows that refer to nothing, by reference."""
    def one(child: str, column: str, parent: str, key: str) -> DataFrame:
        lost = relations[child].where(F.col(column).isNotNull()).join(relations[parent].select(F.col(key).alias(column)).distinct(), column, "left_anti")
        return lost.agg(F.count("*").alias("n")).select(F.lit(child).alias("child"), F.lit(parent).alias("parent"), "n")

    return _all([one(*r) for r in refs])


def delete_cascade(store: Versions, refs: list[Reference], root: str, ids: DataFrame, batch: tuple[str, int] | None = None) -> bool:
    """The cascade over a store's relations as one version."""
    relations = {name: store.read(name) for name in _parents_first(refs, root)}
    return store.commit(cascade(relations, refs, root, ids), batch)
