"""The relations of an index: their columns and keys, rows made to fit them, and what is wrong with rows that don't.

A store of relations is created by committing empty ones, so that readers find every relation with its types from the
first version on; languages add relations of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .versions import Versions


@dataclass(frozen=True)
class Relation:
    """Columns as DDL; key: what a row is known by (empty: rows may repeat); required: never null; defaults as SQL."""

    columns: str
    key: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    defaults: tuple[tuple[str, str], ...] = ()

    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)


# The relations that every index has.
CORE = {
    "test_registry": Relation("test_id string, file_path string, class_name string, method_name string, test_type string, line_number int, language string, repository_path string, created_at timestamp", ("test_id",), ("test_id", "file_path", "method_name"), (("language", "'python'"), ("created_at", "current_timestamp()"))),
    "test_dependencies": Relation("test_id string, referenced_class string, import_type string", (), ("test_id", "referenced_class")),
    "reverse_index": Relation("production_class string, test_id string, test_file_path string, reference_type string", (), ("production_class", "test_id")),
    "test_metadata": Relation("test_id string, description string, markers array<string>, is_async boolean, is_parameterized boolean, pattern string, line_number int", ("test_id",), ("test_id",), (("is_async", "false"), ("is_parameterized", "false"))),
    "test_structure": Relation("directory_path string, category string, file_count int, test_count int, total_lines int", (), ("directory_path",)),
    "test_function_mapping": Relation("test_id string, module_name string, function_name string, call_type string, source string", (), ("test_id",)),
}
# Relations that a language adds.
BY_LANGUAGE = {
    "python": {
        "python_fixtures": Relation("test_id string, fixture_name string, fixture_scope string, fixture_type string", (), ("test_id", "fixture_name"), (("fixture_scope", "'function'"),)),
        "python_decorators": Relation("test_id string, decorator_name string, decorator_args map<string,string>", (), ("test_id", "decorator_name")),
    },
    "java": {
        "java_reflection_calls": Relation("test_id string, reflection_method string, target_class string, target_method string, target_field string, line_number int", (), ("test_id", "reflection_method")),
        "java_di_fields": Relation("test_id string, field_name string, field_type string, injection_type string, annotation_names array<string>", (), ("test_id", "field_name")),
        "java_annotations": Relation("test_id string, annotation_name string, annotation_attributes string, target_type string", (), ("test_id", "annotation_name")),
    },
    "javascript": {"js_mocks": Relation("test_id string, mock_type string, mock_target string, line_number int", (), ("test_id", "mock_type"))},
}


def relations(*languages: str) -> dict[str, Relation]:
    return CORE | {name: r for lang in languages for name, r in BY_LANGUAGE.get(lang, {}).items()}


def conform(rows: DataFrame, relation: Relation) -> DataFrame:
    """Rows with exactly the relation's columns and types: others go, missing ones are null, nulls with a default get it.
    A value that its type can't hold becomes null."""
    defaults = dict(relation.defaults)

    def one(f):
        given = F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        return (F.coalesce(given, F.expr(defaults[f.name])) if f.name in defaults else given).alias(f.name)

    return rows.select(*map(one, relation.schema()))


def create(store: Versions, *languages: str) -> list[str]:
    """Commits those relations that a store doesn't have yet, empty, as one version; their names."""
    known = store.manifest()["relations"]
    new = {name: store.spark.createDataFrame([], r.schema()) for name, r in relations(*languages).items() if name not in known}
    if new:
        store.commit(new)
    return sorted(new)


def differences(found: dict[str, StructType], wanted: dict[str, Relation]) -> list[tuple[str, str, str, str]]:
    """(relation, column, wanted type, found type) of all that isn't as it should be; a missing relation has column *."""
    out = []
    for name, relation in wanted.items():
        if name not in found:
            out.append((name, "*", "relation", "missing"))
            continue
        have = {f.name: f.dataType.simpleString() for f in found[name]}
        out += [(name, f.name, f.dataType.simpleString(), have.get(f.name, "missing")) for f in relation.schema() if have.get(f.name) != f.dataType.simpleString()]
    return out


def verify(rows: dict[str, DataFrame], wanted: dict[str, Relation]) -> DataFrame:
    """relation, n_rows, n_null (rows that lack a required column), n_repeated (rows beyond the first of their key)."""
    spark = SparkSession.getActiveSession()
    out = spark.createDataFrame([], "relation string, n_rows long, n_null long, n_repeated long")
    for name, df in rows.items():
        r = wanted[name]
        lacks = F.lit(False)
        for c in r.required:
            lacks = lacks | F.col(c).isNull()
        if r.key:  # counted by key before anything is compared
            df = df.groupBy(*r.key).agg(F.count("*").alias("__n"), F.count_if(lacks).alias("__null"))
            sums = df.agg(F.sum("__n").alias("n"), F.sum("__null").alias("m"), F.sum(F.col("__n") - 1).alias("k"))
        else:
            sums = df.agg(F.count("*").alias("n"), F.count_if(lacks).alias("m"), F.lit(0).cast("long").alias("k"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        out = out.unionByName(sums.select(F.lit(name).alias("relation"), zero("n").alias("n_rows"), zero("m").alias("n_null"), zero("k").alias("n_repeated")))
    return out
