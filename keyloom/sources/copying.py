"""Copies of tables and namespaces, their comparison, backup and restore."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import KeyloomError
from ..plans.graph import Graph
from .catalog import Catalog
from .inserts import from_frame, violations


def copy_table(catalog: Catalog, source: str, target: str, skip_duplicates: bool = True) -> int:
    """Copy the rows of one table into another of the same key; how many were new."""
    rows = from_frame(catalog, target, catalog.rows(source), ignore_extra=True)
    key = [a.name for a in catalog.definition(target).heading.every if a.in_key]
    present = catalog.rows(target)
    if skip_duplicates:
        rows = rows.join(present.select(*key), key, "left_anti")
    n = rows.count()
    if n:
        violations(catalog, target, rows, present)
        catalog.append(target, rows)
    return n


@dataclass
class Difference:
    """How two tables of one key differ; true if they don't."""

    only_left: int = 0
    only_right: int = 0
    changed: dict[str, int] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return not (self.only_left or self.only_right or any(self.changed.values()))


def _differs(a: Column, b: Column, kind: T.DataType, tolerance: float) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        near = F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
        return ~(near | (F.isnan(a) & F.isnan(b)) | (a.isNull() & b.isNull())) | (a.isNull() != b.isNull())
    return ~a.eqNullSafe(b)


def compare_frames(left: DataFrame, right: DataFrame, key: list[str], tolerance: float = 1e-9) -> Difference:
    """One full join on the key and one aggregate over it."""
    both = [c for c in left.columns if c in right.columns and c not in key]
    a = left.select(*key, *[F.col(c).alias(f"a_{c}") for c in both], F.lit(1).alias("a_"))
    b = right.select(*key, *[F.col(c).alias(f"b_{c}") for c in both], F.lit(1).alias("b_"))
    joined = a.join(b, key, "full") if key else a.crossJoin(b)
    here = F.col("a_").isNotNull() & F.col("b_").isNotNull()
    kinds = {f.name: f.dataType for f in left.schema.fields}
    changed = [F.count_if(here & F.coalesce(_differs(F.col(f"a_{c}"), F.col(f"b_{c}"), kinds[c], tolerance), F.lit(True))).alias(c) for c in both]
    row = joined.agg(F.count_if(F.col("b_").isNull()).alias("a_"), F.count_if(F.col("a_").isNull()).alias("b_"), *changed).first()
    return Difference(row["a_"], row["b_"], {c: row[c] for c in both})


def compare_tables(catalog: Catalog, left: str, right: str, tolerance: float = 1e-9) -> Difference:
    key = [a.name for a in catalog.definition(left).heading.every if a.in_key]
    if set(key) != {a.name for a in catalog.definition(right).heading.every if a.in_key}:
        raise KeyloomError(f"{left} and {right} have different keys")
    return compare_frames(catalog.rows(left), catalog.rows(right), key, tolerance)


def backup(catalog: Catalog, namespace: str, folder: str) -> list[str]:
    """Write every table of a namespace as Parquet into a folder; their names, parents first."""
    names = [t for t in Graph(catalog).sorted() if t.split(".")[0] == namespace]
    for t in names:
        catalog.rows(t).write.mode("overwrite").parquet(f"{folder}/{t}")
    return names


def restore(catalog: Catalog, namespace: str, folder: str) -> list[str]:
    """Replace the rows of a namespace's tables, at once, by a backup of the same definitions."""
    names = [t for t in Graph(catalog).sorted() if t.split(".")[0] == namespace]
    with catalog.change():
        for t in names:
            rows = from_frame(catalog, t, catalog.spark.read.schema(catalog.schema(t)).parquet(f"{folder}/{t}"), ignore_extra=False)
            violations(catalog, t, rows, catalog.rows(t).limit(0))
            catalog.rewrite(t, rows)
    return names
