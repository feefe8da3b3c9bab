"""From whatever users insert to checked rows of a table."""

from __future__ import annotations

import datetime
import decimal
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DuplicateError, IntegrityError, KeyloomError
from ..operators.relation import Relation
from ..plans.heading import Attribute
from .catalog import Catalog
from .codecs import encode
from .definition import length_of


UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


@dataclass
class Validation:
    """What validate() found; true if nothing."""

    errors: list[tuple[int, str, str]] = field(default_factory=list)  # row, attribute, reason

    def __bool__(self) -> bool:
        return not self.errors

    def summary(self) -> str:
        return "\n".join(f"row {i}{f', {n}' if n else ''}: {e}" for i, n, e in self.errors) or "valid"


def records(rows: Any, names: list[str]) -> list[dict[str, Any]]:
    """Rows as dictionaries. Sequences take the attributes' order."""
    module = type(rows).__module__.split(".")[0]
    if isinstance(rows, (str, Path)):
        rows = pd.read_csv(rows, dtype=str, keep_default_na=False)
        module = "pandas"
    if module == "polars":
        rows = rows.to_arrow()
    if isinstance(rows, pa.Table):
        return rows.to_pylist()
    if isinstance(rows, pd.DataFrame):
        if list(rows.index.names) != [None]:
            rows = rows.reset_index()
        return [{k: None if v is pd.NaT else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for k, v in r.items()} for r in rows.to_dict("records")]
    if isinstance(rows, np.ndarray) and rows.dtype.names:
        return [dict(zip(rows.dtype.names, r.tolist(), strict=True)) for r in rows]
    if isinstance(rows, Mapping):
        raise KeyloomError("insert takes many rows; insert1 takes one")
    out = []
    for r in rows:
        if isinstance(r, Mapping):
            out.append(dict(r))
        elif isinstance(r, np.void):
            out.append(dict(zip(r.dtype.names, r.tolist(), strict=True)))
        elif isinstance(r, Iterable) and not isinstance(r, (str, bytes)):
            r = list(r)
            if len(r) != len(names):
                raise KeyloomError(f"a row has {len(r)} values; the table has {len(names)} attributes")
            out.append(dict(zip(names, r, strict=True)))
        else:
            raise KeyloomError(f"a row can't be a {type(r).__name__}")
    return out


def converted(a: Attribute, value: Any) -> Any:
    """A value as Spark stores it; raises if it doesn't fit the type."""
    if isinstance(value, np.generic):
        value = value.item()
    if a.codec or value is None:
        return value
    kind = a.dtype
    if isinstance(value, float) and np.isnan(value):
        return None
    if isinstance(value, str) and not value and isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampNTZType)):
        return None
    if a.declared == "uuid":
        return str(value if isinstance(value, uuid.UUID) else uuid.UUID(str(value)))
    if a.json:
        import json

        return value if isinstance(value, str) and value[:1] in '{["' else json.dumps(value)
    if a.enum and value not in a.enum:
        raise KeyloomError(f"{value!r} is none of {a.enum}")
    if isinstance(kind, T.BooleanType):
        return value.strip().lower() in {"1", "true", "t", "yes"} if isinstance(value, str) else bool(value)
    if isinstance(kind, T.IntegralType):
        out = int(value)
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(kind), 63)
        if not -(1 << bits) <= out < 1 << bits:
            raise KeyloomError(f"{value} is out of range")
        return out
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(value)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(str(value)).quantize(decimal.Decimal(1).scaleb(-kind.scale), context=decimal.Context(prec=38))
    if isinstance(kind, T.TimestampNTZType):
        if isinstance(value, datetime.datetime):
            return value.replace(tzinfo=None)
        return datetime.datetime.combine(value, datetime.time()) if isinstance(value, datetime.date) else datetime.datetime.fromisoformat(str(value))
    if isinstance(kind, T.DateType):
        return value.date() if isinstance(value, datetime.datetime) else value if isinstance(value, datetime.date) else datetime.date.fromisoformat(str(value))
    if isinstance(kind, T.StringType):
        if (most := length_of(a.declared)) is not None and len(str(value)) > most:
            raise KeyloomError(f"{str(value)[:20]!r}... has more than {most} characters")
        return str(value)
    return bytes(value) if isinstance(kind, T.BinaryType) else value


def default_of(a: Attribute) -> Any:
    if a.default == "CURRENT_TIMESTAMP":
        return datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    return a.default


def check_rows(rows: list[dict[str, Any]], attributes: list[Attribute], ignore_extra: bool = False, table: str = "") -> tuple[list[dict[str, Any]], Validation]:
    """Rows as stored, and what is wrong with them, row by row."""
    by_name, out, found = {a.name: a for a in attributes}, [], Validation()
    first = set(rows[0]) if rows else set()
    for i, row in enumerate(rows):
        if set(row) != first:
            found.errors.append((i, "", "its attributes differ from the first row's"))
        stored: dict[str, Any] = {}
        for n in row:
            if n not in by_name and not ignore_extra:
                found.errors.append((i, n, "no such attribute"))
        key = {"__table": table, **{n: row[n] for n in row if n in by_name and by_name[n].in_key}}
        for a in attributes:
            try:
                value = converted(a, row.get(a.name))
                if value is None and a.has_default:
                    value = converted(a, default_of(a))
                if value is None and not a.nullable and not a.autoincrement:
                    found.errors.append((i, a.name, "a value is needed"))
                stored[a.name] = encode(a, value, key | {"__field": a.name}) if a.codec else value
            except (KeyloomError, ValueError, TypeError, decimal.InvalidOperation) as e:
                found.errors.append((i, a.name, str(e)))
        out.append(stored)
    return out, found


def frame(catalog: Catalog, table: str, rows: list[dict[str, Any]]) -> DataFrame:
    schema = catalog.schema(table)
    return catalog.spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)


def from_frame(catalog: Catalog, table: str, df: DataFrame, ignore_extra: bool) -> DataFrame:
    """A DataFrame's common columns as the table's rows, stored as rows are: NaN is null, empty uuids and JSON too, uuids are in
    lower case; defaults where it has none or null. Columns with a codec must hold what the codec stores. Automatic numbers are greater
    than all present ones and differ, but needn't follow each other."""
    attributes = catalog.definition(table).heading.every
    extra = [c for c in df.columns if c not in {a.name for a in attributes}]
    if extra and not ignore_extra:
        raise KeyloomError(f"no such attributes: {extra}")
    columns = []
    for a in attributes:
        if a.name not in df.columns:
            value = F.lit(None).cast(a.dtype)
        else:
            kind, value = df.schema[a.name].dataType, F.col(f"`{a.name}`")
            if a.codec and kind != a.dtype:
                raise KeyloomError(f"{a.name}: a DataFrame must hold what {a.declared} stores, {a.dtype.simpleString()}; insert rows to have it encoded")
            if isinstance(kind, (T.FloatType, T.DoubleType)):
                value = F.when(~F.isnan(value), value)
            if a.declared == "uuid":
                value = F.lower(F.trim(value.cast("string")))
            if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) and a.json:
                value = F.to_json(value)
            value = value.cast(a.dtype)
        if a.has_default and a.default is not None:
            value = F.coalesce(value, F.lit(default_of(a)).cast(a.dtype))
        if a.autoincrement:
            most = catalog.rows(table).agg(F.max(a.name)).first()[0] or 0
            value = F.coalesce(value, (F.monotonically_increasing_id() + 1 + most).cast(a.dtype))
        columns.append(value.alias(a.name))
    return df.select(*columns)


def numbered(catalog: Catalog, table: str, rows: list[dict[str, Any]]) -> None:
    """Give automatic numbers: one more than the greatest so far."""
    for a in catalog.definition(table).heading.every:
        if a.autoincrement and any(r[a.name] is None for r in rows):
            most = catalog.rows(table).agg(F.max(a.name)).first()[0] or 0
            for r in rows:
                if r[a.name] is None:
                    most += 1
                    r[a.name] = most
                most = max(most, r[a.name])


def violations(catalog: Catalog, table: str, df: DataFrame, present: DataFrame, parents: bool = True) -> None:
    """Raise if rows break a constraint. All checks run as one job: each gives one row at most."""
    d = catalog.definition(table)
    key = [a.name for a in d.heading.every if a.in_key]
    checks: list[tuple[type[Exception], str, DataFrame]] = []
    for names in [tuple(key), *(n for n, unique in d.indexes if unique and all(x in df.columns for x in n))]:
        some = df.select(*names).na.drop("any")
        checks.append((DuplicateError, f"repeated {names}", some.groupBy(*names).count().filter("count > 1")))
        checks.append((DuplicateError, f"{names} is taken", some.join(present.select(*names), list(names), "left_semi")))
    for a in d.heading.every:
        if not a.nullable:
            checks.append((IntegrityError, f"{a.name} is null", df.filter(F.col(a.name).isNull())))
        if a.enum:
            checks.append((IntegrityError, f"{a.name} is none of {a.enum}", df.filter(F.col(a.name).isNotNull() & ~F.col(a.name).isin(*a.enum))))
        if a.declared == "uuid":
            checks.append((IntegrityError, f"{a.name} is no uuid", df.filter(~F.col(a.name).rlike(UUID))))
        if a.json and not a.codec:
            checks.append((IntegrityError, f"{a.name} is no JSON", df.filter(F.col(a.name).isNotNull() & F.try_parse_json(F.col(a.name)).isNull())))
        if (most := length_of(a.declared)) is not None:
            checks.append((IntegrityError, f"{a.name} has more than {most} characters", df.filter(F.length(a.name) > most)))
    for f in d.foreign_keys if parents else []:
        parent = catalog.rows(f.parent).select(*[F.col(p).alias(c) for c, p in f.columns.items()])
        if f.parent == table:
            parent = parent.union(df.select(*[F.col(p).alias(c) for c, p in f.columns.items()]))
        checks.append((IntegrityError, f"{list(f.columns)} has no entity in {f.parent}", df.select(*f.columns).na.drop("any").join(parent, list(f.columns), "left_anti")))
    all_: DataFrame | None = None
    for k, (_, _, bad) in enumerate(checks):
        one = bad.limit(1).select(F.lit(k).alias("k"), F.to_json(F.struct(*bad.columns)).alias("row"))
        all_ = one if all_ is None else all_.union(one)
    if all_ is not None and (hit := all_.orderBy("k").first()):
        kind, text, _ = checks[hit["k"]]
        raise kind(f"{table}: {text}: {hit['row']}")


def insert(catalog: Catalog, table: str, rows: Any, replace: bool = False, skip_duplicates: bool = False, ignore_extra_fields: bool = False, chunk_size: int | None = None) -> None:
    if not catalog.in_transaction:
        catalog.refresh()
    d = catalog.definition(table)
    if chunk_size is not None:
        if isinstance(rows, (DataFrame, Relation)):
            raise KeyloomError("a query can't be inserted in chunks")
        rows = records(rows, d.heading.names)
        for a in range(0, len(rows), chunk_size):
            insert(catalog, table, rows[a : a + chunk_size], replace, skip_duplicates, ignore_extra_fields)
        return
    if not isinstance(rows, (DataFrame, Relation)):
        rows = records(rows, d.heading.names)  # once, whatever gives them
        if not rows:
            return
    catalog.atomic(lambda: _insert(catalog, table, rows, replace, skip_duplicates, ignore_extra_fields))


def _insert(catalog: Catalog, table: str, rows: DataFrame | Relation | list[dict[str, Any]], replace: bool, skip_duplicates: bool, ignore_extra_fields: bool) -> None:
    """Within a transaction: rows are written once, checked as written against the transaction's snapshot, and then taken in."""
    d = catalog.definition(table)
    if isinstance(rows, (DataFrame, Relation)):
        source = rows.df if isinstance(rows, Relation) else rows
        # a query gives its common attributes; a DataFrame must fit unless extra columns are to be ignored
        df = from_frame(catalog, table, source, ignore_extra_fields or isinstance(rows, Relation))
    else:
        stored, found = check_rows(rows, d.heading.every, ignore_extra_fields, table)
        if not found:
            raise (KeyloomError if all(e != "a value is needed" for _, _, e in found.errors) else IntegrityError)(f"{table}: {found.summary()}")
        numbered(catalog, table, stored)
        df = frame(catalog, table, stored)
    key = [a.name for a in d.heading.every if a.in_key]
    present = catalog.rows(table)
    if skip_duplicates:
        # only the primary key's duplicates are skipped; other unique keys still count
        df = df.dropDuplicates(key).join(present.select(*key), key, "left_anti")
    elif replace:
        df = df.dropDuplicates(key)
    places = [catalog.stage(table, df)]
    try:
        new = catalog.part(table, places[0])
        if replace:
            others = present.join(new.select(*key), key, "left_anti")
            violations(catalog, table, new, others)
            places.append(catalog.stage(table, others))
        else:
            violations(catalog, table, new, present)
    except Exception:
        for p in places:
            catalog.store.delete(p)
        raise
    catalog.adopt(table, places, instead=replace)
