"""Restrictions: what may stand to the right of & and -, compiled to columns and joins.

A condition compiles to a constant, to a Column, or to membership in another relation. Membership at the top of a
restriction is a semijoin or antijoin; within an OR list it is a left join on the distinct keys of the other relation with a
marker column. Lists of many dictionaries over one set of names become one such membership instead of a long OR.
"""

from __future__ import annotations

import datetime
import decimal
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..errors import KeyloomError, UnknownAttributeError
from ..functions import json_path
from ..functions.dialect import translate
from ..plans.heading import Heading

if TYPE_CHECKING:
    from .relation import Relation

#: Dictionaries of a list beyond which it is a join rather than an OR.
MANY = 50


class AndList(list):
    """Conditions that must all hold; other lists are alternatives."""


class Not:
    """The negation of a condition."""

    def __init__(self, condition: Any):
        self.condition = condition


@dataclass(frozen=True)
class Top:
    """The first `limit` entities in an order, after `offset`. order_by None keeps the order of a Top before."""

    limit: int | None = 1
    order_by: str | Sequence[str] | None = "KEY"
    offset: int = 0

    def __post_init__(self) -> None:
        if self.limit is not None and (not isinstance(self.limit, int) or isinstance(self.limit, bool)):
            raise TypeError("the limit of Top must be an integer")
        if not isinstance(self.offset or 0, int):
            raise TypeError("the offset of Top must be an integer")
        order = self.order_by
        if order is not None:
            order = (order,) if isinstance(order, str) else tuple(order) if isinstance(order, Sequence) else (order,)
            if not all(isinstance(x, str) for x in order):
                raise TypeError("what Top orders by must be strings")
        object.__setattr__(self, "order_by", order)
        object.__setattr__(self, "offset", self.offset or 0)

    def follows(self, before: Top) -> bool:
        """Whether it is merged with the one before instead of nested."""
        return self.order_by is None or self.order_by == before.order_by

    def merged(self, before: Top) -> Top:
        limits = [x for x in (self.limit, before.limit) if x is not None]
        return Top(min(limits, default=None), before.order_by, before.offset + self.offset)


@dataclass
class Membership:
    """The common names' values are among the other relation's; without common names, the other has a row."""

    other: DataFrame
    names: list[str]
    safe: bool  # no nulls among the names on either side


@dataclass
class Clause:
    """A condition as a column over the relation's columns and the markers of memberships that are joined first."""

    column: Column
    members: list[tuple[str, Membership]] = field(default_factory=list)


def value_of(value: Any, name: str, heading: Heading) -> Any:
    """A Python value as Spark takes it for this attribute."""
    if isinstance(value, np.generic):
        value = value.item()
    kind = heading[name].dtype if name in heading else None
    if heading[name].declared == "uuid" if name in heading else False:
        try:
            return str(value if isinstance(value, uuid.UUID) else uuid.UUID(str(value)))
        except ValueError:
            raise KeyloomError(f"{value!r} is no uuid for {name}") from None
    if isinstance(value, uuid.UUID):
        return value.bytes if isinstance(kind, BinaryType) else str(value)
    if isinstance(value, (dict, list, tuple)):
        import json

        return json.dumps(value)
    if isinstance(value, float) and np.isnan(value):
        return None
    return value


def literal(value: Any, name: str, heading: Heading) -> Column:
    value = value_of(value, name, heading)
    plain = (str, bytes, bool, int, float, decimal.Decimal, datetime.date, datetime.datetime, datetime.timedelta, datetime.time)
    if value is not None and not isinstance(value, plain):
        raise KeyloomError(f"can't compare {name} with a {type(value).__name__}")
    out = F.lit(value)
    kind = heading[name].dtype
    return out.cast(kind) if isinstance(value, (str, datetime.datetime)) and not isinstance(kind, StringType) else out


def equals(name: str, value: Any, heading: Heading) -> Column:
    if path := json_path.parse(name):
        return json_path.equals(F.col(path[0]), path[1], path[2], value)
    if value is None or (isinstance(value, float) and np.isnan(value)):
        return F.col(name).isNull()
    if heading[name].json and isinstance(value, (dict, list)):
        import json

        return F.to_json(F.try_parse_json(F.col(name))) == F.to_json(F.parse_json(F.lit(json.dumps(value))))
    return F.col(name) == literal(value, name, heading)


def known(name: str, heading: Heading) -> bool:
    path = json_path.parse(name)
    return (path[0] if path else name) in heading


class Compiler:
    """Compiles the conditions of one restriction of a relation."""

    def __init__(self, relation: Relation, semantic_check: bool = True):
        self.relation, self.heading, self.check, self.count = relation, relation.heading, semantic_check, 0

    def expression(self, text: str) -> Column:
        """A predicate in SQL, checked against the heading."""
        try:
            column = F.expr(translate(text))
            self.relation.df.filter(column)
        except (AnalysisException, ParseException) as e:
            kind = UnknownAttributeError if "UNRESOLVED" in (e.getCondition() or "") else KeyloomError
            raise kind(f"{text!r}: {str(e).splitlines()[0]}") from None
        return column

    def compile(self, condition: Any) -> bool | Clause | Membership:
        from .relation import Relation, U

        if isinstance(condition, type) and hasattr(condition, "as_relation"):
            condition = condition()
        if hasattr(condition, "as_relation"):
            condition = condition.as_relation()
        if isinstance(condition, (bool, np.bool_)):
            return bool(condition)
        if isinstance(condition, U):
            return True
        if isinstance(condition, str):
            return Clause(self.expression(condition))
        if isinstance(condition, Column):
            return Clause(condition)
        if isinstance(condition, Not):
            return self.negated(self.compile(condition.condition))
        if isinstance(condition, AndList):
            return self.all(self.compile(x) for x in condition)
        if isinstance(condition, Top):
            raise KeyloomError("Top may only stand by itself, not within a list")
        if isinstance(condition, Mapping):
            return self.entity(dict(condition))
        if isinstance(condition, np.void):
            return self.entity({n: condition[n] for n in condition.dtype.fields})
        if isinstance(condition, Relation):
            return self.membership(condition)
        if isinstance(condition, pd.DataFrame):
            keyed = condition if list(condition.index.names) == [None] else condition.reset_index()
            return self.any(keyed.to_dict("records"))
        if isinstance(condition, np.ndarray) and condition.dtype.fields:
            return self.any([{n: row[n] for n in condition.dtype.names} for row in condition])
        if isinstance(condition, Iterable) and not isinstance(condition, (bytes, bytearray)):
            return self.any(list(condition))
        raise KeyloomError(f"Invalid restriction type {type(condition).__name__}")

    def entity(self, row: dict[str, Any]) -> bool | Clause:
        names = [n for n in row if known(n, self.heading)]
        if not names:
            return True
        column = F.lit(True)
        for k, n in enumerate(names):
            here = equals(n, row[n], self.heading)
            column = here if not k else column & here
        return Clause(column)

    def membership(self, other: Relation) -> Membership:
        from .relation import assert_compatible

        if self.check:
            assert_compatible(self.relation, other)
        names = [n for n in self.heading.names if n in other.heading]
        safe = not any(h[n].nullable for h in (self.heading, other.heading) for n in names)
        return Membership(other.df.select(*names) if names else other.df.select(F.lit(1).alias("one")).limit(1), names, safe)

    def clause(self, x: Clause | Membership) -> Clause:
        if isinstance(x, Clause):
            return x
        self.count += 1
        marker = f"__in{self.count}"
        return Clause(F.coalesce(F.col(marker), F.lit(False)), [(marker, x)])

    def negated(self, x: bool | Clause | Membership) -> bool | Clause:
        if isinstance(x, bool):
            return not x
        x = self.clause(x)
        return Clause(~x.column, x.members)

    def all(self, parts: Iterable[bool | Clause | Membership]) -> bool | Clause:
        out: Clause | None = None
        for p in parts:
            if p is False:
                return False
            if p is not True:
                p = self.clause(p)
                out = Clause(out.column & p.column, out.members + p.members) if out else p
        return True if out is None else out

    def any(self, items: list[Any]) -> bool | Clause | Membership:
        if len(items) > MANY and all(isinstance(x, Mapping) for x in items) and (found := self.table_of(items)):
            return found
        out: Clause | None = None
        for x in items:
            p = self.compile(x)
            if p is True:
                return True
            if p is not False:
                p = self.clause(p)
                out = Clause(out.column | p.column, out.members + p.members) if out else p
        return False if out is None else out

    def table_of(self, items: list[Mapping]) -> Membership | None:
        """A long list of entities of the same names, without nulls or JSON paths, as a table to join."""
        names = [n for n in self.heading.names if n in items[0]]
        if not names or any([n for n in self.heading.names if n in x] != names or any(json_path.parse(k) for k in x) for x in items):
            return None
        rows = [tuple(value_of(x[n], n, self.heading) for n in names) for x in items]
        if any(v is None for r in rows for v in r):
            return None
        schema = StructType([StructField(n, self.heading[n].dtype) for n in names])
        spark = self.relation.df.sparkSession
        return Membership(spark.createDataFrame(rows, schema, verifySchema=False), names, not any(self.heading[n].nullable for n in names))


def _marked(df: DataFrame, marker: str, m: Membership) -> DataFrame:
    if not m.names:
        return df.join(m.other.select(F.lit(True).alias(marker)), how="left")
    return df.join(m.other.distinct().withColumn(marker, F.lit(True)), m.names, "left").select(*df.columns, marker)


def _antijoin(df: DataFrame, m: Membership) -> DataFrame:
    """NOT IN: an unknown comparison drops a row, as in SQL. Keys and other attributes without nulls take a plain antijoin."""
    if not m.names:
        return df.join(m.other, how="left_anti")
    if m.safe:
        return df.join(m.other, m.names, "left_anti")
    if len(m.names) == 1:
        # the other's nulls and emptiness are one row of counts, so the antijoin itself stays an equi-join
        (name,) = m.names
        counts = m.other.agg(F.count("*").alias("__n"), F.count(name).alias("__known"))
        left = df.join(m.other.filter(F.col(name).isNotNull()), name, "left_anti").crossJoin(F.broadcast(counts))
        keep = (F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & F.col(name).isNotNull())
        return left.filter(keep).select(*df.columns)
    a, b = df.alias("a"), m.other.distinct().alias("b")
    unknown = [(F.col(f"a.`{n}`") == F.col(f"b.`{n}`")) | F.col(f"a.`{n}`").isNull() | F.col(f"b.`{n}`").isNull() for n in m.names]
    condition = unknown[0]
    for u in unknown[1:]:
        condition = condition & u
    return a.join(b, condition, "left_anti").select(*df.columns)


def applied(relation: Relation, condition: Any, semantic_check: bool = True) -> DataFrame | None:
    """The restricted DataFrame, or None if the condition is always true."""
    compiler, negative = Compiler(relation, semantic_check), False
    while isinstance(condition, Not):
        condition, negative = condition.condition, not negative
    found = compiler.compile(condition)
    if isinstance(found, bool):
        return None if found != negative else relation.df.filter(F.lit(False))
    if isinstance(found, Membership):
        if negative:
            return _antijoin(relation.df, found)
        return relation.df.join(found.other, found.names, "left_semi") if found.names else relation.df.join(found.other, how="left_semi")
    df = relation.df
    for marker, m in found.members:
        df = _marked(df, marker, m)
    return df.filter(~found.column if negative else found.column).select(*relation.df.columns)
