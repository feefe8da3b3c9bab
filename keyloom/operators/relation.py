"""Relations: a DataFrame with a heading, and the operators that keep both in step.

Nothing here renders SQL for a relation or runs a query while building one: every operator composes DataFrames, and Catalyst
plans the whole. keyloom only decides what Catalyst can't know: keys, their propagation, lineage, and where a distinct is
superfluous because a key is unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..errors import KeyloomError, LineageError, UnknownAttributeError
from ..functions import json_path
from ..functions.dialect import translate
from ..plans.heading import Attribute, Heading
from .restriction import Not, Top, applied


def as_relation(x: Any) -> Relation | U:
    if isinstance(x, type) and hasattr(x, "as_relation"):
        x = x()
    if hasattr(x, "as_relation"):
        x = x.as_relation()
    if not isinstance(x, (Relation, U)):
        raise KeyloomError(f"{x!r} is no relation")
    return x


def assert_compatible(a: Relation, b: Relation, check: bool = True) -> None:
    """Attributes of one name must stem from one origin. Relations without any lineage aren't checked."""
    if not check or not a.tracked or not b.tracked:
        return
    for name in (n for n in a.heading.names if n in b.heading):
        x, y = a.heading[name].lineage, b.heading[name].lineage
        if x is None or y is None or x != y:
            raise LineageError(f"can't match on {name}: its origins are {x} and {y}; rename one of them by proj()")


class Relation:
    """An immutable lazy relation."""

    def __init__(self, df: DataFrame, heading: Heading, top: Top | None = None, tracked: bool | None = None, unique: bool = True):
        """df has the heading's visible attributes. top is pending: it is applied when df is asked for. unique: the key is
        known to be unique, so that no distinct is needed for it."""
        self._df, self.heading, self._top, self.unique = df, heading, top, unique
        self.tracked = any(a.lineage for a in heading) if tracked is None else tracked

    @classmethod
    def of(cls, df: DataFrame, key: list[str], origin: str | None = None, lineage: dict[str, str] | None = None, unique: bool = False) -> Relation:
        """A relation on any DataFrame. lineage overrides origins, for foreign keys. unique: the key is known to be unique; if it
        isn't, entities are its distinct values."""
        heading = Heading.of(df.schema, key, origin)
        heading = heading.with_attributes(**{n: replace(heading[n], lineage=x) for n, x in (lineage or {}).items()})
        return cls(df.select(*heading.names), heading, unique=unique)

    def as_relation(self) -> Relation:
        return self

    # ---- the DataFrame

    @property
    def primary_key(self) -> list[str]:
        return self.heading.primary_key

    def _order(self, by: tuple[str, ...] | None) -> list[Column]:
        out: list[Column] = []
        for item in by or ("KEY",):
            for one in item.split(",") if "(" not in item else [item]:
                text, down = one.strip(), False
                head, _, last = text.rpartition(" ")
                if last.upper() in {"DESC", "ASC"}:
                    text, down = head.strip(), last.upper() == "DESC"
                for name in self.primary_key if text.upper() == "KEY" else [text]:
                    column = F.col(f"`{name.strip('`')}`") if name.strip("`") in self.heading else F.expr(translate(name))
                    out.append(column.desc() if down else column.asc())
        return out

    @property
    def df(self) -> DataFrame:
        """The DataFrame, with a pending Top applied."""
        if self._top is None:
            return self._df
        out = self._df.orderBy(*self._order(self._top.order_by)) if self._order(self._top.order_by) else self._df
        if self._top.offset:
            out = out.offset(self._top.offset)
        return out if self._top.limit is None else out.limit(self._top.limit)

    def _of(self, df: DataFrame, heading: Heading | None = None, unique: bool | None = None) -> Relation:
        heading = heading or self.heading
        return Relation(df.select(*[f"`{n}`" for n in heading.names]), heading, tracked=self.tracked, unique=self.unique if unique is None else unique)

    # ---- restriction

    def restrict(self, condition: Any, semantic_check: bool = True) -> Relation:
        if isinstance(condition, Top):
            if self._top and condition.follows(self._top):
                return Relation(self._df, self.heading, condition.merged(self._top), self.tracked, self.unique)
            return Relation(self.df, self.heading, condition, self.tracked, self.unique)
        df = applied(self, condition, semantic_check)
        return self if df is None else self._of(df)

    def __and__(self, condition: Any) -> Relation:
        return self.restrict(condition)

    def __sub__(self, condition: Any) -> Relation:
        return self.restrict(Not(condition))

    def __neg__(self) -> Not:
        return Not(self)

    def __contains__(self, item: Any) -> bool:
        return bool(self & item)

    # ---- projection

    def proj(self, *names: str, **named: str) -> Relation:
        """The key and the attributes named; ... for all; '-a' leaves a out; new='old' renames, new='(old)' copies, other text
        computes."""
        heading, keep, drop = self.heading, [], []
        for n in names:
            if n is Ellipsis:
                keep += heading.secondary
            elif not isinstance(n, str):
                raise KeyloomError(f"proj takes names, not {n!r}")
            elif n.startswith("-"):
                drop.append(n[1:].strip())
            else:
                keep.append(n)
        for n in [*keep, *drop]:
            if n not in heading:
                raise UnknownAttributeError(f"no attribute {n}")
        if bad := [n for n in drop if n in heading.primary_key]:
            raise KeyloomError(f"key attributes can't be left out: {bad}")
        renamed: dict[str, str] = {}
        copied: dict[str, str] = {}
        computed: dict[str, Column] = {}
        for new, what in named.items():
            text = str(what).strip()
            if text in heading:
                if text in renamed:
                    raise KeyloomError(f"{text} is renamed twice; copy it by ({text})")
                renamed[text] = new
            elif text.startswith("(") and text.endswith(")") and text[1:-1].strip() in heading:
                copied[new] = text[1:-1].strip()
            else:
                computed[new] = self._column(text)
        if twice := [n for n in renamed if n in keep and names.count(n)]:
            raise KeyloomError(f"both kept and renamed: {twice}")
        base = [n for n in heading.names if (n in heading.primary_key or n in keep or n in renamed) and n not in drop]
        attributes = [replace(heading[n], name=renamed.get(n, n)) for n in base]
        columns = [F.col(f"`{n}`").alias(renamed.get(n, n)) for n in base]
        for new, old in copied.items():
            attributes.append(replace(heading[old], name=new))
            columns.append(F.col(f"`{old}`").alias(new))
        taken = [a.name for a in attributes]
        if clash := {n for n in [*taken, *computed] if [*taken, *computed].count(n) > 1}:
            raise KeyloomError(f"names clash: {sorted(clash)}")
        columns += [c.alias(n) for n, c in computed.items()]
        df = self.df.select(*columns)
        attributes += [Attribute(n, df.schema[n].dataType, nullable=True) for n in computed]
        attributes = [a for a in attributes if a.in_key] + [a for a in attributes if not a.in_key]
        return self._of(df, Heading(attributes))

    def _column(self, text: str) -> Column:
        if path := json_path.parse(text):
            if path[0] in self.heading:
                return json_path.extract(F.col(path[0]), path[1], path[2])
        try:
            column = F.expr(translate(text))
            self._df.select(column)
        except (AnalysisException, ParseException) as e:
            unknown = "UNRESOLVED" in (e.getCondition() or "")
            raise (UnknownAttributeError if unknown else KeyloomError)(f"{text!r}: {str(e).splitlines()[0]}") from None
        return column

    # ---- joins

    def join(self, other: Any, left: bool = False, semantic_check: bool = True, allow_nullable_pk: bool = False) -> Relation:
        """Natural join on all common names; with left, all of self's entities stay."""
        other = as_relation(other)
        if isinstance(other, U):
            raise KeyloomError("a universal set can't be joined")
        assert_compatible(self, other, semantic_check)
        if left and not self.heading.determines(other.heading) and not allow_nullable_pk:
            raise KeyloomError(f"a left join needs the right side's key {other.primary_key} on the left")
        shared = [n for n in self.heading.names if n in other.heading]
        a, b = self.df, other.df
        if shared:
            df = a.join(b, shared, "left" if left else "inner")
        else:
            df = a.join(b, how="left") if left else a.crossJoin(b)
        heading = self.heading.join(other.heading, keep_both=left and not self.heading.determines(other.heading))
        if left:
            gone = [n for n in other.heading.names if n not in shared]
            heading = heading.with_attributes(**{n: replace(heading[n], nullable=True) for n in gone})
        out = self._of(df, heading, unique=self.unique and other.unique)
        out.tracked = self.tracked or other.tracked
        return out

    def __mul__(self, other: Any) -> Relation:
        return self.join(other)

    def extend(self, other: Any, semantic_check: bool = True) -> Relation:
        """self with other's attributes where other has them: a left join on a key that self determines."""
        return self.join(other, left=True, semantic_check=semantic_check)

    # ---- aggregation

    def aggr(self, group: Any, *names: Any, exclude_nonmatching: bool = False, semantic_check: bool = True, **named: str) -> Relation:
        """For each of self's entities, aggregates over the group's matching rows. All entities stay unless
        exclude_nonmatching. names: self's attributes to keep, ... for all."""
        group = as_relation(group)
        if isinstance(group, U):
            raise KeyloomError("a universal set can't be aggregated")
        if missing := [k for k in self.primary_key if k not in group.heading]:
            raise KeyloomError(f"the group lacks {missing}")
        assert_compatible(self, group, semantic_check)
        keep = [*self.heading.secondary] if Ellipsis in names else []
        for n in names:
            if n is not Ellipsis and n not in self.heading:
                raise UnknownAttributeError(f"no attribute {n}")
            if n is not Ellipsis and n not in self.primary_key and n not in keep:
                keep.append(n)
        shared = [n for n in self.heading.names if n in group.heading]
        joined = self.df.join(group.df, shared, "inner" if exclude_nonmatching else "left")
        base = Relation(joined, Heading(Attribute(f.name, f.dataType) for f in joined.schema.fields), tracked=False)
        calc = {n: base._column(str(t)) for n, t in named.items()}
        if clash := set(calc) & {*self.primary_key, *keep}:
            raise KeyloomError(f"names clash: {sorted(clash)}")
        kept = [F.any_value(F.col(f"`{n}`")).alias(n) for n in keep]  # one value for each key
        aggregates = [*kept, *(c.alias(n) for n, c in calc.items())]
        keys = [F.col(f"`{k}`") for k in self.primary_key]
        df = joined.groupBy(*keys).agg(*aggregates) if aggregates else joined.select(*keys).distinct()
        heading = Heading([*(self.heading[k] for k in self.primary_key), *(self.heading[n] for n in keep), *(Attribute(n, df.schema[n].dataType, nullable=True) for n in calc)])
        out = self._of(df, heading, unique=True)
        return out

    aggregate = aggr

    # ---- union

    def __add__(self, other: Any) -> Relation:
        """Entities of either; with secondary attributes, which must differ in name, a keyed full join."""
        other = as_relation(other)
        if isinstance(other, U):
            raise KeyloomError("a universal set can't be united")
        if set(self.primary_key) != set(other.primary_key):
            raise KeyloomError(f"the keys differ: {self.primary_key} and {other.primary_key}")
        if both := set(self.heading.secondary) & set(other.heading.secondary):
            raise KeyloomError(f"secondary attributes of one name: {sorted(both)}")
        key = self.primary_key
        if not self.heading.secondary and not other.heading.secondary:
            return self._of(self.df.unionByName(other.df).distinct(), unique=True)
        assert_compatible(self, other)
        df = self.df.join(other.df, key, "full") if key else self.df.crossJoin(other.df)
        loose = [replace(a, nullable=True) for a in [*self.heading, *other.heading] if not a.in_key]
        return self._of(df, Heading([*(self.heading[k] for k in key), *loose]))

    # ---- size

    def __len__(self) -> int:
        """Entities: distinct keys, nulls counted."""
        if not self.primary_key:
            return min(1, self.df.limit(1).count())
        keys = self.df.select(*self.primary_key)
        return keys.count() if self.unique else keys.distinct().count()

    def __bool__(self) -> bool:
        return self.df.limit(1).count() > 0

    def assert_unique_key(self) -> Relation:
        """Check that the key is unique, and return the relation as one whose key is known to be so."""
        if self.df.groupBy(*self.primary_key).count().filter("count > 1").limit(1).count():
            raise KeyloomError(f"the key {self.primary_key} isn't unique")
        return Relation(self._df, self.heading, self._top, self.tracked, True)

    # ---- fetching

    def _fetched(self, names: tuple[str, ...] = (), order_by: Any = None, limit: int | None = None, offset: int | None = None) -> Relation:
        out = self
        if order_by is not None or limit is not None or offset:
            out = out & Top(limit, order_by if order_by is not None else None, offset or 0)
        for n in names:
            if n != "KEY" and n not in self.heading:
                raise UnknownAttributeError(f"no attribute {n}")
        return out

    def _decoded(self, row: dict[str, Any]) -> dict[str, Any]:
        from ..sources.codecs import decode

        return {n: decode(self.heading[n], v) if self.heading[n].codec else v for n, v in row.items()}

    def to_dicts(self, order_by: Any = None, limit: int | None = None, offset: int | None = None) -> list[dict[str, Any]]:
        return [self._decoded(r.asDict(recursive=True)) for r in self._fetched((), order_by, limit, offset).df.collect()]

    def to_pandas(self, order_by: Any = None, limit: int | None = None, offset: int | None = None) -> pd.DataFrame:
        rows = self._fetched((), order_by, limit, offset).df
        out = rows.toPandas()
        for a in self.heading:
            if a.codec:
                out[a.name] = [self._decoded({a.name: v})[a.name] for v in out[a.name]]
        return out.set_index(self.primary_key) if self.primary_key else out

    def to_arrow(self, order_by: Any = None, limit: int | None = None, offset: int | None = None) -> pa.Table:
        return self._fetched((), order_by, limit, offset).df.toArrow()

    def to_polars(self, **how: Any) -> Any:
        try:
            import polars
        except ImportError:
            raise KeyloomError("polars isn't installed") from None
        return polars.from_arrow(self.to_arrow(**how))

    def to_arrays(self, *names: str, include_key: bool = False, order_by: Any = None, limit: int | None = None, offset: int | None = None) -> Any:
        """A structured array of all attributes, or an array for each name; with include_key, the keys' dictionaries first."""
        source = self._fetched(names, order_by, limit, offset)
        if not names:
            rows = source.df.collect()
            kinds = []
            for i, n in enumerate(self.heading.names):
                column = [r[i] for r in rows]
                numeric = isinstance(self.heading[n].dtype, NumericType) and None not in column and not self.heading[n].codec and "decimal" not in self.heading[n].dtype.simpleString()
                kinds.append((n, np.asarray(column).dtype if numeric and column else object))
            out = np.empty(len(rows), dtype=kinds)
            for k, r in enumerate(rows):
                out[k] = tuple(self._decoded(r.asDict(recursive=True)).values())
            return out
        wanted = list(dict.fromkeys([*(self.primary_key if include_key or "KEY" in names else []), *(n for n in names if n != "KEY")]))
        rows = [self._decoded(r.asDict(recursive=True)) for r in source.df.select(*wanted).collect()]
        keys = [{k: r[k] for k in self.primary_key} for r in rows] if include_key or "KEY" in names else []
        out = []
        for n in names:
            if n == "KEY":
                out.append(keys)
                continue
            values = [r[n] for r in rows]
            ragged = any(isinstance(v, (list, tuple, dict, bytes, np.ndarray)) for v in values)
            array = np.empty(len(values), dtype=object) if ragged else np.array(values)
            if ragged:
                array[:] = values
            out.append(array)
        if include_key:
            return (keys, *out)
        return out[0] if len(out) == 1 else tuple(out)

    def keys(self, order_by: Any = None, limit: int | None = None, offset: int | None = None) -> list[dict[str, Any]]:
        source = self._fetched((), order_by, limit, offset)
        return [r.asDict() for r in source.df.select(*self.primary_key).collect()]

    def head(self, limit: int = 25) -> list[dict[str, Any]]:
        return self.to_dicts(order_by="KEY", limit=limit)

    def tail(self, limit: int = 25) -> list[dict[str, Any]]:
        return self.to_dicts(order_by="KEY DESC", limit=limit)[::-1]

    def fetch1(self, *names: str) -> Any:
        """The only entity: a dictionary, or the values named."""
        source = self._fetched(names)
        rows = source.df.limit(2).collect()
        if len(rows) != 1:
            raise KeyloomError(f"fetch1 needs exactly one entity; there are {'none' if not rows else 'more'}")
        row = self._decoded(rows[0].asDict(recursive=True))
        if not names:
            return row
        values = [{k: row[k] for k in self.primary_key} if n == "KEY" else row[n] for n in names]
        return values[0] if len(values) == 1 else tuple(values)

    def fetch(self, *names: str, as_dict: bool | None = None, format: str | None = None, order_by: Any = None, limit: int | None = None, offset: int | None = None) -> Any:
        """Kept for older code: to_dicts, to_pandas or to_arrays by its arguments."""
        how = {"order_by": order_by, "limit": limit, "offset": offset}
        if as_dict:
            rows = self.to_dicts(**how)
            wanted = [k for n in names for k in (self.primary_key if n == "KEY" else [n])]
            return [{n: r[n] for n in wanted} for r in rows] if names else rows
        if format == "frame":
            return self.to_pandas(**how)
        return self.to_arrays(*names, **how)

    def __iter__(self) -> Iterator[dict[str, Any]]:
        for r in self.df.toLocalIterator(prefetchPartitions=True):
            yield self._decoded(r.asDict(recursive=True))

    def cursor(self, as_dict: bool = False) -> Iterator[Any]:
        """Undecoded rows, one after the other."""
        for r in self.df.toLocalIterator():
            yield r.asDict(recursive=True) if as_dict else tuple(r)

    def preview(self, limit: int = 12) -> str:
        names = self.heading.names
        rows = self.df.limit(limit + 1).collect()
        shown = [["=BLOB=" if self.heading[n].codec or isinstance(r[n], (bytes, bytearray)) else str(r[n]) for n in names] for r in rows[:limit]]
        titles = [f"*{n}" if self.heading[n].in_key else n for n in names]
        widths = [max(map(len, column)) for column in zip(titles, *shown, strict=True)]
        line = lambda cells: " ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
        return "\n".join([line(titles), *map(line, shown), *(["..."] if len(rows) > limit else [])])

    def _repr_html_(self, limit: int = 12) -> str:
        from html import escape

        rows = self.df.limit(limit + 1).collect()
        cell = lambda n, v: "=BLOB=" if self.heading[n].codec or isinstance(v, (bytes, bytearray)) else escape(str(v))
        head = "".join(f"<th>{'<b>' * a.in_key}{escape(a.name)}{'</b>' * a.in_key}</th>" for a in self.heading)
        body = "".join("<tr>" + "".join(f"<td>{cell(n, r[n])}</td>" for n in self.heading.names) + "</tr>" for r in rows[:limit])
        return f"<table><tr>{head}</tr>{body}</table>" + "<p>...</p>" * (len(rows) > limit)

    def __repr__(self) -> str:
        return repr(self.heading)


class U:
    """The universal set of named attributes: U('a', 'b') & q are q's distinct values, U('a').aggr(q, n=...) groups by them."""

    def __init__(self, *names: str):
        self.primary_key = list(names)

    def __and__(self, other: Any) -> Relation:
        other = as_relation(other)
        if isinstance(other, U):
            raise KeyloomError("a universal set restricts relations, not another universal set")
        if missing := [n for n in self.primary_key if n not in other.heading]:
            raise UnknownAttributeError(f"no attributes {missing}")
        if not self.primary_key:
            return Relation(other.df.select(F.lit(1).alias("__one")).limit(1).drop("__one"), Heading([]), tracked=other.tracked)
        df = other.df.select(*[f"`{n}`" for n in self.primary_key])
        same = set(self.primary_key) >= set(other.primary_key) and other.unique and other.primary_key
        heading = Heading(replace(other.heading[n], in_key=True) for n in self.primary_key)
        return Relation(df if same else df.distinct(), heading, tracked=other.tracked)

    def aggr(self, group: Any, **named: str) -> Relation:
        group = as_relation(group)
        if missing := [n for n in self.primary_key if n not in group.heading]:
            raise UnknownAttributeError(f"no attributes {missing}")
        calc = {n: group._column(str(t)) for n, t in named.items()}
        keys = [F.col(f"`{n}`") for n in self.primary_key]
        aggregates = [c.alias(n) for n, c in calc.items()]
        source = group.df.groupBy(*keys) if keys else group.df.groupBy()
        df = source.agg(*aggregates) if aggregates else group.df.select(*keys).distinct()
        heading = Heading([*(replace(group.heading[n], in_key=True) for n in self.primary_key), *(Attribute(n, df.schema[n].dataType, nullable=True) for n in calc)])
        return Relation(df.select(*heading.names), heading, tracked=group.tracked)

    aggregate = aggr

    def __mul__(self, other: Any) -> Any:
        raise KeyloomError("a universal set can't be joined; restrict by it instead")

    def __sub__(self, other: Any) -> Any:
        raise KeyloomError("nothing can be taken from a universal set: the rest is infinite")

    join = __mul__
