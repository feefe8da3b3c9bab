"""Headings: what a relation knows of its attributes beyond their Spark types."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql.types import DataType, StructType

from ..errors import KeyloomError


@dataclass(frozen=True)
class Attribute:
    name: str
    dtype: DataType
    in_key: bool = False
    nullable: bool = False
    default: Any = None
    has_default: bool = False
    comment: str = ""
    lineage: str | None = None
    declared: str = ""  # the declared type, such as enum('a','b') or <blob>
    codec: str | None = None
    store: str | None = None
    json: bool = False
    autoincrement: bool = False
    enum: tuple[str, ...] = ()

    @property
    def hidden(self) -> bool:
        return self.name.startswith("_")


class Heading:
    """An ordered set of attributes; immutable."""

    def __init__(self, attributes: Iterable[Attribute]):
        self._all = {a.name: a for a in attributes}
        self.attributes = {n: a for n, a in self._all.items() if not a.hidden}

    @classmethod
    def of(cls, schema: StructType, key: Iterable[str], origin: str | None = None) -> Heading:
        """The heading of a DataFrame with this primary key. origin: lineage of key attributes begins with it."""
        key = list(key)
        if missing := [k for k in key if k not in schema.names]:
            raise KeyloomError(f"no such columns: {missing}")
        by_name = {f.name: f for f in schema.fields}
        order = [*key, *(n for n in schema.names if n not in key)]
        return cls(Attribute(n, by_name[n].dataType, in_key=n in key, nullable=n not in key and by_name[n].nullable, lineage=f"{origin}.{n}" if origin and n in key else None) for n in order)

    def __getitem__(self, name: str) -> Attribute:
        return self._all[name]

    def __contains__(self, name: str) -> bool:
        return name in self.attributes

    def __iter__(self) -> Iterator[Attribute]:
        return iter(self.attributes.values())

    @property
    def every(self) -> list[Attribute]:
        """All attributes, hidden ones too."""
        return list(self._all.values())

    @property
    def names(self) -> list[str]:
        return list(self.attributes)

    @property
    def primary_key(self) -> list[str]:
        return [a.name for a in self if a.in_key]

    @property
    def secondary(self) -> list[str]:
        return [a.name for a in self if not a.in_key]

    def determines(self, other: Heading) -> bool:
        """Whether each of self's entities has at most one of other's: other's key is among self's attributes."""
        return all(k in self.attributes for k in other.primary_key)

    def with_attributes(self, **changed: Attribute) -> Heading:
        return Heading(changed.get(a.name, a) for a in self)

    def with_key(self, key: Iterable[str]) -> Heading:
        key = list(key)
        return Heading([*(replace(self[k], in_key=True) for k in key), *(replace(a, in_key=False) for a in self if a.name not in key)])

    def join(self, other: Heading, keep_both: bool = False) -> Heading:
        """The heading of a join. Its key is that of the side that determines the other, the left one if both do, and
        both keys together if neither does (or keep_both, when a left join may leave the right key null)."""
        left, right = self, other
        if not keep_both and not left.determines(right) and right.determines(left):
            left, right = right, left
        if not keep_both and left.determines(right):
            return Heading([*left, *(replace(a, in_key=False) for a in right if a.name not in left)])
        key = [*left.primary_key, *(k for k in right.primary_key if k not in left.primary_key)]
        pool = {a.name: a for a in [*right, *left]}
        rest = [n for n in [*left.names, *right.names] if n not in key]
        return Heading([*(replace(pool[k], in_key=True) for k in key), *(replace(pool[n], in_key=False) for n in dict.fromkeys(rest))])

    def __repr__(self) -> str:
        line = lambda a: f"{a.name}: {a.declared or a.dtype.simpleString()}"
        return "\n".join([*(line(a) for a in self if a.in_key), "---", *(line(a) for a in self if not a.in_key)])
