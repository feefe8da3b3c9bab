"""Declared tables: classes whose definition is text and whose instances, or the classes themselves, are relations."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace
from typing import Any

from pyspark.sql import functions as F

from ..errors import IntegrityError, KeyloomError, MissingError
from ..operators.relation import Relation
from ..operators.restriction import Not
from ..plans.graph import Graph, Restricted
from . import inserts
from .catalog import Catalog
from .definition import Definition, describe, parse, parse_attribute

#: What a class hands on to its relation.
DELEGATED = ("proj", "join", "extend", "aggr", "aggregate", "to_dicts", "to_pandas", "to_polars", "to_arrow", "to_arrays", "keys", "head", "tail", "fetch", "fetch1", "preview", "cursor")


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


class TableMeta(type):
    """Classes act as relations: A & x, A * B, A.proj()."""

    def __getattr__(cls, name: str) -> Any:
        if name in DELEGATED or name in {"heading", "primary_key", "df"}:
            return getattr(cls().as_relation(), name)
        raise AttributeError(name)

    def __and__(cls, x: Any) -> Any:
        return cls() & x

    def __sub__(cls, x: Any) -> Any:
        return cls() - x

    def __mul__(cls, x: Any) -> Any:
        return cls() * x

    def __add__(cls, x: Any) -> Any:
        return cls() + x

    def __neg__(cls) -> Not:
        return -cls()

    def __len__(cls) -> int:
        return len(cls())

    def __bool__(cls) -> bool:
        return True

    def __iter__(cls) -> Iterator[dict]:
        return iter(cls())

    def __contains__(cls, x: Any) -> bool:
        return x in cls()


class Table(metaclass=TableMeta):
    """A stored table, possibly restricted."""

    tier = "manual"
    definition: str = ""
    contents: Any = ()
    catalog: Catalog
    full_name: str
    restriction: Relation | None = None

    # ---- as a relation

    def as_relation(self) -> Relation:
        if not hasattr(self, "full_name"):
            raise KeyloomError(f"{type(self).__name__} isn't declared in a schema")
        return self.restriction if self.restriction is not None else self.catalog.relation(self.full_name)

    def __getattr__(self, name: str) -> Any:
        if name in DELEGATED or name in {"heading", "primary_key", "df"}:
            return getattr(self.as_relation(), name)
        raise AttributeError(f"{type(self).__name__} has no {name}")

    def _restricted(self, relation: Relation) -> Table:
        out = type(self).__new__(type(self))
        out.__dict__.update(self.__dict__)
        out.restriction = relation
        return out

    def restrict(self, condition: Any, semantic_check: bool = True) -> Table:
        return self._restricted(self.as_relation().restrict(condition, semantic_check))

    def __and__(self, x: Any) -> Table:
        return self.restrict(x)

    def __sub__(self, x: Any) -> Table:
        return self.restrict(Not(x))

    def __mul__(self, x: Any) -> Relation:
        return self.as_relation() * x

    def __add__(self, x: Any) -> Relation:
        return self.as_relation() + x

    def __neg__(self) -> Not:
        return Not(self.as_relation())

    def __len__(self) -> int:
        return len(self.as_relation())

    def __bool__(self) -> bool:
        return bool(self.as_relation())

    def __iter__(self) -> Iterator[dict]:
        return iter(self.as_relation())

    def __contains__(self, x: Any) -> bool:
        return x in self.as_relation()

    def __repr__(self) -> str:
        return self.as_relation().preview()

    def _whole(self, doing: str) -> None:
        if self.restriction is not None:
            raise KeyloomError(f"a restricted table can't be {doing}")

    # ---- rows

    def insert(self, rows: Any, replace: bool = False, skip_duplicates: bool = False, ignore_extra_fields: bool = False, chunk_size: int | None = None, allow_direct_insert: bool = False) -> None:
        if self.tier in {"imported", "computed"} and not allow_direct_insert and not getattr(type(self), "_making", False):
            raise KeyloomError(f"{self.full_name} is filled by populate()")
        if hasattr(rows, "as_relation"):
            rows = rows() if isinstance(rows, type) else rows
            rows = rows.as_relation()
        inserts.insert(self.catalog, self.full_name, rows, replace, skip_duplicates, ignore_extra_fields, chunk_size)

    def insert1(self, row: Any, **how: Any) -> None:
        self.insert([row], **how)

    def insert_dataframe(self, df: Any, index_as_pk: bool | None = None, **how: Any) -> None:
        """A pandas DataFrame. Its index is the key if it is named so, or as index_as_pk says."""
        key = self.catalog.definition(self.full_name).heading.primary_key
        names = list(df.index.names)
        if index_as_pk is None:
            index_as_pk = names != [None] and set(names) <= set(key)
        if index_as_pk and list(names) != key:
            raise KeyloomError(f"the index {names} isn't the key {key}")
        self.insert(df.reset_index() if index_as_pk else df.reset_index(drop=True), **how)

    def validate(self, rows: Any, ignore_extra_fields: bool = False) -> inserts.Validation:
        """What insert would object to in the rows themselves, without inserting."""
        attributes = [a for a in self.catalog.definition(self.full_name).heading.every]
        plain = [replace_codec(a) for a in attributes]
        return inserts.check_rows(inserts.records(rows, [a.name for a in attributes if not a.hidden]), plain, ignore_extra_fields)[1]

    def update1(self, row: dict[str, Any]) -> None:
        """Change secondary attributes of one entity, which must exist; None sets the default."""
        self._whole("updated")
        d = self.catalog.definition(self.full_name)
        key = d.heading.primary_key
        if missing := [k for k in key if k not in row]:
            raise KeyloomError(f"update1 needs the whole key; {missing} is missing")
        if unknown := [n for n in row if n not in d.heading]:
            raise KeyloomError(f"no such attributes: {unknown}")
        self.catalog.atomic(lambda: self._update(d, key, row))

    def _update(self, d: Definition, key: list[str], row: dict[str, Any]) -> None:
        where = {k: row[k] for k in key}
        if len(self.catalog.relation(self.full_name) & where) != 1:
            raise KeyloomError(f"update1 needs one entity {where}")
        changed = [d.heading[n] for n in row if n not in key]
        stored, found = inserts.check_rows([{n: row[n] for n in row if n not in key}], changed, table=self.full_name)
        if not found:
            raise KeyloomError(found.summary())
        df, hit = self.catalog.rows(self.full_name), self._condition(d, where)
        new = df.filter(hit)
        for a in changed:
            new = new.withColumn(a.name, F.lit(stored[0][a.name]).cast(a.dtype))
        rest = df.filter(~hit)
        inserts.violations(self.catalog, self.full_name, new, rest)
        self.catalog.rewrite(self.full_name, rest.unionByName(new))

    def _condition(self, d: Definition, where: dict[str, Any]) -> Any:
        out = F.lit(True)
        for n, v in where.items():
            out = out & (F.col(n) == F.lit(inserts.converted(d.heading[n], v)).cast(d.heading[n].dtype))
        return out

    # ---- deletion

    def delete_quick(self) -> int:
        """Delete the entities, which nothing may depend on; how many."""
        return self.catalog.atomic(self._delete)

    def _delete(self, checked: bool = False) -> int:
        """checked: what depends on them is known to be gone."""
        table = self.full_name
        for e in [] if checked else Graph(self.catalog).every:
            if e.parent == table and self.restriction is None and e.child == table:
                continue  # all go, and what refers to them with them
            if e.parent == table:
                gone = self.as_relation().df.select(*[F.col(p).alias(c) for c, p in e.columns])
                if hit := self.catalog.rows(e.child).join(gone, [c for c, _ in e.columns], "left_semi").limit(1).collect():
                    if e.child != table or not (self.as_relation() & {k: hit[0][k] for k in self.primary_key}):
                        raise IntegrityError(f"{e.child} depends on entities of {table}; delete takes both")
        if self.restriction is None:
            n = len(self)
            self.catalog.rewrite(table, self.catalog.rows(table).limit(0))
            return n
        key = [a.name for a in self.catalog.definition(table).heading.every if a.in_key and not a.hidden]
        gone = self.as_relation().df.select(*key) if key else self.as_relation().df
        n = len(self.as_relation())
        rows = self.catalog.rows(table)
        self.catalog.rewrite(table, rows.join(gone, key, "left_anti") if key else rows.limit(0 if n else 1))
        return n

    def delete(self, transaction: bool = True, prompt: Callable[[dict[str, int]], bool] | None = None, part_integrity: str = "enforce") -> int:
        """Delete the entities and all that depends on them, at once; how many of this table. prompt sees the counts and may
        refuse."""

        def cascade() -> int:
            graph = Graph(self.catalog)
            seed = self.catalog.relation(self.full_name)
            if self.restriction is not None:  # as the transaction sees them
                seed = seed.restrict(self.restriction.proj(), semantic_check=False)
            found = graph.cascade(self.full_name, seed, part_integrity)
            counts = found.counts()
            if prompt is not None and not prompt(counts):
                return 0
            for t in reversed([t for t in graph.sorted() if t in found]):
                if counts[t]:
                    FreeTable(self.catalog, t)._restricted(found[t])._delete(checked=True)
            return counts[self.full_name]

        if transaction:
            return self.catalog.atomic(cascade)
        return cascade()

    def drop_quick(self) -> None:
        self._whole("dropped")
        if children := [c for c in Graph(self.catalog).children(self.full_name) if c != self.full_name]:
            raise IntegrityError(f"{children} depend on {self.full_name}")
        self.catalog.drop(self.full_name)

    def drop(self, part_integrity: str = "enforce") -> list[str]:
        """Drop the table with all that depend on it; their names."""
        self._whole("dropped")
        graph = Graph(self.catalog)
        gone = graph.descendants(self.full_name)
        lone = [t for t in gone if graph.master(t) and graph.master(t) not in gone]
        if lone and part_integrity == "enforce":
            raise IntegrityError(f"drop the masters of {lone} first")
        with self.catalog.change():
            for t in reversed(gone):
                self.catalog.drop(t)
        return gone

    # ---- definition

    def describe(self) -> str:
        own = self.full_name.split(".")[0]
        names = self.catalog.state.get("classes", {})
        return describe(self.catalog.definition(self.full_name), lambda p: names.get(p, p.split(".", 1)[1] if p.startswith(f"{own}.") else p))

    def alter(self, definition: str) -> None:
        """Change the comment and secondary attributes. A comment that begins with {old} renames the attribute old, whose values
        stay, whatever its type. The key, foreign keys and indexes can't change."""
        self._whole("altered")
        self.catalog.atomic(lambda: self._alter(definition))

    def _alter(self, definition: str) -> None:
        old = self.catalog.definition(self.full_name)
        new = parse(definition, resolver(self.catalog, self.full_name.split(".")[0], {}), self.full_name)
        if [(a.name, a.declared) for a in new.heading.every if a.in_key] != [(a.name, a.declared) for a in old.heading.every if a.in_key]:
            raise KeyloomError("alter can't change the key")
        if new.foreign_keys != old.foreign_keys or new.indexes != old.indexes:
            raise KeyloomError("alter can't change foreign keys or indexes")
        df, columns, attributes = self.catalog.rows(self.full_name), [], []
        for a in new.heading.every:
            source = a.name
            if m := re.match(r"\{(\w+)\}\s*", a.comment):
                source, a = m[1], replace(a, comment=a.comment[m.end() :])
                if source not in old.heading:
                    raise KeyloomError(f"no attribute {source} to rename")
            if source in df.columns:
                columns.append(F.col(source).cast(a.dtype).alias(a.name))
            elif a.has_default:
                columns.append(F.lit(inserts.default_of(a)).cast(a.dtype).alias(a.name))
            else:
                raise KeyloomError(f"the new attribute {a.name} needs a default")
            attributes.append(a)
        new.heading = type(new.heading)(attributes)
        with self.catalog.change():
            filled = bool(self.catalog.info(self.full_name)["parts"])
            self.catalog.redefine(self.full_name, new)
            if filled:
                self.catalog.rewrite(self.full_name, df.select(*columns))

    # ---- the graph

    def parents(self, primary: bool | None = None) -> list[str]:
        return Graph(self.catalog).parents(self.full_name, primary)

    def children(self, primary: bool | None = None) -> list[str]:
        return Graph(self.catalog).children(self.full_name, primary)

    def ancestors(self) -> list[str]:
        return Graph(self.catalog).ancestors(self.full_name)

    def descendants(self) -> list[str]:
        return Graph(self.catalog).descendants(self.full_name)

    def parts(self) -> list[str]:
        return Graph(self.catalog).parts(self.full_name)

    def trace(self) -> Restricted:
        return Graph(self.catalog).trace(self.full_name, self.as_relation())

    # ---- objects first, then the row

    @contextmanager
    def staged_insert1(self) -> Iterator[Staged]:
        """Write objects to a store bit by bit, then insert the row; if either fails, what was written is removed."""
        stage = Staged(self)
        try:
            yield stage
            self.insert1(stage.rec)
        except BaseException:
            stage.discard()
            raise


def replace_codec(a: Any) -> Any:
    """An attribute that validate() takes as present without encoding it."""
    return replace(a, codec=None, nullable=True) if a.codec else a


class Staged:
    """A row in the making: rec takes its values, write() puts an object into the store of a <filepath@> attribute."""

    def __init__(self, table: Table):
        self.table, self.rec, self._written = table, {}, []

    def write(self, field: str, name: str, data: bytes) -> None:
        from .codecs import store_of

        a = self.table.catalog.definition(self.table.full_name).heading[field]
        store_of(a.store).write(name, data)
        self._written.append((a.store, name))
        self.rec[field] = name

    def discard(self) -> None:
        from .codecs import store_of

        for store, name in self._written:
            store_of(store).delete(name)


class Manual(Table):
    tier = "manual"


class Lookup(Table):
    tier = "lookup"


class Part(Table):
    """A table declared inside its master's class; `-> master` refers to the master."""

    tier = "part"
    master: type[Table]


class FreeTable(Table):
    """A table known by its name only."""

    def __init__(self, catalog: Catalog, full_name: str):
        self.catalog, self.full_name = catalog, full_name
        self.tier = catalog.tier(full_name)

    def insert(self, rows: Any, **how: Any) -> None:
        super().insert(rows, **{"allow_direct_insert": True, **how})


def resolver(catalog: Catalog, namespace: str, context: dict[str, Any]) -> Callable:
    """Finds what a foreign key refers to: a class in context, or a table's name."""

    def resolve(reference: str) -> tuple[str, Any]:
        at: Any = None
        for k, word in enumerate(reference.split(".")):
            at = context.get(word) if not k else getattr(at, word, None)
            if at is None:
                break
        if isinstance(at, type) and issubclass(at, Table) and hasattr(at, "full_name"):
            return at.full_name, catalog.definition(at.full_name).heading
        for name in (reference, f"{namespace}.{reference}", f"{namespace}.{snake(reference)}"):
            if name in catalog.state["tables"]:
                return name, catalog.definition(name).heading
        raise MissingError(f"nothing to refer to by {reference}")

    return resolve


class Schema:
    """A namespace of a catalog; as a decorator it declares classes."""

    def __init__(self, catalog: Catalog, name: str, context: dict[str, Any] | None = None):
        if not re.fullmatch(r"[a-z]\w*", name):
            raise KeyloomError(f"{name!r} is no name for a namespace")
        self.catalog, self.name, self.context = catalog, name, dict(context or {})

    def __call__(self, cls: type[Table], context: dict[str, Any] | None = None) -> type[Table]:
        frame = inspect.currentframe().f_back
        known = {**frame.f_globals, **frame.f_locals, **self.context, **(context or {})}
        self._declare(cls, snake(cls.__name__), known, None)
        for name, part in list(vars(cls).items()):
            if isinstance(part, type) and issubclass(part, Part):
                part.master = cls
                self._declare(part, f"{snake(cls.__name__)}__{snake(name)}", {**known, **{n: x for n, x in vars(cls).items() if isinstance(x, type)}, "master": cls, cls.__name__: cls}, cls.full_name)
        self.context[cls.__name__] = cls
        if cls.tier == "lookup" and (rows := list(cls.contents() if callable(cls.contents) else cls.contents)):
            if len(rows) > len(cls()):
                cls().insert(rows, skip_duplicates=True)
        return cls

    def _declare(self, cls: type[Table], name: str, context: dict[str, Any], master: str | None) -> None:
        cls.catalog, cls.full_name = self.catalog, f"{self.name}.{name}"
        if cls.full_name in self.catalog.state["tables"]:
            return
        d = parse(inspect.cleandoc(cls.definition), resolver(self.catalog, self.name, context), cls.full_name)
        if cls.tier in {"imported", "computed"}:
            foreign = {c for f in d.foreign_keys if f.primary for c in f.columns}
            if own := [a.name for a in d.heading if a.in_key and a.name not in foreign]:
                if not getattr(cls, "allow_own_key", False):
                    raise KeyloomError(f"the key of {cls.full_name} must come from foreign keys; {own} doesn't")
        self.catalog.declare(cls.full_name, d, cls.tier, master)

    def tables(self) -> list[str]:
        return self.catalog.tables(self.name)

    def free(self, name: str) -> FreeTable:
        return FreeTable(self.catalog, name if "." in name else f"{self.name}.{name}")

    def classes(self) -> dict[str, type[Table]]:
        """Classes for the stored tables, by the name that a class of theirs would have."""
        out: dict[str, type[Table]] = {}
        for t in Graph(self.catalog).sorted():
            if t.split(".")[0] == self.name:
                base = {"lookup": Lookup, "part": Part}.get(self.catalog.tier(t), Manual)
                title = "".join(w.capitalize() for w in t.split(".")[1].replace("__", "_").split("_"))
                out[title] = type(title, (base,), {"catalog": self.catalog, "full_name": t, "tier": self.catalog.tier(t)})
        return out

    def drop(self) -> None:
        """Drop all tables of the namespace; others must not depend on them."""
        graph = Graph(self.catalog)
        own = [t for t in graph.sorted() if t in self.tables()]
        if outside := [c for t in own for c in graph.children(t) if c not in own]:
            raise IntegrityError(f"{outside} depend on {self.name}")
        with self.catalog.change():
            for t in reversed(own):
                self.catalog.drop(t)


__all__ = ["FreeTable", "Lookup", "Manual", "Part", "Schema", "Table", "parse_attribute"]
