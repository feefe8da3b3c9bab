"""Tables that fill themselves: populate() computes the keys of key_source that the table lacks."""

from __future__ import annotations

import contextlib
import random
import time
import traceback
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateError, KeyloomError
from ..operators.relation import Relation
from ..operators.restriction import AndList
from ..plans.graph import Graph, Restricted
from ..sources.codecs import pack
from ..sources.tables import Table
from .jobs import Jobs


class AutoPopulate(Table):
    """make(self, key) computes one key and inserts its results; or make_fetch(key), make_compute(key, *fetched) and
    make_insert(key, *computed), of which the middle one runs outside of the transaction; or make_frame(self, keys), which takes a
    DataFrame of all keys that wait and returns the rows for them, computed by Spark as one job."""

    @property
    def key_source(self) -> Relation:
        """The join of what the key's foreign keys refer to, under this table's names."""
        parents = [f for f in self.catalog.definition(self.full_name).foreign_keys if f.primary]
        if not parents:
            raise KeyloomError(f"{self.full_name} has no foreign key in its key, so it needs a key_source of its own")
        out: Relation | None = None
        for f in parents:
            r = self.catalog.relation(f.parent)
            r = r.proj(**{c: p for c, p in f.columns.items() if c != p}) if f.renamed else r.proj()
            out = r if out is None else out * r
        return out

    def _source(self) -> Relation:
        source = self.key_source
        source = source() if isinstance(source, type) else source
        source = source.as_relation()
        key = self.catalog.definition(self.full_name).heading.primary_key
        if not all(k in key or k in source.heading for k in source.primary_key):
            raise KeyloomError("key_source doesn't fit the key")
        return source

    def todo(self, *restrictions: Any) -> Relation:
        """Keys without a result: an antijoin on the key alone, whatever other names both sides share."""
        source = self._source() & AndList(restrictions)
        return source.proj().restrict(-(self.catalog.relation(self.full_name).proj()), semantic_check=False)

    @property
    def jobs(self) -> Jobs:
        return Jobs(self)

    @property
    def upstream(self) -> Restricted:
        """Within make(): the ancestors' entities that the key at hand depends on."""
        key = getattr(type(self), "_key", None)
        if key is None:
            raise KeyloomError("upstream is known within make() only")
        graph = Graph(self.catalog)
        found: dict[str, Relation] = {}
        for f in self.catalog.definition(self.full_name).foreign_keys:
            where = {p: key[c] for c, p in f.columns.items() if c in key}
            if where:
                for t, r in graph.trace(f.parent, where).relations.items():
                    found[t] = self.catalog.relation(t).restrict([found[t].proj(), r.proj()], semantic_check=False) if t in found else r
        return Restricted(graph, found)

    def make(self, key: dict[str, Any], **more: Any) -> None:
        raise NotImplementedError

    def populate(self, *restrictions: Any, limit: int | None = None, max_calls: int | None = None, suppress_errors: bool = False, return_exception_objects: bool = False, reserve_jobs: bool = False, order: str = "original", make_kwargs: dict[str, Any] | None = None, keep_completed: bool = False) -> dict[str, Any]:
        """Compute what is missing: success_count and error_list of (key, error)."""
        if self.catalog.in_transaction:
            raise KeyloomError("populate can't run within a transaction")
        self._whole("populated")
        if order not in {"original", "reverse", "random"}:
            raise KeyloomError(f"unknown order {order!r}")
        if hasattr(type(self), "make_frame"):
            return self._populate_frame(restrictions)
        if reserve_jobs:
            self.jobs.refresh(*restrictions)
            wanted = {self.jobs._name(k) for k in self.todo(*restrictions).keys()} if restrictions else None
            keys = [k for k in self.jobs.waiting() if wanted is None or self.jobs._name(k) in wanted]
        else:
            keys = self.todo(*restrictions).keys(limit=limit)
        if order == "reverse":
            keys.reverse()
        elif order == "random":
            random.shuffle(keys)
        if max_calls is not None or limit is not None:
            keys = keys[: min(x for x in (max_calls, limit) if x is not None)]
        done, errors = 0, []
        for key in keys:
            if reserve_jobs and not self.jobs.reserve(key):
                continue
            began = time.time()
            try:
                done += self._one(key, make_kwargs or {})
                if reserve_jobs:
                    self.jobs.complete(key, time.time() - began, keep_completed)
            except Exception as e:
                text = f"{type(e).__name__}{f': {e}' if str(e) else ''}"
                if reserve_jobs:
                    self.jobs.error(key, text, traceback.format_exc())
                if not suppress_errors:
                    raise
                errors.append((key, e if return_exception_objects else text))
        return {"success_count": done, "error_list": errors}

    @contextlib.contextmanager
    def _gate(self, key: dict[str, Any]):
        cls = type(self)
        tables = [cls, *(x for x in vars(cls).values() if isinstance(x, type) and issubclass(x, Table))]
        for t in tables:
            t._making = True
        cls._key = key
        try:
            yield
        finally:
            for t in tables:
                t._making = False
            cls._key = None

    def _one(self, key: dict[str, Any], more: dict[str, Any]) -> int:
        target = lambda: self.catalog.relation(self.full_name)
        if target() & key:
            return 0
        parts = hasattr(type(self), "make_fetch")
        with self._gate(key):
            if parts:
                fetched = self.make_fetch(dict(key), **more)
                computed = self.make_compute(dict(key), *fetched)
            with self.catalog.transaction():
                if target() & key:
                    return 0
                if parts:
                    if pack(list(self.make_fetch(dict(key), **more))) != pack(list(fetched)):
                        raise KeyloomError(f"what {key} is computed from has changed meanwhile")
                    self.make_insert(dict(key), *computed)
                else:
                    self.make(dict(key), **more)
        return 1

    def _populate_frame(self, restrictions: tuple) -> dict[str, Any]:
        todo = self.todo(*restrictions).df
        with self._gate({}):
            rows: DataFrame = self.make_frame(todo)
            before = len(self.catalog.relation(self.full_name))
            try:
                with self.catalog.transaction():
                    self.insert(rows)
            except DuplicateError as e:
                raise KeyloomError(f"make_frame gave a key twice: {e}") from None
        return {"success_count": len(self.catalog.relation(self.full_name)) - before, "error_list": []}

    def progress(self, *restrictions: Any) -> tuple[int, int]:
        """(remaining, total), counted in one job."""
        source = (self._source() & AndList(restrictions)).proj()
        key = [k for k in source.primary_key if k in self.catalog.definition(self.full_name).heading]
        there = self.catalog.relation(self.full_name).df.select(*key).distinct().withColumn("__there", F.lit(True))
        keys = source.df.distinct() if not source.unique else source.df
        total, left = keys.join(there, key, "left").agg(F.count("*"), F.count_if(F.col("__there").isNull())).first()
        return left, total


class Imported(AutoPopulate):
    tier = "imported"


class Computed(AutoPopulate):
    tier = "computed"
