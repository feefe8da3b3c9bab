"""Garbage collection: objects of a store that no row refers to."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog
from .codecs import chain, store_of


@dataclass
class Found:
    unused: list[str] = field(default_factory=list)
    used: int = 0
    deleted: list[str] = field(default_factory=list)


def references(catalog: Catalog, store: str) -> DataFrame | None:
    """The paths that rows of all tables refer to in a store."""
    out: DataFrame | None = None
    for t in catalog.tables():
        for a in catalog.definition(t).heading.every:
            if a.codec and a.store is not None and chain(a.codec, True)[1] == "json" and store_of(a.store) is store_of(store):
                paths = catalog.rows(t).select(F.get_json_object(a.name, "$.path").alias("path")).filter("path is not null")
                out = paths if out is None else out.unionByName(paths)
    return out


def scan(catalog: Catalog, store: str) -> Found:
    """What a collection would delete: an antijoin of the store's own objects and the references to them. Only hashed objects and
    those under a table's name are the store's own; other files are left alone. An error while reading references stops it."""
    own = [n for n in store_of(store).files("") if n.startswith("_hash/") or n.split("/")[0] in catalog.tables()]
    if not own:
        return Found()
    stored = catalog.spark.createDataFrame([(n,) for n in own], "path string")
    used = references(catalog, store)
    unused = stored if used is None else stored.join(used, "path", "left_anti")
    gone = sorted(r["path"] for r in unused.collect())
    return Found(gone, len(own) - len(gone))


def collect(catalog: Catalog, store: str, dry_run: bool = True) -> Found:
    found = scan(catalog, store)
    if not dry_run:
        for n in found.unused:
            store_of(store).delete(n)
        found.deleted = found.unused
    return found


def report(found: Found) -> str:
    return json.dumps({"used": found.used, "unused": len(found.unused), "deleted": len(found.deleted)})
