"""Raw SQL over a catalog's tables, and a cache of query results."""

from __future__ import annotations

import hashlib
import re
from typing import Any

from pyspark.sql import DataFrame

from ..errors import KeyloomError
from ..operators.relation import Relation
from .catalog import Catalog


def query(catalog: Catalog, sql: str, args: Any = None, as_dict: bool = False) -> list[Any]:
    """Rows of a SELECT. Tables are written as `namespace.table`; args fill :names or ? as in spark.sql."""
    return [r.asDict(recursive=True) if as_dict else tuple(r) for r in frame(catalog, sql, args).collect()]


def frame(catalog: Catalog, sql: str, args: Any = None) -> DataFrame:
    if not re.match(r"\s*(select|with|values|show|describe|explain)\b", sql, re.I):
        raise KeyloomError("only queries are run as SQL; rows change through their tables")
    named: dict[str, DataFrame] = {}

    def view(m: re.Match) -> str:
        if m[1] not in catalog.state["tables"]:
            return m[0]
        named[m[1].replace(".", "__")] = catalog.relation(m[1]).df
        return "{" + m[1].replace(".", "__") + "}"

    # quoted text is left as it is
    parts = re.split(r"('(?:[^'\\]|''|\\.)*')", sql)
    text = "".join(p.replace("{", "{{").replace("}", "}}") if k % 2 else re.sub(r"`?\b([a-z]\w*\.[a-z_]\w*)\b`?", view, p) for k, p in enumerate(parts))
    return catalog.spark.sql(text, args, **named) if args is not None else catalog.spark.sql(text, **named)


class QueryCache:
    """Results kept as Parquet under the hash of their plan: the canonical plan in full, and of each leaf, in the plan's order, the
    files that it reads. A changed table has other files, so stale results are never found. Plans with other leaves than files, such
    as local rows, and plans that may give other rows when run again have no name and aren't kept."""

    def __init__(self, catalog: Catalog, folder: str = "cache"):
        self.catalog, self.folder = catalog, folder

    def key(self, relation: Relation) -> str | None:
        spark = self.catalog.spark
        plan = relation.df._jdf.queryExecution().optimizedPlan()
        leaves = plan.collectLeaves()
        files = []
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
                return None
            files.append(sorted(leaf.relation().location().inputFiles()))
        if not plan.deterministic() or "subquery" in plan.toString():
            return None
        name = "spark.sql.debug.maxToStringFields"
        before = spark.conf.get(name)
        try:  # long lists of fields are to be written in full
            spark.conf.set(name, str((1 << 31) - 1))
            text = plan.canonicalized().toString()
        finally:
            spark.conf.set(name, before)
        return hashlib.sha256(repr((text, files, relation.df.schema.json())).encode()).hexdigest()

    def get(self, relation: Relation) -> Relation:
        """The relation, read from its kept result; computed and kept if there is none."""
        key = self.key(relation)
        if key is None:
            return relation
        store, name = self.catalog.store, f"{self.folder}/{key}"
        if not store.exists(f"{name}/_SUCCESS"):
            relation.df.write.mode("overwrite").parquet(store.full(name))
        df = self.catalog.spark.read.schema(relation.df.schema).parquet(store.full(name))
        return Relation(df, relation.heading, tracked=relation.tracked, unique=relation.unique)

    def clear(self) -> None:
        self.catalog.store.delete(self.folder)
