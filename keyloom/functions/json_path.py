"""JSON paths: attr.path.to[0].x:type names a value within a JSON attribute.

Untyped values are text. A JSON null, a missing key and an SQL null are all null. A typed value that doesn't fit its type is
null. Containers compare by content, whatever their spacing.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import spark_type

PATH = re.compile(r"^(?P<attr>[a-z_]\w*)(?P<path>(?:\.[A-Za-z_]\w*|\.\*|\[\d+\]|\[\*\])+)(?::(?P<type>[\w(,\s)]+))?$")


def parse(text: str) -> tuple[str, str, str | None] | None:
    """(attribute, path beginning with $, type) or None if text is no JSON path."""
    if m := PATH.match(text.strip()):
        return m["attr"], "$" + m["path"], m["type"]
    return None


def extract(column: Column, path: str, kind: str | None = None) -> Column:
    if not kind:
        return F.get_json_object(column, path)
    return F.try_variant_get(F.try_parse_json(column), path, spark_type(kind))


def equals(column: Column, path: str, kind: str | None, value: object) -> Column:
    """Equality of the value at path with a Python value; None matches null."""
    found = extract(column, path, kind)
    if value is None:
        return found.isNull()
    if isinstance(value, (dict, list, tuple)):
        return F.to_json(F.try_parse_json(F.get_json_object(column, path))) == F.to_json(F.parse_json(F.lit(json.dumps(value))))
    if isinstance(value, bool) and kind and spark_type(kind) != "boolean":
        value = int(value)
    if kind is None:
        value = json.dumps(value) if isinstance(value, bool) else str(value)
    return found == F.lit(value)
