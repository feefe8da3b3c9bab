"""The table definition language.

  # comment of the table
  -> Parent                      foreign key: takes the parent's key, renamed if Parent.proj(new='old')
  name [= default] : type  # comment
  ---                            the key ends
  -> [nullable, unique] Other
  [unique] index (a, b)
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from ..errors import KeyloomError
from ..plans.heading import Attribute, Heading
from .codecs import chain

ATTRIBUTE = re.compile(r"^(?P<name>[a-z][a-z0-9_]*)\s*(?:=\s*(?P<default>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^:'\"]+?))?\s*:\s*(?P<type>[^#]+?)\s*(?:#\s*(?P<comment>.*))?$")
FOREIGN = re.compile(r"^->\s*(?:\[(?P<options>[^\]]*)\])?\s*(?P<ref>[\w.]+?)(?:\.proj\((?P<proj>.*)\))?\s*(?:#.*)?$")
INDEX = re.compile(r"^(?P<unique>unique\s+)?index\s*\((?P<names>.*)\)\s*(?:#.*)?$", re.I)
PLAIN: dict[str, T.DataType] = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "date": T.DateType(), "json": T.StringType(), "uuid": T.StringType(), "bytes": T.BinaryType(),
    "tinyint": T.ByteType(), "smallint": T.ShortType(), "mediumint": T.IntegerType(), "int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(),
    "serial": T.IntegerType(), "bigserial": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "real": T.DoubleType(), "year": T.ShortType(),
    "datetime": T.TimestampNTZType(), "timestamp": T.TimestampNTZType(), "time": T.StringType(), "text": T.StringType(), "tinytext": T.StringType(),
    "mediumtext": T.StringType(), "longtext": T.StringType(), "blob": T.BinaryType(), "tinyblob": T.BinaryType(), "mediumblob": T.BinaryType(), "longblob": T.BinaryType(),
}
WIDER = {"tinyint": T.ShortType(), "smallint": T.IntegerType(), "mediumint": T.IntegerType(), "int": T.LongType(), "integer": T.LongType(), "bigint": T.DecimalType(20, 0)}


@dataclass(frozen=True)
class ForeignKey:
    parent: str  # namespace.table
    columns: dict[str, str]  # child attribute: parent attribute
    nullable: bool = False
    unique: bool = False
    primary: bool = False

    @property
    def renamed(self) -> bool:
        return any(a != b for a, b in self.columns.items())


@dataclass
class Definition:
    comment: str
    heading: Heading
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    indexes: list[tuple[tuple[str, ...], bool]] = field(default_factory=list)


def parse_type(text: str) -> dict[str, Any]:
    """The fields of an Attribute that a declared type decides."""
    text = text.strip()
    if m := re.fullmatch(r"<(\w+)(@(\w*))?>", text):
        _, kind = chain(m[1], m[2] is not None)
        return {"dtype": T.StringType() if kind == "json" else T.BinaryType(), "codec": m[1], "store": m[3] if m[2] else None, "declared": text}
    low = text.lower()
    if m := re.fullmatch(r"enum\s*\((.*)\)", text, re.I | re.S):
        return {"dtype": T.StringType(), "enum": tuple(ast.literal_eval(f"({m[1]},)")), "declared": text}
    auto = "auto_increment" in low or low.endswith("serial")
    unsigned = " unsigned" in f" {low}"
    base = re.sub(r"\s*\b(unsigned|auto_increment)\b", "", low).strip()
    if m := re.fullmatch(r"(?:decimal|numeric)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", base):
        return {"dtype": T.DecimalType(int(m[1]), int(m[2] or 0)), "declared": text}
    if base in {"decimal", "numeric"}:
        return {"dtype": T.DecimalType(10, 0), "declared": text}
    if m := re.fullmatch(r"(char|varchar)\s*\(\s*(\d+)\s*\)", base):
        return {"dtype": T.StringType(), "declared": text}
    name = re.sub(r"\s*\(.*\)$", "", base)
    if name not in PLAIN:
        raise KeyloomError(f"unknown type {text!r}")
    return {"dtype": WIDER.get(name, PLAIN[name]) if unsigned else PLAIN[name], "json": name == "json", "autoincrement": auto, "declared": text}


def length_of(declared: str) -> int | None:
    m = re.fullmatch(r"(?:var)?char\s*\(\s*(\d+)\s*\)", declared.strip().lower())
    return int(m[1]) if m else None


def parse_attribute(line: str, in_key: bool) -> Attribute:
    m = ATTRIBUTE.match(line)
    if not m:
        raise KeyloomError(f"can't read the line {line!r}")
    kind, default, has = parse_type(m["type"]), m["default"], m["default"] is not None
    nullable = False
    if has:
        text = default.strip()
        if text.lower() == "null":
            if in_key:
                raise KeyloomError(f"a key attribute can't be null: {line!r}")
            default, nullable = None, True
        elif re.fullmatch(r"current_timestamp(\(\d*\))?|now\(\)", text.lower()):
            default = "CURRENT_TIMESTAMP"
        elif text[:1] in "'\"":
            default = ast.literal_eval(text)
        else:
            default = text
    if kind.get("codec") and in_key:
        raise KeyloomError(f"an encoded attribute can't be in the key: {line!r}")
    if kind.get("json") and in_key:
        raise KeyloomError(f"a json attribute can't be in the key: {line!r}")
    return Attribute(m["name"], in_key=in_key, nullable=nullable, default=default, has_default=has, comment=(m["comment"] or "").strip(), **kind)


def parse(text: str, resolve: Callable[[str], tuple[str, Heading]], origin: str) -> Definition:
    """resolve(reference) gives a parent's full name and heading; origin is the lineage of attributes that begin here."""
    comment, attributes, keys, indexes, in_key = "", {}, [], [], True
    lines = [x.strip() for x in text.strip().splitlines()]
    for k, line in enumerate(lines):
        if not line:
            continue
        if line.startswith("#"):
            if k == 0:
                comment = line[1:].strip()
                if comment.startswith(":"):
                    raise KeyloomError("a table's comment must not begin with a colon")
            continue
        if line.startswith("---"):
            in_key = False
        elif line.startswith("->"):
            m = FOREIGN.match(line)
            if not m:
                raise KeyloomError(f"can't read the line {line!r}")
            options = {o.strip().lower() for o in (m["options"] or "").split(",") if o.strip()}
            if options - {"nullable", "unique"}:
                raise KeyloomError(f"unknown options {sorted(options - {'nullable', 'unique'})} in {line!r}")
            if "nullable" in options and in_key:
                raise KeyloomError(f"a key attribute can't be null: {line!r}")
            parent, heading = resolve(m["ref"])
            renames = {}
            for one in re.findall(r"(\w+)\s*=\s*['\"](\w+)['\"]", m["proj"] or ""):
                renames[one[1]] = one[0]
            if bad := set(renames) - set(heading.primary_key):
                raise KeyloomError(f"{sorted(bad)} aren't in the key of {m['ref']}")
            columns = {renames.get(p, p): p for p in heading.primary_key}
            for child, p in columns.items():
                if child not in attributes:
                    attributes[child] = replace(heading[p], name=child, in_key=in_key, nullable="nullable" in options, has_default="nullable" in options, default=None, autoincrement=False)
            keys.append(ForeignKey(parent, columns, "nullable" in options, "unique" in options, in_key))
            if "unique" in options:
                indexes.append((tuple(columns), True))
        elif m := INDEX.match(line):
            indexes.append((tuple(x.strip() for x in m["names"].split(",")), bool(m["unique"])))
        else:
            a = parse_attribute(line, in_key)
            if a.name in attributes:
                raise KeyloomError(f"the attribute {a.name} is declared twice")
            attributes[a.name] = replace(a, lineage=f"{origin}.{a.name}" if in_key else None)
    if not any(a.in_key for a in attributes.values()):  # a singleton: one entity at most
        attributes = {"_singleton": Attribute("_singleton", T.BooleanType(), in_key=True, default="true", has_default=True, declared="bool"), **attributes}
    for names, _ in indexes:
        for n in names:
            if re.fullmatch(r"\w+", n) and n not in attributes:
                raise KeyloomError(f"no attribute {n} to index")
    ordered = [*(a for a in attributes.values() if a.in_key), *(a for a in attributes.values() if not a.in_key)]
    return Definition(comment, Heading(ordered), keys, indexes)


def describe(definition: Definition, short: Callable[[str], str]) -> str:
    """The text that declares this table again. short: a parent's full name as the text refers to it."""
    out = [f"# {definition.comment}"] if definition.comment else []
    done: set[str] = set()
    for part in (True, False):
        if not part:
            out.append("---")
        for f in definition.foreign_keys:
            if f.primary == part:
                options = [o for o, on in (("nullable", f.nullable), ("unique", f.unique)) if on]
                renames = ", ".join(f"{c}='{p}'" for c, p in f.columns.items() if c != p)
                out.append("-> " + (f"[{', '.join(options)}] " if options else "") + short(f.parent) + (f".proj({renames})" if renames else ""))
                done |= set(f.columns)
        for a in definition.heading.every:
            if a.in_key == part and a.name not in done and not a.hidden:
                default = "" if not a.has_default else " = null" if a.default is None else f" = {a.default}" if a.default == "CURRENT_TIMESTAMP" else f" = {a.default!r}"
                out.append(f"{a.name}{default} : {a.declared}" + (f"  # {a.comment}" if a.comment else ""))
    unique_keys = {tuple(f.columns) for f in definition.foreign_keys if f.unique}
    out += [f"{'unique ' * u}index ({', '.join(n)})" for n, u in definition.indexes if not (u and n in unique_keys)]
    return "\n".join(out) + "\n"
