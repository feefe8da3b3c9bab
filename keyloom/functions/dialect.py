"""Users' expression strings, rewritten into Spark SQL.

Strings are taken as written for common databases. A small tokenizer finds the forms that Spark lacks or reads differently,
so that nested parentheses and quoted text are safe:

  GROUP_CONCAT([DISTINCT] x [ORDER BY ..] [SEPARATOR s])   STRING_AGG with a cast to text
  SUM(comparison)                                          SUM of 0 and 1
  CURRENT_TIMESTAMP(n)                                     cut to n fractional digits
  col->>'$.p', col->'$.p', json_value(col, '$.p' [returning t])   get_json_object, cast
  INTERVAL n UNIT                                          as it is; the quoted form 'n units' too
  x::type                                                  CAST
  %%                                                       %
"""

from __future__ import annotations

import re

TOKEN = re.compile(r"""\s+|'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|""|\\.)*"|`[^`]*`|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|[A-Za-z_][A-Za-z_0-9$]*|->>|->|::|<=>|<=|>=|<>|!=|\|\||&&|.""", re.S)
COMPARE = {"=", "<", ">", "<=", ">=", "<>", "!=", "<=>"}
COMPARE_WORDS = {"LIKE", "RLIKE", "IN", "IS", "BETWEEN", "AND", "OR", "NOT", "EXISTS"}
#: Types of other databases by their Spark names.
TYPES = {"unsigned": "bigint", "signed": "bigint", "integer": "int", "text": "string", "char": "string", "varchar": "string", "numeric": "decimal(38,10)", "decimal": "decimal(38,10)", "real": "double", "float8": "double", "float4": "float", "int8": "bigint", "int4": "int", "int2": "smallint", "bool": "boolean", "datetime": "timestamp_ntz", "double": "double", "float": "float"}


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


def spark_type(name: str) -> str:
    base, _, rest = name.strip().lower().partition("(")
    return name.strip().lower() if rest and base in {"decimal", "numeric"} else TYPES.get(base.strip(), base.strip())


def _blank(t: str) -> bool:
    return t.isspace()


def _close(parts: list[str], start: int) -> int:
    """The place of the parenthesis that closes the one at start."""
    depth = 0
    for i in range(start, len(parts)):
        depth += {"(": 1, ")": -1}.get(parts[i], 0)
        if not depth:
            return i
    raise ValueError("parentheses don't match: " + "".join(parts))


def _split(parts: list[str], word: str) -> tuple[list[str], list[str] | None]:
    """What stands before and after a word (one or two, apart from blanks) outside of parentheses."""
    depth, wanted = 0, word.split()
    for i, t in enumerate(parts):
        depth += {"(": 1, ")": -1}.get(t, 0)
        if not depth and t.upper() == wanted[0]:
            rest = [k for k in range(i + 1, len(parts)) if not _blank(parts[k])]
            if len(wanted) == 1:
                return parts[:i], parts[i + 1 :]
            if rest and parts[rest[0]].upper() == wanted[1]:
                return parts[:i], parts[rest[0] + 1 :]
    return parts, None


def _commas(parts: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for t in parts:
        depth += {"(": 1, ")": -1}.get(t, 0)
        if t == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _is_condition(parts: list[str]) -> bool:
    depth = 0
    for t in parts:
        depth += {"(": 1, ")": -1}.get(t, 0)
        if not depth and (t in COMPARE or t.upper() in COMPARE_WORDS):
            return True
    inner = [t for t in parts if not _blank(t)]
    return bool(inner) and inner[0] == "(" and _close(inner, 0) == len(inner) - 1 and _is_condition(inner[1:-1])


def _call(name: str, inside: list[str]) -> str | None:
    if name in {"GROUP_CONCAT", "STRING_AGG"}:
        body, separator = _split(inside, "SEPARATOR")
        pieces = _commas(body)
        if separator is None and name == "STRING_AGG" and len(pieces) > 1:
            body, separator = pieces[0], [t for p in pieces[1:] for t in p]
            separator, order = _split(separator, "ORDER BY")
        else:
            body, order = _split(body, "ORDER BY")
        lead = [t for t in body if not _blank(t)][:1]
        distinct = "DISTINCT " if lead and lead[0].upper() == "DISTINCT" else ""
        if distinct:
            body = body[next(i for i, t in enumerate(body) if t.upper() == "DISTINCT") + 1 :]
        sep = translate("".join(separator)).strip() if separator else "','"
        within = f" WITHIN GROUP (ORDER BY {translate(''.join(order)).strip()})" if order else ""
        return f"listagg({distinct}CAST({translate(''.join(body)).strip()} AS STRING), {sep}){within}"
    if name == "SUM" and _is_condition(inside):
        return f"SUM(CAST(({translate(''.join(inside)).strip()}) AS INT))"
    if name == "CURRENT_TIMESTAMP" and "".join(inside).strip().isdigit():
        cut = {0: "SECOND", 3: "MILLISECOND"}.get(int("".join(inside)), "MICROSECOND")
        return f"date_trunc('{cut}', current_timestamp())"
    if name == "JSON_VALUE":
        body, kind = _split(inside, "RETURNING")
        column, path = _commas(body)
        found = f"get_json_object({translate(''.join(column)).strip()}, {''.join(path).strip()})"
        return f"CAST({found} AS {spark_type(''.join(kind))})" if kind else found
    return None


def translate(text: str) -> str:
    """The expression in Spark SQL."""
    parts, out, i = tokens(text.replace("%%", "%")), [], 0
    while i < len(parts):
        t = parts[i]
        k = i + 1
        while k < len(parts) and _blank(parts[k]):
            k += 1
        if k < len(parts) and parts[k] == "(" and re.fullmatch(r"[A-Za-z_]\w*", t):
            end = _close(parts, k)
            special = _call(t.upper(), parts[k + 1 : end])
            out.append(special if special is not None else f"{t}({translate(''.join(parts[k + 1 : end]))})")
            i = end + 1
            continue
        if t in {"->>", "->"} and out and k < len(parts):
            while out and _blank(out[-1]):
                out.pop()
            out.append(f"get_json_object({out.pop()}, {parts[k]})")
            i = k + 1
            continue
        if t == "::" and out and k < len(parts):
            end = k + 1
            if end < len(parts) and parts[end] == "(":
                end = _close(parts, end) + 1
            out.append(f"CAST({out.pop()} AS {spark_type(''.join(parts[k:end]))})")
            i = end
            continue
        if t == "(":
            end = _close(parts, i)
            out.append(f"({translate(''.join(parts[i + 1 : end]))})")
            i = end + 1
            continue
        if t.upper() == "INTERVAL" and k < len(parts) and re.fullmatch(r"'\s*-?\d+\s+[A-Za-z]+\s*'", parts[k]):
            out.append(f"INTERVAL {parts[k].strip(chr(39)).strip()}")
            i = k + 1
            continue
        out.append("AND" if t == "&&" else t)
        i += 1
    return "".join(out)
