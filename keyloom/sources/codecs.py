"""Codecs: Python values in columns that hold bytes or JSON.

A codec is named in a definition as <name>, or <name@store> if its data lie in an object store. Its storage type may be another
codec, so that codecs form chains: encoding runs from the outer to the inner one, decoding back. Values are decoded when they
are fetched, never within a plan.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import hashlib
import io
import json
import struct
import uuid
import zlib
from abc import ABC, abstractmethod
from pathlib import Path
from typing import Any

import numpy as np

from ..errors import IntegrityError, KeyloomError, MissingError
from ..plans.heading import Attribute
from .store import Store

_codecs: dict[str, Codec] = {}
_stores: dict[str, Store] = {}


class Codec(ABC):
    """Subclasses register themselves under their name; register=False leaves an abstract base out."""

    name: str | None = None

    def __init_subclass__(cls, register: bool = True, **more: Any):
        super().__init_subclass__(**more)
        if register and cls.name:
            if cls.name in _codecs and type(_codecs[cls.name]).__qualname__ != cls.__qualname__:
                raise KeyloomError(f"the codec <{cls.name}> exists already")
            _codecs[cls.name] = cls()

    @abstractmethod
    def storage(self, in_store: bool) -> str:
        """bytes, json, or another codec as <name>."""

    @abstractmethod
    def encode(self, value: Any, store: str | None = None, key: dict | None = None) -> Any: ...

    @abstractmethod
    def decode(self, stored: Any, key: dict | None = None) -> Any: ...

    def validate(self, value: Any) -> None:
        """Raise if value can't be encoded."""


def codec(name: str) -> Codec:
    if name not in _codecs:
        raise MissingError(f"no codec <{name}>")
    return _codecs[name]


def registered() -> list[str]:
    return sorted(_codecs)


def add_store(name: str, store: Store) -> None:
    """Make a place for objects known under a name."""
    _stores[name] = store


def store_of(name: str | None) -> Store:
    if (name or "default") not in _stores:
        raise MissingError(f"no store {name or 'default'}; add_store() makes one known")
    return _stores[name or "default"]


def chain(name: str, in_store: bool) -> tuple[list[Codec], str]:
    """The codecs from the outer to the inner one, and the type that holds the result: bytes or json."""
    found: list[Codec] = []
    seen: set[str] = set()
    while True:
        if name in seen:
            raise KeyloomError(f"codecs form a cycle: <{name}>")
        seen.add(name)
        found.append(codec(name))
        kind = found[-1].storage(in_store)
        if not kind.startswith("<"):
            return found, kind
        name, _, store = kind.strip("<>").partition("@")
        in_store = in_store or bool(store) or kind.rstrip(">").endswith("@")


def encode(attribute: Attribute, value: Any, key: dict | None = None) -> Any:
    if value is None:
        return None
    found, kind = chain(attribute.codec, attribute.store is not None)
    for c in found:
        c.validate(value)
        value = c.encode(value, store=attribute.store, key=key)
    return json.dumps(value) if kind == "json" else bytes(value)


def decode(attribute: Attribute, value: Any, key: dict | None = None) -> Any:
    if value is None:
        return None
    found, kind = chain(attribute.codec, attribute.store is not None)
    value = json.loads(value) if kind == "json" else bytes(value)
    for c in reversed(found):
        value = c.decode(value, key=key)
    return value


# ---- self-describing bytes: a letter for the kind, then its content; sizes are eight bytes, little-endian

_size = struct.Struct("<q")


def _parts(items: list[bytes]) -> bytes:
    return _size.pack(len(items)) + b"".join(_size.pack(len(x)) + x for x in items)


def _take(raw: bytes) -> list[bytes]:
    (n,), at, out = _size.unpack_from(raw), 8, []
    for _ in range(n):
        (k,) = _size.unpack_from(raw, at)
        out.append(raw[at + 8 : at + 8 + k])
        at += 8 + k
    return out


def pack(x: Any) -> bytes:
    if x is None:
        return b"N"
    if isinstance(x, (bool, np.bool_)):
        return b"B" + bytes([bool(x)])
    if isinstance(x, int):
        return b"I" + str(x).encode()
    if isinstance(x, float):
        return b"F" + struct.pack("<d", x)
    if isinstance(x, complex):
        return b"C" + struct.pack("<dd", x.real, x.imag)
    if isinstance(x, str):
        return b"S" + x.encode("utf-8", "surrogatepass")
    if isinstance(x, (bytes, bytearray)):
        return b"Y" + bytes(x)
    if isinstance(x, decimal.Decimal):
        return b"M" + str(x).encode()
    if isinstance(x, datetime.datetime):
        return b"T" + x.isoformat().encode()
    if isinstance(x, datetime.date):
        return b"D" + x.isoformat().encode()
    if isinstance(x, datetime.time):
        return b"H" + x.isoformat().encode()
    if isinstance(x, datetime.timedelta):
        return b"W" + struct.pack("<qqq", x.days, x.seconds, x.microseconds)
    if isinstance(x, uuid.UUID):
        return b"U" + x.bytes
    if isinstance(x, (np.ndarray, np.generic)):
        a = np.asarray(x)
        if a.dtype.hasobject and not a.dtype.names:
            return b"O" + _parts([pack(list(a.shape)), *map(pack, a.ravel().tolist())])
        if a.dtype.hasobject:
            return b"R" + _parts([pack(list(a.shape)), pack(list(a.dtype.names)), *(pack(np.asarray(a[n])) for n in a.dtype.names)])
        out = io.BytesIO()
        np.save(out, a, allow_pickle=False)
        return (b"A" if isinstance(x, np.ndarray) else b"G") + out.getvalue()
    if isinstance(x, list):
        return b"L" + _parts([pack(i) for i in x])
    if isinstance(x, tuple):
        return b"P" + _parts([pack(i) for i in x])
    if isinstance(x, (set, frozenset)):
        return b"E" + _parts(sorted(pack(i) for i in x))
    if isinstance(x, dict):
        return b"K" + _parts([p for k, v in x.items() for p in (pack(k), pack(v))])
    if hasattr(x, "to_records"):
        return pack(x.to_records(index=False))
    raise KeyloomError(f"a blob can't hold a {type(x).__name__}")


def unpack(raw: bytes) -> Any:
    kind, body = raw[:1], raw[1:]
    if kind == b"N":
        return None
    if kind == b"B":
        return bool(body[0])
    if kind == b"I":
        return int(body)
    if kind == b"F":
        return struct.unpack("<d", body)[0]
    if kind == b"C":
        return complex(*struct.unpack("<dd", body))
    if kind == b"S":
        return body.decode("utf-8", "surrogatepass")
    if kind == b"Y":
        return body
    if kind == b"M":
        return decimal.Decimal(body.decode())
    if kind == b"T":
        return datetime.datetime.fromisoformat(body.decode())
    if kind == b"D":
        return datetime.date.fromisoformat(body.decode())
    if kind == b"H":
        return datetime.time.fromisoformat(body.decode())
    if kind == b"W":
        return datetime.timedelta(*struct.unpack("<qqq", body))
    if kind == b"U":
        return uuid.UUID(bytes=body)
    if kind in b"AG":
        a = np.load(io.BytesIO(body), allow_pickle=False)
        return a if kind == b"A" else a[()]
    items = _take(body)
    if kind == b"O":
        values = [unpack(i) for i in items[1:]]
        a = np.empty(len(values), dtype=object)
        a[:] = values
        return a.reshape(unpack(items[0]))
    if kind == b"R":
        names, columns = unpack(items[1]), [unpack(i) for i in items[2:]]
        a = np.empty(unpack(items[0]), dtype=[(n, c.dtype) for n, c in zip(names, columns, strict=True)])
        for n, c in zip(names, columns, strict=True):
            a[n] = c
        return a
    if kind == b"K":
        return {unpack(k): unpack(v) for k, v in zip(items[::2], items[1::2], strict=True)}
    out = [unpack(i) for i in items]
    if kind in b"LPE":
        return {b"L": list, b"P": tuple, b"E": set}[kind](out)
    raise KeyloomError(f"unknown kind {kind!r} in a blob")


class BlobCodec(Codec):
    """Any nesting of numbers, text, dates, arrays, lists and dictionaries."""

    name = "blob"
    #: Bytes from which a blob is compressed.
    squeeze = 1000

    def storage(self, in_store: bool) -> str:
        return "<hash@>" if in_store else "bytes"

    def encode(self, value: Any, store: str | None = None, key: dict | None = None) -> bytes:
        raw = pack(value)
        small = zlib.compress(raw) if len(raw) >= self.squeeze else raw
        return b"z" + small if len(small) < len(raw) else b"r" + raw

    def decode(self, stored: bytes, key: dict | None = None) -> Any:
        return unpack(zlib.decompress(stored[1:]) if stored[:1] == b"z" else stored[1:])


class AttachCodec(Codec):
    """A file with its name; decoding writes it into `folder` and gives the path."""

    name, folder = "attach", "."

    def storage(self, in_store: bool) -> str:
        return "<hash@>" if in_store else "bytes"

    def validate(self, value: Any) -> None:
        if not Path(value).is_file():
            raise KeyloomError(f"no file {value}")

    def encode(self, value: Any, store: str | None = None, key: dict | None = None) -> bytes:
        return Path(value).name.encode() + b"\0" + Path(value).read_bytes()

    def decode(self, stored: bytes, key: dict | None = None) -> str:
        name, _, data = stored.partition(b"\0")
        place = Path(self.folder) / Path(name.decode()).name
        k = 0
        while place.exists() and place.read_bytes() != data:
            k += 1
            place = Path(self.folder) / f"{Path(name.decode()).stem}_{k}{Path(name.decode()).suffix}"
        place.write_bytes(data)
        return str(place)


class HashCodec(Codec):
    """Bytes in a store under their hash; equal contents are stored once, and reading verifies them."""

    name = "hash"

    @staticmethod
    def digest(data: bytes) -> str:
        return base64.b32encode(hashlib.md5(data).digest()).decode().rstrip("=").lower()

    def storage(self, in_store: bool) -> str:
        if not in_store:
            raise KeyloomError("<hash> needs a store: <hash@>")
        return "json"

    def encode(self, value: Any, store: str | None = None, key: dict | None = None) -> dict:
        data = bytes(value)
        digest = self.digest(data)
        name = f"_hash/{digest[:2]}/{digest[2:4]}/{digest}"
        if not store_of(store).exists(name):
            store_of(store).write(name, data)
        return {"hash": digest, "path": name, "store": store or "", "size": len(data)}

    def decode(self, stored: dict, key: dict | None = None) -> bytes:
        data = store_of(stored["store"] or None).read(stored["path"])
        if self.digest(data) != stored["hash"]:
            raise IntegrityError(f"{stored['path']} isn't what was stored")
        return data


class ObjectRef:
    """A stored file, read when asked for."""

    def __init__(self, meta: dict):
        self.meta = meta

    @property
    def path(self) -> str:
        return self.meta["path"]

    @property
    def size(self) -> int:
        return self.meta["size"]

    def exists(self) -> bool:
        return store_of(self.meta["store"] or None).exists(self.path)

    def read(self) -> bytes:
        return store_of(self.meta["store"] or None).read(self.path)

    def open(self) -> io.BytesIO:
        return io.BytesIO(self.read())

    def download(self, place: str) -> str:
        Path(place).write_bytes(self.read())
        return place

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.path!r}, {self.size} bytes)"


class NpyRef(ObjectRef):
    """A stored array; its shape and type are known without reading it."""

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self.meta["shape"])

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.meta["dtype"])

    def load(self) -> np.ndarray:
        return np.load(self.open(), allow_pickle=False)

    def __array__(self, dtype: Any = None, copy: Any = None) -> np.ndarray:
        return np.asarray(self.load(), dtype=dtype)


def object_path(key: dict | None, suffix: str) -> str:
    """A path that tells the entity: namespace, table and key, then a token that no other object has."""
    key = key or {}
    place = "/".join([str(key.get("__table", "objects")), *(f"{k}={v}" for k, v in key.items() if not k.startswith("__"))])
    return f"{place}/{key.get('__field', 'value')}_{uuid.uuid4().hex[:12]}{suffix}"


class ObjectCodec(Codec):
    """Bytes or a file at a path that tells the entity; decoding gives an ObjectRef."""

    name = "object"

    def storage(self, in_store: bool) -> str:
        if not in_store:
            raise KeyloomError("<object> needs a store: <object@>")
        return "json"

    def encode(self, value: Any, store: str | None = None, key: dict | None = None) -> dict:
        data, suffix = (bytes(value), "") if isinstance(value, (bytes, bytearray)) else (Path(value).read_bytes(), Path(value).suffix)
        name = object_path(key, suffix)
        store_of(store).write(name, data)
        return {"path": name, "store": store or "", "size": len(data)}

    def decode(self, stored: dict, key: dict | None = None) -> ObjectRef:
        return ObjectRef(stored)


class NpyCodec(Codec):
    """A numpy array at a path that tells the entity; decoding gives an NpyRef."""

    name = "npy"

    def storage(self, in_store: bool) -> str:
        if not in_store:
            raise KeyloomError("<npy> needs a store: <npy@>")
        return "json"

    def validate(self, value: Any) -> None:
        if not isinstance(value, np.ndarray) or value.dtype.hasobject:
            raise KeyloomError("<npy> holds arrays of plain types")

    def encode(self, value: Any, store: str | None = None, key: dict | None = None) -> dict:
        out = io.BytesIO()
        np.save(out, value, allow_pickle=False)
        name = object_path(key, ".npy")
        store_of(store).write(name, out.getvalue())
        return {"path": name, "store": store or "", "size": out.tell(), "shape": list(value.shape), "dtype": value.dtype.str}

    def decode(self, stored: dict, key: dict | None = None) -> NpyRef:
        return NpyRef(stored)


class FilepathCodec(Codec):
    """A file that lies in the store already; only its path is kept."""

    name = "filepath"

    def storage(self, in_store: bool) -> str:
        if not in_store:
            raise KeyloomError("<filepath> needs a store: <filepath@>")
        return "json"

    def encode(self, value: Any, store: str | None = None, key: dict | None = None) -> dict:
        name = str(value).lstrip("/")
        if name.startswith("_hash/"):
            raise KeyloomError(f"{name} lies among the hashed objects")
        if not store_of(store).exists(name):
            raise MissingError(f"no {name} in the store")
        return {"path": name, "store": store or "", "size": len(store_of(store).read(name))}

    def decode(self, stored: dict, key: dict | None = None) -> ObjectRef:
        return ObjectRef(stored)
