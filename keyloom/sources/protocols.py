"""Object stores by specification: a protocol, a location, and what the protocol needs."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import SparkSession

from ..errors import KeyloomError, MissingError
from .codecs import add_store
from .store import Store

_protocols: dict[str, Protocol] = {}


class Protocol(ABC):
    """How a specification becomes a URI that Hadoop's file systems open. Subclasses register themselves under their name."""

    name: str = ""
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()

    def __init_subclass__(cls, **more: Any):
        super().__init_subclass__(**more)
        if cls.name:
            _protocols[cls.name] = cls()

    def check(self, spec: dict[str, Any]) -> None:
        if missing := [k for k in self.required if k not in spec]:
            raise KeyloomError(f"a {self.name} store needs {missing}")
        if unknown := [k for k in spec if k not in {"protocol", *self.required, *self.optional}]:
            raise KeyloomError(f"a {self.name} store has no {unknown}")

    @abstractmethod
    def uri(self, spec: dict[str, Any]) -> str: ...

    def settings(self, spec: dict[str, Any]) -> dict[str, str]:
        """Hadoop's settings for this store."""
        return {}


class File(Protocol):
    name, required = "file", ("location",)

    def uri(self, spec: dict[str, Any]) -> str:
        return f"file://{spec['location']}"


class Hadoop(Protocol):
    """Whatever Hadoop opens by its URI."""

    name, required = "hadoop", ("location",)

    def uri(self, spec: dict[str, Any]) -> str:
        return spec["location"]


class S3(Protocol):
    name, required, optional = "s3", ("bucket", "location"), ("endpoint", "access_key", "secret_key", "secure")

    def uri(self, spec: dict[str, Any]) -> str:
        return f"s3a://{spec['bucket']}/{spec['location'].strip('/')}"

    def settings(self, spec: dict[str, Any]) -> dict[str, str]:
        own = f"fs.s3a.bucket.{spec['bucket']}"
        named = {"endpoint": spec.get("endpoint"), "access.key": spec.get("access_key"), "secret.key": spec.get("secret_key")}
        found = {f"{own}.{k}": v for k, v in named.items() if v}
        return found | ({f"{own}.connection.ssl.enabled": str(bool(spec["secure"])).lower()} if "secure" in spec else {})


class Gcs(Protocol):
    name, required, optional = "gcs", ("bucket", "location"), ("key_file",)

    def uri(self, spec: dict[str, Any]) -> str:
        return f"gs://{spec['bucket']}/{spec['location'].strip('/')}"

    def settings(self, spec: dict[str, Any]) -> dict[str, str]:
        return {"fs.gs.auth.service.account.json.keyfile": spec["key_file"]} if "key_file" in spec else {}


class Azure(Protocol):
    name, required, optional = "azure", ("account", "container", "location"), ("account_key",)

    def uri(self, spec: dict[str, Any]) -> str:
        return f"abfss://{spec['container']}@{spec['account']}.dfs.core.windows.net/{spec['location'].strip('/')}"

    def settings(self, spec: dict[str, Any]) -> dict[str, str]:
        return {f"fs.azure.account.key.{spec['account']}.dfs.core.windows.net": spec["account_key"]} if "account_key" in spec else {}


def protocol(name: str) -> Protocol:
    if name not in _protocols:
        raise MissingError(f"no protocol {name}; there are {sorted(_protocols)}")
    return _protocols[name]


def open_store(spark: SparkSession, spec: dict[str, Any], name: str | None = None) -> Store:
    """The store of a specification; with a name, codecs know it by that."""
    kind = protocol(spec.get("protocol", "file"))
    kind.check(spec)
    for k, v in kind.settings(spec).items():
        spark._jsc.hadoopConfiguration().set(k, v)
    store = Store(spark, kind.uri(spec))
    if name:
        add_store(name, store)
    return store
