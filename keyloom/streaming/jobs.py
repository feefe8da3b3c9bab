"""Job queues: a file for each key of a computed table.

A worker owns a job by creating its claim, which only one can. All else of a job, its status, error and times, is a small file
that its owner replaces whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import socket
import time
from typing import TYPE_CHECKING, Any

from ..errors import MissingError

if TYPE_CHECKING:
    from .populate import AutoPopulate

#: Characters of an error's text that are kept.
ERROR_LENGTH = 2047
#: Seconds after which a claim whose owner has not marked the job may be taken over.
CLAIM_SECONDS = 60


class Jobs:
    def __init__(self, target: AutoPopulate):
        self.target, self.store = target, target.catalog.store
        self.folder = f"jobs/{target.full_name}"

    def _name(self, key: dict[str, Any]) -> str:
        text = json.dumps({k: key[k] for k in self.target.catalog.definition(self.target.full_name).heading.primary_key if k in key}, sort_keys=True, default=str)
        return hashlib.md5(text.encode()).hexdigest()

    def _read(self, name: str) -> dict | None:
        try:
            return json.loads(self.store.read(f"{self.folder}/{name}.json"))
        except MissingError:
            return None

    def _write(self, key: dict[str, Any], **values: Any) -> None:
        name = self._name(key)
        self.store.write(f"{self.folder}/{name}.json", json.dumps((self._read(name) or {"key": key}) | values, default=str).encode())

    def _remove(self, key: dict[str, Any]) -> None:
        self.store.delete(f"{self.folder}/{self._name(key)}.json")
        self.store.delete(f"{self.folder}/{self._name(key)}.claim")

    def all(self, status: str | None = None) -> list[dict]:
        found = [self._read(n[:-5]) for n in self.store.names(self.folder) if n.endswith(".json")]
        return [j for j in found if j and status in (None, j["status"])]

    def refresh(self, *restrictions: Any, delay: float = 0, priority: int = 5, stale_timeout: float = 3600, orphan_timeout: float | None = None, keep_completed: bool = False) -> dict[str, int]:
        """Add keys that wait to be computed, put completed keys back whose result is gone, remove old jobs whose key is gone from
        the source, and free jobs whose worker has been silent for orphan_timeout seconds."""
        now, done = time.time(), {"added": 0, "removed": 0, "orphaned": 0, "re_pended": 0}
        known = {self._name(j["key"]): j for j in self.all()}
        for key in self.target.todo(*restrictions).keys():
            job = known.get(self._name(key))
            if job is None:
                self._write(key, status="pending", priority=priority, scheduled=now + delay, created=now)
                done["added"] += 1
            elif job["status"] == "success" and keep_completed:
                self.store.delete(f"{self.folder}/{self._name(key)}.claim")
                self._write(key, status="pending", priority=priority, scheduled=now)
                done["re_pended"] += 1
        if stale_timeout > 0:
            old = [j for j in known.values() if j["created"] < now - stale_timeout and j["status"] != "ignore"]
            if old:
                there = {self._name(k) for k in self.target.key_source.keys()}
                for j in old:
                    if self._name(j["key"]) not in there:
                        self._remove(j["key"])
                        done["removed"] += 1
        if orphan_timeout:
            for j in known.values():
                if j["status"] == "reserved" and j["reserved"] < now - orphan_timeout:
                    self.store.delete(f"{self.folder}/{self._name(j['key'])}.claim")
                    self._write(j["key"], status="pending", priority=priority)
                    done["orphaned"] += 1
        return done

    def waiting(self) -> list[dict[str, Any]]:
        """Keys of pending jobs that are due, the most urgent first."""
        due = [j for j in self.all("pending") if j["scheduled"] <= time.time()]
        return [j["key"] for j in sorted(due, key=lambda j: (j["priority"], j["scheduled"]))]

    def reserve(self, key: dict[str, Any]) -> bool:
        name = self._name(key)
        claim, owner = f"{self.folder}/{name}.claim", json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "time": time.time()}).encode()
        if (self._read(name) or {"status": "pending"})["status"] != "pending":
            return False
        if not self.store.publish(claim, owner):
            # its owner may have died between the claim and the mark
            try:
                old = json.loads(self.store.read(claim))["time"]
            except MissingError:
                return False
            if old > time.time() - CLAIM_SECONDS or not self.store.publish(f"{claim}.{old}", owner):
                return False  # one of those who see an old claim may take it over
            self.store.write(claim, owner)
        self._write(key, status="reserved", reserved=time.time(), host=socket.gethostname(), pid=os.getpid())
        return True

    def complete(self, key: dict[str, Any], duration: float = 0.0, keep: bool = False) -> None:
        if keep:
            self._write(key, status="success", completed=time.time(), duration=duration)
        else:
            self._remove(key)

    def error(self, key: dict[str, Any], message: str, stack: str = "") -> None:
        cut = "...truncated"
        self._write(key, status="error", error=message if len(message) <= ERROR_LENGTH else message[: ERROR_LENGTH - len(cut)] + cut, stack=stack)

    def ignore(self, key: dict[str, Any]) -> None:
        """Never compute this key."""
        self._write(key, status="ignore", created=time.time(), priority=0, scheduled=0)

    def clear(self, status: str | None = None) -> None:
        for j in self.all(status):
            self._remove(j["key"])

    def progress(self) -> dict[str, int]:
        out = dict.fromkeys(("pending", "reserved", "success", "error", "ignore"), 0)
        for j in self.all():
            out[j["status"]] += 1
        return out | {"total": sum(out.values())}
