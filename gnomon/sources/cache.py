"""Schemas that were read before, in memory and, if a folder is given, on disk; each is good for one state of its files."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path


class SchemaCache:
    """Values by key, each with the stamp (paths, times and sizes of files) that it was made for; a value of another
    stamp doesn't count. Disabled, it keeps nothing and finds nothing. Disk entries are JSON, written whole or not at all."""

    def __init__(self, folder: str | None = None):
        self._held: dict[str, tuple[str, object]] = {}
        self._folder, self._on = Path(folder) if folder else None, True

    def _file(self, key: str) -> Path:
        return self._folder / f"{hashlib.sha256(key.encode()).hexdigest()}.json"

    def put(self, key: str, value, stamp="") -> None:
        if not self._on:
            return
        stamp = str(stamp)
        self._held[key] = (stamp, value)
        if self._folder:
            self._folder.mkdir(parents=True, exist_ok=True)
            part = self._file(key).with_suffix(f".{os.getpid()}.part")
            part.write_text(json.dumps({"key": key, "stamp": stamp, "value": value}))
            part.replace(self._file(key))

    def get(self, key: str, stamp=""):
        if not self._on:
            return None
        if key not in self._held and self._folder and self._file(key).exists():
            found = json.loads(self._file(key).read_text())
            self._held[key] = (found["stamp"], found["value"])
        held = self._held.get(key)
        return held[1] if held and held[0] == str(stamp) else None

    def has(self, key: str, stamp="") -> bool:
        return self.get(key, stamp) is not None

    def forget(self, key: str) -> None:
        self._held.pop(key, None)
        if self._folder:
            self._file(key).unlink(missing_ok=True)

    def flush(self) -> None:
        self._held.clear()
        if self._folder and self._folder.exists():
            for f in self._folder.glob("*.json"):
                f.unlink()

    def enable(self) -> None:
        self._on = True

    def disable(self) -> None:
        self._on = False

    def is_enabled(self) -> bool:
        return self._on

    def all(self) -> dict:
        return {k: v for k, (_, v) in self._held.items()} if self._on else {}

    def size(self) -> int:
        return len(self._held) if self._on else 0


#: What providers use unless they are given another: one for the process.
SHARED = SchemaCache()
