"""Versioned manifests: which runs make a table, and in which level each is."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from ..spec import FORMAT_VERSION, TableSpec
from .store import ObjectStore

FOLDER = "_manifests"


@dataclass(frozen=True)
class Part:
    """One immutable file, sorted by key: its path below the runs, its counts, and its least and greatest key (``spec.comparable``)."""

    path: str
    rows: int
    deleted: int
    bytes: int
    low: tuple
    high: tuple


@dataclass(frozen=True)
class Run:
    """Files in key order whose key ranges don't overlap. ``rows`` counts keys, tombstones included."""

    run_id: str
    parts: tuple[Part, ...]
    max_seq: int

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts)

    @property
    def deleted(self) -> int:
        return sum(p.deleted for p in self.parts)

    @property
    def bytes(self) -> int:
        return sum(p.bytes for p in self.parts)

    @classmethod
    def from_dict(cls, d: dict) -> Run:
        parts = tuple(Part(**{**p, "low": tuple(p["low"]), "high": tuple(p["high"])}) for p in d["parts"])
        return cls(d["run_id"], parts, d["max_seq"])


@dataclass(frozen=True)
class Manifest:
    """A table's state: level 0 holds batches, newest first; each later level holds one run at most."""

    spec: TableSpec
    version: int = 0
    next_seq: int = 1
    levels: tuple[tuple[Run, ...], ...] = ()
    format_version: int = FORMAT_VERSION
    notes: dict = field(default_factory=dict)

    def level(self, n: int) -> tuple[Run, ...]:
        return self.levels[n] if n < len(self.levels) else ()

    def runs(self, first: int = 0, last: int | None = None) -> list[tuple[int, Run]]:
        """(level, run) from newest to oldest."""
        return [(i, r) for i, level in enumerate(self.levels) for r in level if i >= first and (last is None or i <= last)]

    def with_level(self, n: int, runs: tuple[Run, ...]) -> Manifest:
        levels = list(self.levels) + [()] * (n + 1 - len(self.levels))
        levels[n] = runs
        while levels and not levels[-1]:
            levels.pop()
        return replace(self, levels=tuple(levels))

    def to_bytes(self) -> bytes:
        d = {"format_version": self.format_version, "version": self.version, "next_seq": self.next_seq, "spec": self.spec.to_json(), "levels": [[asdict(r) for r in level] for level in self.levels], "notes": self.notes}
        return json.dumps(d, indent=1).encode()

    @classmethod
    def from_bytes(cls, data: bytes) -> Manifest:
        d = json.loads(data)
        if d.get("format_version", 0) != FORMAT_VERSION:
            raise ValueError(f"format version {d.get('format_version')} is not {FORMAT_VERSION}")
        levels = tuple(tuple(map(Run.from_dict, level)) for level in d["levels"])
        return cls(TableSpec.from_json(d["spec"]), d["version"], d["next_seq"], levels, d["format_version"], d.get("notes", {}))


def versions(store: ObjectStore) -> list[int]:
    return sorted(int(m[1]) for name, _ in store.list(FOLDER) if (m := re.fullmatch(r"(\d{12})\.json", name)))


def load(store: ObjectStore, version: int | None = None) -> Manifest:
    """The newest manifest, or that of ``version``."""
    known = versions(store)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no table{'' if version is None else f' version {version}'} at {store.base}")
    return Manifest.from_bytes(store.read(f"{FOLDER}/{known[-1] if version is None else version:012d}.json"))


def commit(store: ObjectStore, manifest: Manifest) -> Manifest:
    """Writes the next version. If another writer took that number, FileExistsError: load, redo, commit again."""
    new = replace(manifest, version=manifest.version + 1)
    store.write(f"{FOLDER}/{new.version:012d}.json", new.to_bytes())
    return new
