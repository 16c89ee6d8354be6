"""Driver-side files: atomic writes, source lists, snapshots of the catalog."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def atomic_write(path: Path, pieces: Iterable[str]) -> None:
    """Write next to ``path``, flush to disk, then replace: readers see the old
    file or the new one, whatever happens."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            file.writelines(pieces)
            file.flush()
            os.fsync(file.fileno())
        os.replace(temp, path)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise


def save_sources(path: Path, roots: Iterable[str]) -> list[str]:
    """Write a list of scan roots; of entries that differ in case only the first stays."""
    out: dict[str, str] = {}
    for root in roots:
        clean = root.strip().rstrip("\\/")
        if clean:
            out.setdefault(clean.lower(), clean)
    atomic_write(path, ["# Folders to scan, one a line.\n", *(f"{r}\n" for r in out.values())])
    return list(out.values())


def save_local_rules(path: Path, changes: dict) -> Path:
    """Lay ``changes`` over the local rules file, key by key and within objects;
    the rest of it stays. One that isn't a JSON object raises ValueError."""
    path = Path(path)
    held = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    if not isinstance(held, dict):
        raise ValueError(f"{path} holds no object")
    for key, value in changes.items():
        inner = held.get(key)
        held[key] = {**inner, **value} if isinstance(inner, dict) and isinstance(value, dict) else value
    atomic_write(path, [json.dumps(held, indent=2), "\n"])
    return path


def load_sources(path: Path) -> list[str]:
    if not Path(path).exists():
        return []
    lines = (x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines())
    return [x.rstrip("\\/") for x in lines if x and not x.startswith("#")]


class Snapshots:
    """Versions of the catalog as Parquet folders, and a pointer to the current
    one: Spark can't overwrite a table that it reads."""

    def __init__(self, spark: SparkSession, folder: Path, keep: int = 10):
        self.spark, self.folder, self.keep = spark, Path(folder), keep
        self.pointer = self.folder / "CURRENT"

    def names(self) -> list[str]:
        return sorted(p.name for p in self.folder.glob("v*") if p.is_dir()) if self.folder.exists() else []

    def current(self) -> str | None:
        return json.loads(self.pointer.read_text())["name"] if self.pointer.exists() else None

    def load(self, name: str | None = None) -> DataFrame | None:
        name = name or self.current()
        return None if name is None else self.spark.read.parquet(f"file://{self.folder}/{name}")

    def save(self, items: DataFrame) -> str:
        """Write a new version, point to it, and keep the newest ``keep``."""
        names = self.names()
        name = f"v{int(names[-1][1:]) + 1 if names else 1:08d}"
        items.write.parquet(f"file://{self.folder}/{name}")
        atomic_write(self.pointer, [json.dumps({"name": name})])
        for old in self.names()[: -self.keep]:
            if old != name:
                shutil.rmtree(self.folder / old)
        return name

    def restore(self, name: str | None = None) -> str:
        """Make a version (the one before the current by default) current again.
        Nothing is deleted, so a restore can be taken back the same way."""
        names, now = self.names(), self.current()
        name = name or next((n for n in reversed(names) if now is None or n < now), None)
        if name not in names:
            raise FileNotFoundError(f"no snapshot {name or 'to go back to'}")
        atomic_write(self.pointer, [json.dumps({"name": name})])
        return name
