"""A Spark data source that lists folder trees: ``format("file_tree")``.

Names, sizes and kinds only; no file is opened. Spark's own file sources drop
names that start with ``_`` or ``.``, so they can't stand in. Folders to pass
over are pruned before descent, other extensions before their size is read;
links to folders are never followed, links to files are listed; a folder that
can't be read becomes one row with ``unreadable`` set. Folders are opened level
by level until there are BRANCHES of them, or LEVELS levels are open: each opened
one is a partition with its own files, each other one a partition with all below.

Options: ``roots`` (one a line), ``ignore_dirs``, ``ignore_prefixes``,
``extensions`` (comma-separated; they replace the defaults).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import ARCHIVE, FILES, IGNORED_DIRS, IGNORED_PREFIXES, IMAGE, MODEL


BRANCHES, LEVELS = 64, 4


@dataclass
class Branch(InputPartition):
    root: str
    top: str
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        listed = lambda key, default: tuple(x.strip() for x in options[key].split(",") if x.strip()) if key in options else default
        self.roots = [r for r in options.get("roots", options.get("path", "")).split("\n") if r.strip()]
        self.dirs = frozenset(d.lower() for d in listed("ignore_dirs", IGNORED_DIRS))
        self.prefixes = listed("ignore_prefixes", IGNORED_PREFIXES)
        self.wanted = frozenset(e.lower().lstrip(".") for e in listed("extensions", (*MODEL, *IMAGE, *ARCHIVE)))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        front = [(root, root) for root in self.roots]
        for level in range(LEVELS):
            if not front or level and len(front) >= BRANCHES:
                break
            below = []
            for root, folder in front:
                out.append(Branch(root, folder, False))
                try:
                    with os.scandir(folder) as entries:
                        below += [(root, e.path) for e in entries if self._enters(e)]
                except OSError:
                    pass  # the folder's own partition reports it
            front = below
        return out + [Branch(root, folder, True) for root, folder in front] or [Branch("", "", False)]

    def _enters(self, entry: os.DirEntry) -> bool:
        try:
            return entry.is_dir(follow_symlinks=False) and entry.name.strip().lower() not in self.dirs
        except OSError:
            return False

    def read(self, partition: Branch) -> Iterator[tuple]:
        pending = [partition.top] if partition.top else []
        while pending:
            folder = pending.pop()
            try:
                with os.scandir(folder) as entries:
                    found = list(entries)
            except OSError:
                yield (partition.root, folder, None, None, None, True)
                continue
            for entry in sorted(found, key=lambda e: e.name):
                try:
                    if entry.is_dir():
                        if partition.deep and self._enters(entry):
                            pending.append(entry.path)
                        continue
                except OSError:
                    continue
                if entry.name.startswith(self.prefixes) or os.path.splitext(entry.name)[1].lower().lstrip(".") not in self.wanted:
                    continue
                try:
                    size = entry.stat().st_size
                except OSError:
                    size = 0  # a dangling link keeps its row
                yield (partition.root, folder, entry.name, size, entry.is_symlink(), False)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self):
        return FILES

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, roots: list[str], **options: str) -> DataFrame:
    """root, dir, name, size, is_symlink, unreadable of all wanted files."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("file_tree").options(roots="\n".join(roots), **options).load()
