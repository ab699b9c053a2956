"""A source tree as a Python data source: the driver lists the upper folders only, executors walk below them and read the files.

Spark's own file index hides names that begin with ``_`` or ``.``, so ``__init__.py`` would be missing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeweave.sources.extract import detect_language
from codeweave.sources.rules import SKIPPED

FILES = "path string, content binary"


def _entered(name: str) -> bool:
    return name not in SKIPPED and not name.startswith(".")


def _walk(root: str, folder: str, below: bool = True) -> Iterator[tuple[str, str]]:
    for at, dirs, names in os.walk(folder):
        dirs[:] = sorted(filter(_entered, dirs)) if below else []
        for name in sorted(names):
            if detect_language(name):
                full = os.path.join(at, name)
                yield full, os.path.relpath(full, root).replace(os.sep, "/")


def walk(root: str) -> list[tuple[str, str]]:
    """(absolute path, relative POSIX path) of every source file, sorted; skipped and hidden directories aren't entered."""
    root = os.path.realpath(root)
    return sorted(_walk(root, root), key=lambda x: x[1])


class Branch(InputPartition):
    """A folder, with all that is below it or alone."""

    def __init__(self, folder: str, below: bool):
        self.folder, self.below = folder, below


def branches(root: str, least: int) -> list[Branch]:
    """Folders that hold the tree together, each file once: the largest level of folders is opened until there are ``least``."""
    closed, opened = [root], []
    while closed and len(closed) + len(opened) < least:
        inner = []
        for folder in closed:
            with os.scandir(folder) as entries:
                inner += [e.path for e in entries if e.is_dir(follow_symlinks=False) and _entered(e.name)]
        opened += [Branch(f, False) for f in closed]
        closed = sorted(inner)
    return [*opened, *(Branch(f, True) for f in closed)]


class TreeReader(DataSourceReader):
    def __init__(self, root: str, least: int):
        self.root, self.least = os.path.realpath(root), least

    def partitions(self) -> list[InputPartition]:
        return branches(self.root, self.least)

    def read(self, partition: Branch) -> Iterator[tuple[str, bytes]]:
        for full, relative in _walk(self.root, partition.folder, partition.below):
            try:
                with open(full, "rb") as f:
                    yield relative, f.read()
            except OSError:
                continue  # a file may go between the walk and the read


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return TreeReader(self.options["path"], int(self.options.get("branches", "32")))


def read_tree(spark: SparkSession, root: str, branches: int = 32) -> DataFrame:
    """(path, content) of every source file; ``branches``: least number of folders that are read apart."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("branches", str(branches)).load(root)
