"""Stored graphs: versioned Parquet folders, pointers to the current one, and a registry of projects.

A build writes a new version beside the old one and then a pointer, a file of one line with the next number.
The pointer with the highest number counts; none is ever written over, so whatever a build that fails or two
builds at once leave behind, readers see one graph whole. The version before stays until the next build, for
readers that hold it open. The registry has such pointers too, in a folder for each project. Paths go through
Hadoop's file system, so any store that Spark can write will do.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from codeweave.schema import SCHEMA_VERSION, TABLES, Graph, struct
from codeweave.sources.extract import EXTRACT_DDL

MANIFEST = "path string, hash string"


def slug(root: str) -> str:
    name = re.sub(r"[^A-Za-z0-9_.-]", "-", root.rstrip("/").rsplit("/", 1)[-1]) or "repo"
    return f"{name}-{hashlib.sha1(root.encode()).hexdigest()[:10]}"


class Store:
    """Small text files by path, through Hadoop."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Written beside and then put there whole, if there is no file yet; False if there is one.

        A rename fails where the target exists, but for local file systems, which replace it; there it is a link, which fails.
        """
        fs, p = self._at(path)
        _, new = self._at(f"{path}.{uuid.uuid4().hex}.new")
        stream = fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            return self._linked(new, p) if fs.getScheme() == "file" else bool(not fs.exists(p) and fs.rename(new, p))
        finally:
            fs.delete(new, False)

    def _linked(self, new, p) -> bool:
        source, target = (self._jvm.java.io.File(x.toUri().getPath()).toPath() for x in (new, p))
        try:
            self._jvm.java.nio.file.Files.createLink(target, source)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        return True

    def names(self, path: str) -> list[str]:
        """Names of the files and folders in a folder; none where there is none."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def point(self, folder: str, text: str) -> None:
        """Makes ``text`` what the folder's newest pointer says."""
        while not self.create(f"{folder}/CURRENT.{(self._pointers(folder) or [0])[-1] + 1:012d}", text):
            pass  # another writer had the number

    def _pointers(self, folder: str) -> list[int]:
        return sorted(int(m[1]) for n in self.names(folder) if (m := re.fullmatch(r"CURRENT\.(\d{12})", n)))

    def pointed(self, folder: str) -> list[dict]:
        """What a folder's pointers say, the newest first; broken ones count for nothing."""
        found = []
        for n in reversed(self._pointers(folder)):
            try:
                found.append(json.loads(self.read(f"{folder}/CURRENT.{n:012d}") or "null"))
            except ValueError:
                continue
        return [f for f in found if isinstance(f, dict)]

    def forget(self, folder: str, keep: int = 2) -> None:
        """Removes all but the newest pointers."""
        for n in self._pointers(folder)[:-keep]:
            self.delete(f"{folder}/CURRENT.{n:012d}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)


class Catalog:
    """All projects under one home folder."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home, self.store = spark, home.rstrip("/"), Store(spark)

    # registry
    def projects(self) -> list[dict]:
        """Registered projects by root; a broken entry counts as none."""
        known = [found[0] for name in self.store.names(f"{self.home}/registry") if (found := self.store.pointed(f"{self.home}/registry/{name}"))]
        return sorted(known, key=lambda p: p["root"])

    def register(self, root: str, stats: dict[str, int]) -> None:
        entry = {"root": root, "slug": slug(root), "db": self.folder(root), "stats": stats, "last_indexed": time.strftime("%Y-%m-%dT%H:%M:%S")}
        self.store.point(f"{self.home}/registry/{slug(root)}", json.dumps(entry, sort_keys=True))
        self.store.forget(f"{self.home}/registry/{slug(root)}")

    def folder(self, root: str) -> str:
        return f"{self.home}/projects/{slug(root)}"

    # one project
    def current(self, root: str) -> dict | None:
        """Version, schema and stats of the current graph."""
        meta = next(iter(self.store.pointed(self.folder(root))), None)
        return meta if meta and meta.get("schema") == SCHEMA_VERSION else None

    def _read(self, path: str, ddl: str) -> DataFrame:
        if not self.store.exists(path):
            return self.spark.createDataFrame([], struct(ddl))
        return self.spark.read.schema(struct(ddl)).parquet(path)

    def table(self, root: str, name: str, ddl: str) -> DataFrame:
        meta = self.current(root)
        return self._read(f"{self.folder(root)}/{meta['version']}/{name}", ddl) if meta else self.spark.createDataFrame([], struct(ddl))

    def graph(self, root: str) -> Graph | None:
        """The current graph; everything in it is of one version."""
        if self.current(root) is None:
            return None
        return Graph(**{name: self.table(root, name, ddl) for name, ddl in TABLES.items()})

    def views(self, root: str) -> None:
        """The current tables as temporary views, for ``spark.sql``."""
        for name, ddl in TABLES.items():
            self.table(root, name, ddl).createOrReplaceTempView(name)

    def manifest(self, root: str) -> DataFrame:
        return self.table(root, "manifest", MANIFEST)

    def extracts(self, root: str) -> DataFrame:
        return self._read(f"{self.folder(root)}/extracts", EXTRACT_DDL)

    def add_extracts(self, root: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder(root)}/extracts")

    def new_version(self, root: str) -> str:
        return f"{self.folder(root)}/v-{uuid.uuid4().hex}"

    def publish(self, root: str, path: str, stats: dict[str, int]) -> None:
        """Make a written version current; the one before stays, older ones go."""
        folder, version = self.folder(root), path.rsplit("/", 1)[-1]
        self.store.point(folder, json.dumps({"version": version, "schema": SCHEMA_VERSION, "stats": stats}))
        self.register(root, stats)
        for old in self.store.pointed(folder)[2:]:  # versions that were never published may be another build's
            self.store.delete(f"{folder}/{old['version']}")
        self.store.forget(folder)
