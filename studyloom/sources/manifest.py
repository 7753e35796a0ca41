"""Versions of a set of Parquet folders: each commit is a small file that names the folders of every table.

A commit is written beside the others and renamed into place, and a version that exists is not replaced, so readers see
one version or the next and never half of one. Folders are only added; vacuum() deletes what no kept version names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..schema import StorageError


@dataclass(frozen=True)
class Snapshot:
    version: int
    schema: int
    tables: dict[str, list[str]]
    #: append, or replace where folders hold the rows of others anew.
    kind: str = "append"


class Manifest:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        p = self.path(name)
        return p.getFileSystem(self.conf).exists(p)

    def _versions(self) -> list[int]:
        if not self.exists("_manifest"):
            return []
        p = self.path("_manifest")
        names = [s.getPath().getName() for s in p.getFileSystem(self.conf).listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> Snapshot | None:
        found = self._versions()
        return self.at(found[-1]) if found else None

    def at(self, version: int) -> Snapshot:
        p = self.path(f"_manifest/{version:08d}.json")
        fs = p.getFileSystem(self.conf)
        if not fs.exists(p):
            raise StorageError(f"there is no version {version}")
        stream = fs.open(p)
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        own = json.loads(text)
        return Snapshot(version, own["schema"], own["tables"], own.get("kind", "append"))

    def commit(self, before: Snapshot | None, schema: int, tables: dict[str, list[str]], kind: str = "append") -> Snapshot:
        """The version after `before`; an error if another writer was faster."""
        version = before.version + 1 if before else 1
        draft, final = self.path(f"_manifest/{uuid.uuid4().hex}.draft"), self.path(f"_manifest/{version:08d}.json")
        fs = draft.getFileSystem(self.conf)
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"schema": schema, "tables": tables, "kind": kind}, sort_keys=True).encode()))
        finally:
            out.close()
        # rename() of a file system may replace what is there; FileContext's does not.
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self.jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(self.conf), self.conf).rename(draft, final, none)
        except Exception as taken:
            fs.delete(draft, False)
            raise StorageError(f"version {version} was written by someone else") from taken
        return Snapshot(version, schema, tables, kind)

    def new_folder(self, table: str) -> str:
        return f"data/{table}-{uuid.uuid4().hex}"

    def vacuum(self, keep: int = 1) -> int:
        """Delete versions but the last `keep`, and folders under data/ that no kept one names; how many folders went."""
        versions = self._versions()
        kept, gone = versions[-max(1, keep) :], versions[: -max(1, keep)]
        named = {f for v in kept for own in self.at(v).tables.values() for f in own}
        p = self.path("data")
        fs = p.getFileSystem(self.conf)
        folders = [f"data/{s.getPath().getName()}" for s in fs.listStatus(p)] if fs.exists(p) else []
        for v in gone:
            fs.delete(self.path(f"_manifest/{v:08d}.json"), False)
        lost = [f for f in folders if f not in named]
        for f in lost:
            fs.delete(self.path(f), True)
        return len(lost)
