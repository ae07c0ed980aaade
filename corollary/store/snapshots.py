"""Numbered immutable versions of all relations: written aside, renamed, then named as current.

A version is a manifest that names the tables of each relation. Tables lie beside the versions and are shared
by them: a relation that is as it was keeps its tables, one that only grew gets one more, with what is new.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from .scratch import root


MOST_TABLES = 16  # of one relation, before it is written whole


class VersionError(LookupError):
    pass


class Files:
    """The few file operations that a store needs, through Hadoop's interface: any shared file system will do."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.base = base.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.base, *parts]))

    def fs(self):
        return self.path().getFileSystem(self.conf)

    def exists(self, *parts: str) -> bool:
        return self.fs().exists(self.path(*parts))

    def names(self, *parts: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs().listStatus(self.path(*parts))] if self.exists(*parts) else []

    def read(self, *parts: str) -> str:
        f = self.fs().open(self.path(*parts))
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()

    def write(self, text: str, *parts: str) -> None:
        """Whole or not at all: to another name, then renamed over."""
        aside = self.path(*parts[:-1], parts[-1] + ".new")
        f = self.fs().create(aside, True)
        try:
            f.write(bytearray(text.encode()))
        finally:
            f.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self.conf).rename(aside, self.path(*parts), options)

    def rename(self, a: str, b: str) -> None:
        if not self.fs().rename(self.path(a), self.path(b)):
            raise OSError(f"can't rename {a} to {b}")

    def delete(self, *parts: str) -> None:
        self.fs().delete(self.path(*parts), True)


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        if folder is None:
            folder = f"{root(spark)}/snapshots-{uuid.uuid4().hex}"
        self.folder, self.files, self.retain = folder.rstrip("/"), Files(spark, folder), 0

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.files.names() if n.isdigit())

    def current(self) -> int:
        """0 before the first publication."""
        return int(self.files.read("CURRENT")) if self.files.exists("CURRENT") else 0

    def publish(self, relations: dict[str, DataFrame], same: set[str] = frozenset(), grown: dict[str, DataFrame] | None = None, placed: dict[str, list[str]] | None = None) -> int:
        """same: relations as they are in the current version; grown: what was added to others (a version must be there); placed: tables of relations that are in the folder already."""
        version = max([self.current(), *self.versions()], default=0) + 1
        before = self._manifest(self.current()) if same or grown else {}
        aside = f"{version}.tmp"
        self.files.delete(aside)
        manifest = {}
        for name, df in sorted(relations.items()):
            old = before.get(name)
            if name in (placed or {}):
                manifest[name] = {"tables": placed[name], "schema": df.schema.json()}
                continue
            if old and name in same:
                manifest[name] = old
                continue
            add = (grown or {}).get(name) if old and len(old["tables"]) < MOST_TABLES else None
            table = f"tables/{name.replace('/', '_')}-{uuid.uuid4().hex}"
            (df if add is None else add).write.parquet(f"{self.folder}/{table}")
            manifest[name] = {"tables": [*(old["tables"] if add is not None else ()), table], "schema": df.schema.json()}
        self.files.write(json.dumps(manifest), aside, "manifest.json")
        self.files.rename(aside, str(version))
        self.files.write(str(version), "CURRENT")
        self.prune()
        return version

    def prune(self) -> None:
        """Deletes versions beyond those retained, and tables that no version names."""
        if self.retain > 0:
            gone = [v for v in self.versions()[: -self.retain] if v != self.current()]
            for v in gone:
                self.files.delete(str(v))
            if gone:
                used = {t for v in self.versions() for m in self._manifest(v).values() for t in m["tables"]}
                for name in self.files.names("tables"):
                    if f"tables/{name}" not in used:
                        self.files.delete("tables", name)

    def relations(self, version: int) -> list[str]:
        return sorted(self._manifest(version))

    def _manifest(self, version: int) -> dict:
        if version < 1 or not self.files.exists(str(version), "manifest.json"):
            raise VersionError(f"there is no version {version}")
        return json.loads(self.files.read(str(version), "manifest.json"))

    def read(self, version: int, relation: str) -> DataFrame:
        from pyspark.sql.types import StructType

        manifest = self._manifest(version)
        if relation not in manifest:
            raise VersionError(f"version {version} has no relation {relation}")
        m = manifest[relation]
        return self.spark.read.schema(StructType.fromJson(json.loads(m["schema"]))).parquet(*(f"{self.folder}/{t}" for t in m["tables"]))
