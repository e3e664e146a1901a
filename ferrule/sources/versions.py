"""Tables of several parts that change together: new folders first, one manifest last.

A store is a folder. Each part of a table (a bucket, a domain) is a folder of Parquet
files that never changes; a manifest lists the folders that make up every table. A
change writes new folders for the parts that it touches and then the next manifest, so
a reader sees all of a change or nothing of it, and a change that fails in between
leaves folders that nobody reads (see vacuum()). Two changes at a time cannot both take
the same number: the second one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        return [x.getPath().toString() for x in self._files.globStatus(self._path(f"{self.root}/{pattern}")) or []]

    def version(self) -> int:
        """Number of the newest manifest, 0 before the first."""
        return max((int(n.rsplit("/", 1)[1][:-5]) for n in self._names("_manifests/*.json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"tables": {table: {"schema": ..., "parts": {part: folder}}}, "settings": {...}} of a version, by default the newest."""
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "settings": {}}
        return json.loads(self.spark.read.text(f"{self.root}/_manifests/{version:08d}.json", wholetext=True).first()[0])

    def table(self, name: str, schema: str | None = None, parts: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """A table, or some parts of it; empty with the given schema where there is none."""
        entry = self.manifest(version)["tables"].get(name)
        if entry is None:
            return self.spark.createDataFrame([], schema or "part string")
        kinds = T.StructType.fromJson(json.loads(entry["schema"]))
        wanted = entry["parts"] if parts is None else {p: entry["parts"][p] for p in parts if p in entry["parts"]}
        folders = [f"{self.root}/{f}" for f in sorted(wanted.values())]
        return self.spark.read.schema(kinds).parquet(*folders) if folders else self.spark.createDataFrame([], kinds)

    def write(self, name: str, rows: DataFrame, part: Column | None = None, columns: list[Column | str] | None = None) -> tuple[str, str, dict[str, str]]:
        """Rows in new folders that nobody reads yet: one, or one for each value of part (a number).

        Every task writes its own file of each part that it has rows of; rows are not
        shuffled for that. columns: what is written of the rows.
        """
        folder, columns = f"{name}/{uuid.uuid4().hex}", columns or rows.columns
        schema = rows.select(*columns).schema.json()
        if part is None:
            rows.select(*columns).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            return name, schema, {"": folder}
        rows.withColumn("__part", part).select(*columns, "__part").write.partitionBy("__part").option("compression", "zstd").parquet(f"{self.root}/{folder}")
        found = {n.rsplit("=", 1)[1]: n.rsplit("/", 1)[1] for n in self._names(f"{folder}/__part=*")}
        return name, schema, {p: f"{folder}/{n}" for p, n in found.items()}

    def publish(self, changes: list[tuple[str, str, dict[str, str | None]]], based_on: int, **settings) -> int:
        """The next manifest: in each table the given parts replaced (None: gone). Returns its number."""
        if self.version() != based_on:
            raise RuntimeError(f"{self.root} was changed after version {based_on}")
        new, number = self.manifest(based_on), based_on + 1
        for name, schema, parts in changes:
            merged = {**new["tables"].get(name, {"parts": {}})["parts"], **parts}
            new["tables"][name] = {"schema": schema, "parts": {p: f for p, f in merged.items() if f is not None}}
        new["settings"].update(settings)
        name = f"{self.root}/_manifests/{number:08d}"
        draft, lock = self._path(f"{name}.{uuid.uuid4().hex}.draft"), self._path(f"{name}.lock")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(new, ensure_ascii=False).encode()))
        out.close()
        if not self._files.createNewFile(lock):
            raise RuntimeError(f"another change takes version {number}; if its writer died, delete {lock.toString()}")
        if not self._files.rename(draft, self._path(f"{name}.json")):
            raise RuntimeError(f"version {number} of {self.root} could not be published")
        return number

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that none of the newest `keep` manifests names; for times when nothing is being written."""
        newest = self.version()
        used = {f.split("/__part=")[0] for v in range(max(1, newest - keep + 1), newest + 1) for t in self.manifest(v)["tables"].values() for f in t["parts"].values()}
        gone = 0
        for path in self._names("*/*"):
            name = "/".join(path.split("/")[-2:])
            if not name.startswith("_") and name not in used:
                gone += bool(self._files.delete(self._path(path), True))
        return gone
