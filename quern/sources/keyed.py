"""A keyed table of snapshots: buckets by hash of the key, a manifest for each version, commits by one file that must not exist yet.

A write reads and rewrites only the buckets that its keys are in; the new version's manifest names every bucket's folder, old or new. Readers open the last manifest, so they
see a version whole or not at all, whatever a writer is doing or where it was stopped: data without a manifest is never read, and no folder is moved or deleted by a write.
Two writers that start from the same version can't both commit it; the second one reads the first one's version and does its work again.

`vacuum` deletes what no kept version names. Null keys are a key like others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.tables import upsert


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self._files = self._at().getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._no_overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE

    def versions(self) -> list[int]:
        folder = self._at("manifests")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdecimal())

    def manifest(self, version: int | None = None) -> dict:
        """{version, buckets: {number: folder}} of a version, by default the last one; version 0 is the empty table."""
        at = (self.versions() or [0])[-1] if version is None else version
        if not at:
            return {"version": 0, "buckets": {}}
        row = self.spark.read.text(f"{self.path}/manifests/{at:020d}.json", wholetext=True).first()
        return json.loads(row.value)

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(sorted(self.manifest(version)["buckets"].values()))

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, update: list[str], order: str, tries: int = 5) -> int:
        """Commits a version with rows upserted; returns its number. No rows, no new version."""
        for left in range(tries - 1, -1, -1):
            try:
                return self._upsert(rows, update, order)
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be 1 or more")

    def _upsert(self, rows: DataFrame, update: list[str], order: str) -> int:
        before = self.manifest()
        touched = [str(r[0]) for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return before["version"]
        old = self._read(sorted(before["buckets"][b] for b in touched if b in before["buckets"]))
        folder = f"data/{uuid.uuid4().hex}"
        upsert(old, rows, self.key, update, order).withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return self.commit(before["version"] + 1, before["buckets"] | {b: f"{folder}/_bucket={b}" for b in touched})

    def commit(self, version: int, buckets: dict[str, str]) -> int:
        """Writes the manifest beside its place, then renames it there, which fails if there is one."""
        target, draft = self._at("manifests", f"{version:020d}.json"), self._at("drafts", uuid.uuid4().hex)
        if self._files.exists(target):
            raise Conflict(f"version {version} is there")
        out = self._files.create(draft, True)
        try:
            out.write(bytearray(json.dumps({"version": version, "buckets": buckets}).encode()))
        finally:
            out.close()
        self._files.mkdirs(self._at("manifests"))
        try:
            self._context.rename(draft, target, self._no_overwrite)
        except Exception as e:
            self._files.delete(draft, False)
            if self._files.exists(target):
                raise Conflict(f"version {version} is there") from e
            raise
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the data and manifests of versions before the last `keep` and of writers that didn't commit (none may be at work); returns the number of folders deleted."""
        versions = self.versions()
        named = {f for v in versions[-keep:] for f in self.manifest(v)["buckets"].values()}
        written = [s.getPath() for s in self._files.listStatus(self._at("data"))] if self._files.exists(self._at("data")) else []
        gone = []
        for folder in written:
            own = [s.getPath() for s in self._files.listStatus(folder) if s.isDirectory()]
            old = [p for p in own if f"data/{folder.getName()}/{p.getName()}" not in named]
            gone += [folder] if len(old) == len(own) else old
        for p in gone:
            self._files.delete(p, True)
        for v in versions[:-keep]:
            self._files.delete(self._at("manifests", f"{v:020d}.json"), False)
        return len(gone)
