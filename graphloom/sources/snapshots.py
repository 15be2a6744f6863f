"""Stored tables that change: a bucketed base, a change log, and a manifest for each version.

Files are written once and never changed.  A version is a small manifest that names, for
each bucket of the keys' hash, the folder of its base and those of its changes; it appears
by a rename that fails if the name is taken, so a reader sees one version or the next and
never a part of it, and of two writers at once one gets an error.  An upsert writes the new
rows alone, into the buckets they belong to; a reader merges a bucket's changes only where
it has some, and compaction folds them into a new base of those buckets.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = 1


class Conflict(RuntimeError):
    """Another writer made the version first."""


class Snapshots:
    """A table at ``path``, in a store that renames atomically; ``keys`` tell its rows apart.

    Without a version of this format the table is empty.  Rows of one write that are equal
    in key are one row, the greatest; null keys are keys.  The columns are those of
    ``schema``, whatever their names, but for two that begin with ``__snap``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.stored = T.StructType([*self.schema.fields, T.StructField("__snap_at", T.LongType()), T.StructField("__snap_gone", T.BooleanType())])
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests ------------------------------------------------------------------------
    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json")]

    def _manifest(self, version: int | None = None) -> dict:
        have = self.versions()
        version = version if version is not None else max(have, default=0)
        empty = {"version": version, "format": FORMAT, "buckets": self.buckets, "entries": {}}
        if version not in have:
            return empty
        stream = self.fs.open(self._path(f"{self.path}/manifest/{version:010d}.json"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        got = json.loads(text)
        return got if got["format"] == FORMAT else empty

    def _commit(self, version: int, entries: dict, buckets: int) -> int:
        """Makes the manifest under a name of its own and renames it, never over another."""
        jvm = self.spark._jvm
        folder = f"{self.path}/manifest"
        self.fs.mkdirs(self._path(folder))
        draft, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{version:010d}.json")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps({"version": version, "format": FORMAT, "buckets": buckets, "entries": entries}), "utf-8"))
        out.close()
        none = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, none)
        except Exception as e:
            self.fs.delete(draft, False)
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} of {self.path} is another writer's") from None
            raise
        return version

    # -- rows -----------------------------------------------------------------------------
    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(buckets)).cast("int")

    def _one_each(self, rows: DataFrame) -> DataFrame:
        """The row of the latest change of each key; of one write the greatest."""
        kept = [f.name for f in self.stored.fields if f.name not in self.keys]
        latest = F.max(F.struct("__snap_at", *(f"`{c}`" for c in kept if c != "__snap_at"))).alias("__snap")
        return rows.groupBy(*(f"`{k}`" for k in self.keys)).agg(latest).select(*(F.col(f"`{f.name}`" if f.name in self.keys else f"__snap.`{f.name}`").alias(f.name) for f in self.stored.fields))

    def _save(self, rows: DataFrame, kind: str, buckets: int) -> dict[str, str]:
        """Writes rows of ``stored`` in a folder for each bucket they fall in: {bucket: folder}."""
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.withColumn("__snap_bucket", self._bucket(buckets)).repartition("__snap_bucket").write.partitionBy("__snap_bucket").parquet(f"{self.path}/{name}")
        return {n.partition("=")[2]: f"{name}/{n}" for n in self._names(name) if n.startswith("__snap_bucket=")}

    def _load(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.stored)

    def _marked(self, rows: DataFrame, version: int, gone: bool) -> DataFrame:
        own = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        return own.select("*", F.lit(version).cast("long").alias("__snap_at"), F.lit(gone).alias("__snap_gone"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest one unless told."""
        entries = self._manifest(version)["entries"]
        still = self._load([e["base"] for e in entries.values() if e["base"] and not e["log"]])
        moved = self._load([f for e in entries.values() if e["log"] for f in [e["base"], *e["log"]] if f])
        return still.unionByName(self._one_each(moved)).where("not __snap_gone").drop("__snap_at", "__snap_gone")

    def write(self, rows: DataFrame) -> int:
        """K1, K2: a version of these rows alone."""
        version = max(self.versions(), default=0) + 1
        base = self._save(self._one_each(self._marked(rows, version, False)), "base", self.buckets)
        return self._commit(version, {b: {"base": f, "log": []} for b, f in base.items()}, self.buckets)

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """New rows take the place of those with equal keys; rows with the keys of ``gone`` go."""
        old = self._manifest()
        version = old["version"] + 1
        changes = self._marked(rows, version, False)
        if gone is not None:
            changes = changes.unionByName(self._marked(gone.select(*(f"`{k}`" for k in self.keys)), version, True))
        entries = dict(old["entries"])
        for bucket, folder in self._save(self._one_each(changes), "log", old["buckets"]).items():
            had = entries.get(bucket, {"base": None, "log": []})
            entries[bucket] = {"base": had["base"], "log": [*had["log"], folder]}
        return self._commit(version, entries, old["buckets"])

    def compact(self, logs: int = 1) -> int:
        """Folds the changes of buckets that have ``logs`` folders of them or more into new bases; the rows stay."""
        old = self._manifest()
        full = {b: e for b, e in old["entries"].items() if len(e["log"]) >= max(logs, 1)}
        if not full:
            return old["version"]
        rows = self._one_each(self._load([f for e in full.values() for f in [e["base"], *e["log"]] if f])).where("not __snap_gone")
        base = self._save(rows, "base", old["buckets"])
        entries = {b: e for b, e in old["entries"].items() if b not in full} | {b: {"base": f, "log": []} for b, f in base.items()}
        return self._commit(old["version"] + 1, entries, old["buckets"])

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the last ``keep`` versions, and the folders that none of those names; not while others write."""
        have = self.versions()
        for v in have[:-keep]:
            self.fs.delete(self._path(f"{self.path}/manifest/{v:010d}.json"), False)
        used = {f.split("/")[0] for v in have[-keep:] for e in self._manifest(v)["entries"].values() for f in [e["base"], *e["log"]] if f}
        lost = [n for n in self._names("") if n.startswith(("base-", "log-")) and n not in used]
        for n in lost:
            self.fs.delete(self._path(f"{self.path}/{n}"), True)
        return lost
