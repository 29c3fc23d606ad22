"""A bucketed Parquet table whose commits replace whole buckets atomically.

Every commit writes its buckets to a new folder and then swaps one small
manifest file by an atomic rename, so a reader sees the state before or after
a commit and never a mixture. A job that dies half way leaves only an
unreferenced folder.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Manifest:
    version: int = 0
    buckets: dict[str, str] = field(default_factory=dict)  # bucket -> folder of the commit that wrote it
    facts: dict = field(default_factory=dict)


class VersionedTable:
    """``bucket`` is a LONG column of ``schema``; the manifest has one entry for each of its values."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, bucket: str):
        self.spark, self.path, self.schema, self.bucket = spark, path.rstrip("/"), schema, bucket
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest:
        at = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_CURRENT")
        if not self._fs.exists(at):
            return Manifest()
        stream = self._fs.open(at)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def read(self, lowest: int | None = None, highest: int | None = None, only: set[int] | None = None) -> DataFrame:
        """All rows, or those of the buckets from ``lowest`` to ``highest``, or of the buckets in ``only``."""
        manifest = self.manifest()
        by_folder: dict[str, list[int]] = {}
        skipped: set[str] = set(manifest.facts.get("partial", []))
        for b, folder in manifest.buckets.items():
            k = int(b)
            if (lowest is None or k >= lowest) and (highest is None or k <= highest) and (only is None or k in only):
                by_folder.setdefault(folder, []).append(k)
            else:
                skipped.add(folder)
        out = None
        for folder, buckets in sorted(by_folder.items()):
            part = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")
            if folder in skipped:
                part = part.where(F.col(self.bucket).isin(buckets))
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def commit(self, rows: DataFrame, replaced: set[int], measure: Column | None = None) -> Manifest:
        """Replace the buckets in ``replaced`` by ``rows``; buckets of ``rows`` beyond them are added, and must be new.

        The driver gets one row per written bucket, a number bounded by the
        time span of the table. The manifest keeps the largest ``measure`` of
        each bucket.
        """
        old = self.manifest()
        folder = f"c{old.version + 1:06d}-{uuid.uuid4().hex[:8]}"
        rows.select(*self.schema.fieldNames()).write.parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")
        now = written.groupBy(self.bucket).agg(F.max(F.lit(0) if measure is None else measure)).collect()
        gone = {str(b) for b in replaced}
        clash = {str(b) for b, _ in now} & (set(old.buckets) - gone)
        if clash:
            raise ValueError(f"rows of buckets that are not replaced: {sorted(clash)[:5]}")
        kept = {b: f for b, f in old.buckets.items() if b not in gone}
        buckets = kept | {str(b): folder for b, _ in now}
        partial = {f for b, f in old.buckets.items() if b in gone} | set(old.facts.get("partial", []))
        largest = {b: m for b, m in old.facts.get("largest", {}).items() if b in kept} | {str(b): m for b, m in now}
        new = Manifest(old.version + 1, buckets, {"partial": sorted(partial & set(buckets.values())), "largest": largest})
        self._swap(json.dumps(new.__dict__))
        return new

    def vacuum(self) -> int:
        """Delete the folders that no bucket of the manifest lies in, for the time when nobody reads an older version; their number."""
        live, gone = set(self.manifest().buckets.values()), 0
        for status in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(self.path)):
            name = status.getPath().getName()
            if status.isDirectory() and name not in live:
                self._fs.delete(status.getPath(), True)
                gone += 1
        return gone

    def _swap(self, text: str) -> None:
        fs = self._jvm.org.apache.hadoop.fs
        temp = fs.Path(f"{self.path}/_CURRENT.{uuid.uuid4().hex}")
        stream = self._fs.create(temp, True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        context = fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(temp), self._fs.makeQualified(fs.Path(f"{self.path}/_CURRENT")), options)
