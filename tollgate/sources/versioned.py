"""Tables that change as a whole, by a manifest.

Data files are written first, under a folder of their own that no one reads yet. Then a new manifest, the
list of the folders that make up the table, is moved into place by one rename. A write that breaks off
leaves the version before it as it was, and a reader never sees half of one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.schemas import ContractError


@dataclass(frozen=True)
class Part:
    """A folder of the table; ``key`` names what a later write of the same key replaces."""

    key: str
    folder: str
    batch: int | None = None


class VersionedTable:
    """Parquet folders under one manifest. One driver writes at a time; any number may read.

    With ``buckets``, rows are kept in as many partitions by hash of ``bucket_by``, and a read for
    some keys lists only their buckets.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int | None = None, bucket_by: str | None = None) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.buckets, self.bucket_by = buckets, bucket_by

    # Files, through whatever file system the path names.

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """Number of the newest manifest; 0 where there is none."""
        files, folder = self._at("manifests")
        if not files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def parts(self, version: int | None = None) -> list[Part]:
        version = self.version() if version is None else version
        if not version:
            return []
        files, path = self._at(f"manifests/v{version:012d}.json")
        stream = files.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Part(**p) for p in json.loads(text)]

    def publish(self, parts: list[Part], version: int) -> None:
        files, draft = self._at(f"manifests/_{uuid.uuid4().hex}")
        out = files.create(draft)
        try:
            out.write(bytearray(json.dumps([asdict(p) for p in parts]).encode()))
        finally:
            out.close()
        _, place = self._at(f"manifests/v{version:012d}.json")
        if files.exists(place) or not files.rename(draft, place):
            raise ContractError(f"version {version} of {self.path} was written by someone else")

    # Rows.

    def bucket_of(self, key: str | None = None):
        return F.pmod(F.xxhash64(key or self.bucket_by), F.lit(self.buckets)).cast("int")

    def store(self, df: DataFrame) -> str:
        folder = f"data/_part={uuid.uuid4().hex}"
        rows = df.select(*self.schema.fieldNames())
        writer = rows.write
        if self.buckets:
            writer = rows.withColumn("_bucket", self.bucket_of()).repartition("_bucket").write.partitionBy("_bucket")
        writer.parquet(f"{self.path}/{folder}")
        return folder

    def put(self, df: DataFrame, key: str, batch: int | None = None) -> None:
        """Write the rows of a key, in place of those it had."""
        version = self.version()
        new = Part(key, self.store(df), batch)
        self.publish([p for p in self.parts(version) if p.key != key] + [new], version + 1)

    def replace(self, df: DataFrame) -> None:
        """Write the whole table anew."""
        version = self.version()
        self.publish([Part("all", self.store(df))], version + 1)

    def rows(self, parts: list[Part] | None = None, buckets: list[int] | None = None) -> DataFrame:
        parts = self.parts() if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        places = [T.StructField("_part", T.StringType()), *([T.StructField("_bucket", T.IntegerType())] if self.buckets else [])]
        reader = self.spark.read.schema(T.StructType([*self.schema.fields, *places])).option("basePath", f"{self.path}/data")
        df = reader.parquet(*[f"{self.path}/{p.folder}" for p in parts])
        if buckets is not None:
            df = df.where(F.col("_bucket").isin(buckets))
        return df.select(*self.schema.fieldNames())

    def compact(self, before: int) -> None:
        """One folder in place of those of all batches before one; the rows stay the same."""
        version = self.version()
        parts = self.parts(version)
        old = [p for p in parts if p.batch is not None and p.batch < before]
        if len(old) < 2:
            return
        last = max(p.batch for p in old)
        merged = Part(f"upto-{last}", self.store(self.rows(old)), last)
        self.publish([p for p in parts if p not in old] + [merged], version + 1)
