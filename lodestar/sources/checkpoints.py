"""A store of values by key: one version for each commit, the latest by key, listing by prefix without reading all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class CheckpointStore:
    """Values under text keys, in a folder that driver and executors share.

    A commit is one version: a folder ``version=<n>`` of Parquet files, in which keys are dealt to ``buckets`` by
    range and sorted, so that a file's statistics tell which keys it may hold, and a read of one key or one
    prefix skips the other files.  A version counts once its ``_SUCCESS`` mark is there: what a writer that died
    has left is not seen, and the next commit of that number replaces it.  A key may be committed again; the
    latest version holds.  A key whose columns are all null is a deleted one.  ``compact`` merges versions.

    One writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, location: str, value: str | StructType, buckets: int = 8):
        """value: the type of values, as DDL of the columns beside ``key``."""
        self.spark, self.location, self.buckets = spark, location.rstrip("/"), buckets
        self.layout = spark.createDataFrame([], value).schema

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{name}" if name else self.location)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of complete versions, in order; a merged one hides those before it."""
        path, fs = self._path()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [n for n in names if n.startswith("version=") and fs.exists(self._path(f"{n}/_SUCCESS")[0])]
        numbers = sorted({int(n.split("=")[1].split("-")[0]) for n in done})
        merged = [int(n.split("=")[1].split("-")[0]) for n in done if n.endswith("-merged")]
        return [n for n in numbers if n >= max(merged, default=0)]

    def _name(self, version: int) -> str:
        merged = f"version={version:09d}-merged"
        path, fs = self._path(f"{merged}/_SUCCESS")
        return merged if fs.exists(path) else f"version={version:09d}"

    def _write(self, rows: DataFrame, name: str) -> None:
        ordered = rows.repartitionByRange(self.buckets, "key").sortWithinPartitions("key")
        ordered.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.location}/{name}")

    def commit(self, rows: DataFrame) -> int:
        """Writes ``rows`` (key and the value's columns; of equal keys one counts) as the next version and gives its
        number."""
        number = max(self.versions(), default=0) + 1
        self._write(rows.select("key", *self.layout.names).dropDuplicates(["key"]), f"version={number:09d}")
        return number

    def delete(self, keys: DataFrame) -> int:
        """Commits that ``keys`` (key) have no value."""
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.layout]
        return self.commit(keys.select("key", *empty))

    def _all(self, versions: list[int], where) -> DataFrame:
        schema = StructType([*self.spark.createDataFrame([], "key string").schema, *self.layout])
        out = self.spark.createDataFrame([], schema).withColumn("version", F.lit(0))
        for n in versions:
            part = self.spark.read.schema(schema).parquet(f"{self.location}/{self._name(n)}").filter(where)
            out = out.unionByName(part.withColumn("version", F.lit(n)))
        return out

    def _latest(self, where) -> DataFrame:
        rows = self._all(self.versions(), where)
        last = F.row_number().over(Window.partitionBy("key").orderBy(F.col("version").desc())) == 1
        some = F.lit(False)
        for c in self.layout.names:
            some = some | F.col(c).isNotNull()
        return rows.withColumn("last", last).filter(F.col("last") & some).drop("last", "version")

    def read(self) -> DataFrame:
        """key and value: the latest of each key."""
        return self._latest(F.lit(True))

    def get(self, key: str) -> DataFrame:
        """The row of one key, if it has one."""
        return self._latest(F.col("key") == key)

    def list(self, prefix: str) -> DataFrame:
        """key and value of the keys that begin with ``prefix``.  The bounds of such keys are a range, which is compared
        with the statistics of files and row groups."""
        if not prefix:
            return self.read()
        where = F.col("key") >= prefix
        head = prefix.rstrip("\U0010ffff")
        if head:  # the first text behind all that begin with the prefix
            code = ord(head[-1]) + 1
            where = where & (F.col("key") < head[:-1] + chr(0xE000 if 0xD800 <= code <= 0xDFFF else code))
        return self._latest(where & F.startswith("key", F.lit(prefix)))

    def compact(self) -> None:
        """Merges all versions to one.  If it dies half-way the versions are as they were; if it dies between the
        merged version's mark and the end, the old ones are hidden by it and go next time."""
        numbers = self.versions()
        path, fs = self._path()
        if len(numbers) > 1:
            self._write(self.read(), f"version={numbers[-1]:09d}-merged")
        for status in fs.listStatus(path) if fs.exists(path) else []:
            name = status.getPath().getName()
            if name.startswith("version=") and (int(name.split("=")[1].split("-")[0]) < max(self.versions(), default=0) or f"{name}-merged" == self._name(max(self.versions()))):
                fs.delete(status.getPath(), True)
