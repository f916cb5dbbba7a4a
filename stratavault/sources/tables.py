"""Folders and tables on whatever file system Spark reads: helpers, tiers, sorted segments with a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import keyvalue


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below that a job has written to its end."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    return [n for n in names if exists(spark, f"{path}/{n}/_SUCCESS")]


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    fs, p = _at(spark, path)
    return fs.getContentSummary(p).getLength()


def readable(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder that may be read."""
    fs, p = _at(spark, path)
    try:
        fs.access(p, spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsAction.READ)
    except Exception as e:
        if "AccessControlException" in str(e) or "FileNotFoundException" in str(e):
            return False
        raise
    return True


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copies a file or folder; the target appears whole or not at all."""
    util = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
    (a, p), (b, q) = _at(spark, source), _at(spark, target)
    _, part = _at(spark, f"{target}.{uuid.uuid4().hex}.part")
    b.mkdirs(q.getParent())
    util.copy(a, p, b, part, False, spark.sparkContext._jsc.hadoopConfiguration())
    b.delete(q, True)
    if not b.rename(part, q):
        raise OSError(f"{target} can't be put in place")


def in_memory(rows: DataFrame, name: str) -> DataFrame:
    """A table that lives in executors' memory (and on their disks where that is short) under a name that SQL can use."""
    held = rows.persist()
    held.createOrReplaceTempView(name)
    return held


class Tiers:
    """A cache folder in front of a backend folder, any two that Spark reads (HDFS, object stores, disks).

    New files are put into the cache and queued; ``drain`` stores what is queued in the
    backend.  ``open`` gives the cached copy, restoring it first if need be, and
    evicts stored files that were used least recently while the cache is over budget.
    Order of use is kept by the driver that runs the tiers.
    """

    def __init__(self, spark: SparkSession, cache: str, backend: str, budget: int):
        self.spark, self.cache, self.backend, self.budget = spark, cache, backend, budget
        self.used: dict[str, int] = {}  # name to bytes, least recently used first
        self.queue: list[str] = []

    def add(self, name: str) -> None:
        """Takes a file or folder that is already in the cache."""
        self.used[name] = size_of(self.spark, f"{self.cache}/{name}")
        self.queue.append(name)

    def drain(self) -> int:
        """Stores all queued files; one that is queued stays so until its copy is whole."""
        stored = 0
        while self.queue:
            copy(self.spark, f"{self.cache}/{self.queue[0]}", f"{self.backend}/{self.queue[0]}")
            self.queue.pop(0)
            stored += 1
        self._fit()
        return stored

    def open(self, name: str) -> str:
        path = f"{self.cache}/{name}"
        if name in self.used:
            self.used[name] = self.used.pop(name)
            return path
        if not exists(self.spark, f"{self.backend}/{name}"):
            raise FileNotFoundError(name)
        copy(self.spark, f"{self.backend}/{name}", path)
        self.used[name] = size_of(self.spark, path)
        self._fit(keep=name)
        return path

    def _fit(self, keep: str | None = None) -> None:
        total = sum(self.used.values())
        for name in list(self.used):
            if total <= self.budget:
                break
            if name != keep and name not in self.queue:
                delete(self.spark, f"{self.cache}/{name}")
                total -= self.used.pop(name)


class SortedTable:
    """A key-value change log as sorted Parquet segments and a manifest.

    A segment is a folder of files ranged and sorted by key, with statistics for range
    pruning and Bloom filters for point lookups.  ``manifest/V.json`` lists the
    segments of version V; a version exists once its file does, so a write that fails
    half-way changes nothing, and readers of an older version go on undisturbed.
    """

    def __init__(self, spark: SparkSession, root: str, codec: str = "snappy", files: int = 8):
        self.spark, self.root, self.codec, self.files = spark, root, codec, files
        make_folder(spark, f"{root}/manifest")

    def _versions(self) -> list[int]:
        fs, p = _at(self.spark, f"{self.root}/manifest")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def segments(self, version: int | None = None) -> list[str]:
        known = self._versions()
        if not known:
            return []
        fs, p = _at(self.spark, f"{self.root}/manifest/{known[-1] if version is None else version}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, segments: list[str]) -> int:
        version = (self._versions() or [-1])[-1] + 1
        fs, p = _at(self.spark, f"{self.root}/manifest/{version}.json")
        stream = fs.create(p, False)  # another writer's version is not overwritten
        try:
            stream.write(bytearray(json.dumps(segments).encode()))
        finally:
            stream.close()
        return version

    def _segment(self, rows: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        out = rows.repartitionByRange(self.files, "key").sortWithinPartitions("key", F.desc("seq"))
        out.write.option("compression", self.codec).option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.root}/{name}")
        return name

    def write(self, changes: DataFrame) -> int:
        """Appends an ordered group of changes (key, seq, op, value) as one version; all of them or none."""
        return self._commit([*self.segments(), self._segment(changes)])

    def log(self, version: int | None = None) -> DataFrame | None:
        names = self.segments(version)
        return self.spark.read.parquet(*[f"{self.root}/{n}" for n in names]) if names else None

    def get(self, keys: list, version: int | None = None) -> DataFrame:
        """The latest values of a few keys; files without them are skipped by statistics and Bloom filters."""
        return keyvalue.latest(self.log(version).where(F.col("key").isin(keys)))

    def compact(self, start=None, end=None) -> int:
        """One segment in place of all: of keys in [start, end) only the last change, and none that is a deletion."""
        log = self.log()
        inside = F.lit(True) if start is None else F.col("key") >= start
        inside = inside if end is None else inside & (F.col("key") < end)
        kept = keyvalue.latest(log.where(inside)).withColumn("op", F.lit("put")).unionByName(log.where(~inside))
        return self._commit([self._segment(kept.select(log.columns))])

    def vacuum(self) -> None:
        """Drops segments that the newest version doesn't have, and older versions."""
        keep, versions = set(self.segments()), self._versions()
        fs, p = _at(self.spark, self.root)
        for v in versions[:-1]:
            delete(self.spark, f"{self.root}/manifest/{v}.json")
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith("segment-") and name not in keep:
                delete(self.spark, f"{self.root}/{name}")

    def repair(self) -> int:
        """A new manifest of every whole segment in the folder, for when the manifests are lost or can't be read."""
        whole = [n for n in finished(self.spark, self.root) if n.startswith("segment-")]
        make_folder(self.spark, f"{self.root}/manifest")
        return self._commit(whole)

    def stats(self) -> DataFrame:
        """(file, n_changes, n_bytes, low, high) of each file of the newest version."""
        log = self.log()
        return log.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_changes"), F.max("_metadata.file_size").alias("n_bytes"), F.min("key").alias("low"), F.max("key").alias("high"))

    def dump(self) -> DataFrame:
        """Every change with the file that holds it."""
        return self.log().select("*", F.col("_metadata.file_name").alias("file"))

    def destroy(self) -> None:
        delete(self.spark, self.root)
