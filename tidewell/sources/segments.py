"""Tables of made values that grow by immutable segments, and work that resumes where it stopped.

A segment is a folder of Parquet by hash bucket. A manifest, committed by a rename that never replaces,
names the segments that count; what an interrupted or overtaken writer leaves is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class _Files:
    """A folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.top = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.top.getFileSystem(conf)
        self.top = self.fs.makeQualified(self.top)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.top.toUri(), conf)
        self.no_options = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.top, name)

    def names(self) -> list[str]:
        if not self.fs.exists(self.top):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.top)]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file could be made: it appears whole or not at all, and never in place of another."""
        part = self.at(f".part-{uuid.uuid4().hex}")
        stream = self.fs.create(part)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self.context.rename(part, self.at(name), self.no_options)
        except Py4JJavaError as e:
            self.fs.delete(part, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class Segments:
    """Rows by ``key``, each key once, below the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.manifests, self.folders = _Files(spark, f"{self.path}/manifest"), _Files(spark, f"{self.path}/segments")

    def _manifest(self) -> tuple[int, dict]:
        """The last version, 0 if none, and what it says: the segments that count and the rows' schema."""
        last = max((int(n) for n in self.manifests.names() if n.isdigit()), default=0)
        return last, json.loads(self.manifests.read(f"{last:012d}")) if last else {"segments": [], "schema": None}

    def _commit(self, version: int, said: dict) -> bool:
        return self.manifests.create(f"{version:012d}", json.dumps(said))

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, segments: list[str], schema: str) -> DataFrame:
        paths = [f"{self.path}/segments/segment={s}" for s in segments]
        return self.spark.read.schema(f"{schema}, bucket int").option("basePath", f"{self.path}/segments").parquet(*paths)

    def read(self, wanted: DataFrame | None = None) -> DataFrame | None:
        """All rows, or those of the keys of ``wanted``, for which only their buckets are read; None while there is no segment."""
        return self._read(self._manifest()[1], wanted)

    def _read(self, said: dict, wanted: DataFrame | None) -> DataFrame | None:
        if not said["segments"]:
            return None
        rows = self._rows(said["segments"], said["schema"])
        if wanted is None:
            return rows.drop("bucket", "segment")
        keys = wanted.select(self.key).distinct().withColumn("bucket", self._bucket())
        some = [r.bucket for r in keys.select("bucket").distinct().collect()]  # at most as many as there are buckets
        return rows.where(F.col("bucket").isin(some)).join(keys, ["bucket", self.key], "left_semi").drop("bucket", "segment")

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/segments/segment={name}")
        return name

    def get_or_make(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of the keys of ``wanted``; what is lacking is made from its rows (one a key), written as a segment and committed.

        If others committed meanwhile, keys that they made too are left out of the own segment first. Null keys have no row.
        """
        version, said = self._manifest()
        there = wanted.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        held = self._read(said, there)
        lacking = there if held is None else there.join(held.select(self.key), self.key, "left_anti")
        if not lacking.isEmpty():
            made = make(lacking)
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
            name = self._write(made)
            while not self._commit(version + 1, {"segments": [*said["segments"], name], "schema": schema}):
                before = set(said["segments"])
                version, said = self._manifest()
                if others := [s for s in said["segments"] if s not in before]:
                    own = self._rows([name], schema)
                    fresh = self._write(own.join(self._rows(others, schema).select(self.key), self.key, "left_anti").drop("bucket", "segment"))
                    self.folders.delete(f"segment={name}")
                    name = fresh
        return self.read(there) if held is None or not lacking.isEmpty() else held

    def clear(self) -> None:
        """Forget all rows, then delete all segments that no manifest names."""
        while True:
            version, said = self._manifest()
            if self._commit(version + 1, {"segments": [], "schema": said["schema"]}):
                break
        self.sweep()

    def sweep(self) -> None:
        """Delete the segments that the manifest doesn't name: those of interrupted writers. Others must not be writing."""
        counted = {f"segment={s}" for s in self._manifest()[1]["segments"]}
        for name in self.folders.names():
            if name not in counted:
                self.folders.delete(name)


def in_batches(wanted: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], id_col: str, batches: int) -> DataFrame:
    """What ``make`` gives for the rows of ``wanted``, made batch by batch; a run that stopped goes on with the batch that it was at.

    Rows are dealt to ``batches`` by a hash of their ids. A batch is written to a folder of its own, over whatever an
    interrupted run left there, and then entered in the log; batches in the log are not made again.
    """
    spark, path = wanted.sparkSession, path.rstrip("/")
    log = _Files(spark, f"{path}/log")
    done = set(log.names())
    dealt = wanted.withColumn("_batch", F.pmod(F.xxhash64(id_col), F.lit(batches)))
    name = lambda k: f"{k:08d}-of-{batches:08d}"
    for k in range(batches):
        if name(k) not in done:
            make(dealt.where(F.col("_batch") == k).drop("_batch")).write.mode("overwrite").parquet(f"{path}/rows/{name(k)}")
            log.create(name(k), "")
    return spark.read.parquet(*[f"{path}/rows/{name(k)}" for k in range(batches)])
