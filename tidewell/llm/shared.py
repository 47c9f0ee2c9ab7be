"""Session helpers: the shared folder, staged tables and sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share (``spark.checkpoint.dir``); without a scheme it is on the default file system.

    A local folder is made, once a context, only where the session names none and driver and executors are one process;
    on a cluster without the setting this is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_tidewell_folder", None)
    if not base:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = context._tidewell_folder = "file://" + tempfile.mkdtemp(prefix="tidewell-")
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def session_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application writes to."""
    return f"{shared_dir(spark).rstrip('/')}/tidewell/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application staged. Results that are still to be computed need it: write them first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files behind: nothing computes it again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    if was is None:  # a Spark without the setting
        yield
        return
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: executors lost later cost a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with _freeing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a bucket, and buckets of a table at most, as Spark allows by default.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000


def bucketed(df: DataFrame, key: str, keys: int, n_bytes: int, name: str, compression: str = "snappy", dealt: bool = False) -> DataFrame:
    """``df`` written to the shared folder as a table bucketed by ``key``, read back.

    ``dealt``: ``df`` already lies by the key in as many parts, as what was made of another such table does.
    What is grouped or joined by the key then meets without a shuffle, as often as it is read. Buckets are of about
    BUCKET_BYTES of ``n_bytes``, but no fewer than Spark's shuffle partitions where there are as many ``keys``. The catalogue forgets the table at
    once; its files stay until ``clear``.
    """
    spark = df.sparkSession
    n = min(MOST_BUCKETS, max(parts_for(n_bytes, BUCKET_BYTES), min(keys, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    made = f"tidewell_{uuid.uuid4().hex}"
    with _freeing(spark):
        (df if dealt else df.repartition(n, key)).write.format("parquet").bucketBy(n, key).option("path", new_folder(spark, name)).option("compression", compression).saveAsTable(made)
    out = spark.table(made)
    spark.sql(f"DROP TABLE {made}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a column over all rows."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def parts_for(n_bytes: int, each: int) -> int:
    return max(1, -(-n_bytes // each))


def bucket_of(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def has_plain_ids(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether every row has an id of its own; only ids cross the network."""
    return docs.groupBy(F.col(id_col).alias("id")).count().where("count > 1 OR id IS NULL").isEmpty()


def one_of_each(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` with one row for each value of ``keys`` (none null): of several, that with the smallest hash of all columns."""
    many = docs.groupBy(keys).count().where("count > 1").drop("count")
    if many.isEmpty():
        return docs
    several = docs.join(many, keys, "left_semi")
    picked = several.groupBy(keys).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return docs.join(many, keys, "left_anti").unionByName(picked)


def in_share(col: str, most: int, total: int) -> Column:
    """Whether a row belongs to a sample, by a hash of ``col``, of about ``most`` of ``total`` rows.

    The hash has 53 bits, so that the share stays exact at any total.
    """
    share = min(1.0, most / max(1, total))
    return F.shiftrightunsigned(F.xxhash64(col), 11) < F.lit(int(share * (1 << 53)))
