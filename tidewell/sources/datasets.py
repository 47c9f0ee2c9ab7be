"""Reading and writing analysis tables, logs and weights."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffix of a path: how it is read.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".parquet": lambda spark, path: spark.read.parquet(path),
    ".csv": lambda spark, path: spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(path),
}


def load_dataset(spark: SparkSession, path: str, split: str | None = None, split_column: str = "split") -> DataFrame:
    """A Parquet or CSV table, only the rows of ``split`` if one is named; the filter reaches the scan."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"can't read {suffix or 'a path without suffix'}; known: {', '.join(READERS)}")
    rows = READERS[suffix](spark, path)
    if split is None:
        return rows
    if split_column not in rows.columns:
        raise ValueError(f"no column {split_column!r} to take the split {split!r} from")
    return rows.where(F.col(split_column) == split)


def with_row_ids(df: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``df`` with ids: its own, or numbers fixed by writing the rows to ``path`` once and rereading them."""
    if id_col in df.columns:
        return df
    df.withColumn(id_col, F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """Write Parquet, in folders by column values if wanted, and read it back."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_log(df: DataFrame, path: str) -> None:
    """A small table as CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(value: dict, path: str, spark: SparkSession) -> None:
    """One JSON document in the folder ``path``, on whatever file system it names."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(path: str, spark: SparkSession) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def scratch(spark: SparkSession) -> str:
    """A folder of its own below ``spark.checkpoint.dir``, which driver and executors share; in local mode without it, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidewell-")
    return f"{base.rstrip('/')}/tidewell/{spark.sparkContext.applicationId}/scratch-{uuid.uuid4().hex}"
