"""Contracts, categories, splits and caches of analysis tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng


def validate(df: DataFrame, text: str, outcome: str, treatment: str, split: str | None = None) -> DataFrame:
    """``df`` if the named columns are there and hold no null; else a ValueError that names them."""
    wanted = [text, outcome, treatment, *([split] if split else [])]
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    nulls = null_counts(df, wanted[:3]).first().asDict()
    if bad := {c: n for c, n in nulls.items() if n}:
        raise ValueError(f"null values: {bad}")
    return df


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


#: Categories that are indexed, at most: each becomes an arm or a dummy of a model.
MOST_CATEGORIES = 100_000


def category_index(df: DataFrame, column: str, index: str) -> DataFrame:
    """``df`` with the place of each category among the distinct ones, in order, from 0; the checked dimension is broadcast."""
    dim = df.where(F.col(column).isNotNull()).select(column).distinct()
    if dim.limit(MOST_CATEGORIES + 1).count() > MOST_CATEGORIES:
        raise ValueError(f"{column} has more than {MOST_CATEGORIES} categories")
    dim = dim.withColumn(index, F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(F.broadcast(dim), column, "left")


def split_rows(df: DataFrame, fraction: float, seed: int, id_col: str = "doc_id", name: str = "split") -> DataFrame:
    """``df`` with ``train`` for about ``fraction`` of the rows and ``eval`` for the others, by id."""
    return df.withColumn(name, F.when(rng.uniform(seed, "split", id_col) < fraction, "train").otherwise("eval"))


#: Experiments that are joined to the rows at once.
MOST_EXPERIMENTS = 10_000


def experiments(rows: DataFrame, scenarios: DataFrame, repeats: int, fraction: float, id_col: str = "doc_id") -> DataFrame:
    """``rows`` once for each scenario (``scenario_idx``, ..) and repeat, with ``repeat_idx``, ``model``, the experiment's number and seed, and
    ``sim_split``: ``train`` for about ``fraction`` of an experiment's rows, by id, else ``eval``.

    The grid, of checked size, is broadcast to the rows; nothing is shuffled.
    """
    if (n := scenarios.count() * repeats) > MOST_EXPERIMENTS:
        raise ValueError(f"{n} experiments at once; at most {MOST_EXPERIMENTS}")
    grid = scenarios.withColumn("repeat_idx", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("model", (1000 * F.col("scenario_idx") + F.col("repeat_idx")).cast("int"))
    split = F.when(rng.uniform(F.col("model"), "split", id_col) < fraction, "train").otherwise("eval")
    return rows.crossJoin(F.broadcast(grid)).withColumn("sim_split", split)


def folds(df: DataFrame, k: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    return df.withColumn("cv_fold", rng.fold(k, seed, id_col))


def exact_folds(df: DataFrame, k: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Folds whose sizes differ by one at most, the larger first, from the order of a hash.

    A row's place in that order is the rows of all smaller buckets, which are few sums, and its place in its
    own bucket, so nothing is sorted in one task.
    """
    keyed = df.withColumn("_k", rng.order_key(seed, "fold", id_col)).withColumn("_b", F.substring("_k", 1, 3))
    counts = keyed.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 4,096 rows
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    placed = keyed.join(F.broadcast(before.drop("_n")), "_b").withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_k", id_col)) - 1)
    each, more = F.floor(F.col("_all") / k), F.col("_all") % k
    in_large = F.col("_at") < more * (each + 1)
    fold = F.when(in_large, F.floor(F.col("_at") / (each + 1))).otherwise(more + F.floor((F.col("_at") - more * (each + 1)) / F.greatest(each, F.lit(1))))
    return placed.withColumn("cv_fold", (fold + 1).cast("int")).drop("_k", "_b", "_before", "_all", "_at")


def numbered(df: DataFrame, by: str, name: str, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """``df`` with numbers from 0 without gaps within each value of ``by``, in the order of a hash of the id.

    As in ``exact_folds``, a row's number is its place in its hash bucket and the rows of the buckets before, of which there are at most 4,096 for each value.
    """
    keyed = df.withColumn("_k", rng.order_key(seed, "number", id_col)).withColumn("_b", F.substring("_k", 1, 3))
    counts = keyed.groupBy(by, "_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(by).orderBy("_b")) - F.col("_n")).drop("_n")
    placed = keyed.join(F.broadcast(before), [by, "_b"])
    nth = F.col("_before") + F.row_number().over(Window.partitionBy(by, "_b").orderBy("_k", id_col)) - 1
    return placed.withColumn(name, nth.cast("long")).drop("_k", "_b", "_before")


def sampled(df: DataFrame, most: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` rows, the same on any partitioning: those first in the order of a hash."""
    return df.orderBy(rng.order_key(seed, "sample", id_col), id_col).limit(most)


def remaining(n: int, done: DataFrame, id_col: str = "patient_id") -> DataFrame:
    """Ids below ``n`` that ``done`` lacks."""
    return done.sparkSession.range(n).withColumnRenamed("id", id_col).join(done.select(id_col), id_col, "left_anti")
