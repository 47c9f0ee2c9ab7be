"""What each of five filters removes, alone and in every order, by direct replay.

A document is five flags. Each document's flags are crossed with the 120 orders of the
filters, which are broadcast; its first failure in an order is an expression, five
steps are exploded, and conditional counts by part, order and step are summed in the
tasks before anything is shuffled: a task sends one row for each part, order and step.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

LETTERS = "ABCDE"
WORDS = r"[^\x20\x09-\x0D]+"
#: A text is hot if it fills more than one row in so many of the table, and more than so many rows; so there are at most so many hot texts, and these are broadcast.
HOT_TEXTS, HOT_ROWS = 100_000, 10_000


def _bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def text_flags(text: Column | str = "text", words: Column | str = "words") -> Column:
    """The bits of filters A to D, which see one text alone, from the text and the list of its words."""
    text, words = (F.col(c) if isinstance(c, str) else c for c in (text, words))
    n = F.size(words).cast("long")
    capitals = (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long")
    fails = {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n,
        "C": 100 * capitals > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return sum((F.when(c, F.lit(_bit(k))).otherwise(F.lit(0)) for k, c in fails.items()), F.lit(0))


def _repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, digest, ..) with ``again``: whether a smaller doc_id has the digest.

    Ids meet in sums by digest. Digests of hot texts are broadcast, as there are at most HOT_TEXTS of them;
    all others are joined by a shuffle, where none has more rows than a hot one.
    """
    first = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL"), "repeated-texts")
    least = max(HOT_ROWS, rows.count() // HOT_TEXTS)
    hot = F.broadcast(first.where(F.col("n") > least).select("digest", "first_id"))
    cold = first.where(F.col("n") <= least).select("digest", "first_id")
    both = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(cold, "digest", "left"))
    later = F.when(F.col("doc_id").isNull(), F.col("first_id").isNotNull()).otherwise(F.col("first_id") < F.col("doc_id"))
    return both.withColumn("again", F.coalesce(later, F.lit(False))).drop("digest", "first_id")


def document_flags(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", part: str = "lang") -> DataFrame:
    """``doc_id, part, flags, good, toxic`` for each row of ``docs``: the five filters as bits of ``flags``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    seen = staged(rows.select("doc_id", "part", text_flags().alias("alone"), F.unhex(F.sha2("text", 256)).alias("digest")), "filter-flags")
    judged = _repeats(seen).select("doc_id", "part", (F.col("alone") + F.when(F.col("again"), F.lit(_bit("E"))).otherwise(F.lit(0))).alias("flags"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # rows without an id match no label and are spread by a salt
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    joined = judged.withColumn("salt", salt).join(known.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    return joined.select("doc_id", "part", "flags", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def orders(spark) -> DataFrame:
    """``filter_order`` and the bit of each of its steps, ``m1`` to ``m5``: 120 rows."""
    rows = [("".join(p), *(_bit(x) for x in p)) for p in permutations(LETTERS)]
    return spark.createDataFrame(rows, "filter_order string, " + ", ".join(f"m{i} int" for i in range(1, 6)))


def replay(flags: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and the counts of that step, from rows of ``part, flags, good, toxic``."""
    steps = range(1, len(LETTERS) + 1)
    fails = lambda i: F.col("flags").bitwiseAND(F.col(f"m{i}")) != 0
    first = F.lit(len(steps) + 1)
    for i in reversed(steps):
        first = F.when(fails(i), F.lit(i)).otherwise(first)
    crossed = flags.select("part", "flags", "good", "toxic").crossJoin(F.broadcast(orders(flags.sparkSession)))
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"m{i}").alias("mask")) for i in steps]))
    replayed = crossed.withColumn("first", first).select("part", "filter_order", "flags", "good", "toxic", "first", each)
    here = F.col("first") == F.col("step")
    counts = replayed.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if((F.col("first") < F.col("step")) & (F.col("flags").bitwiseAND(F.col("mask")) != 0)).alias("redundant"),
        F.count_if(F.col("flags") == F.col("mask")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))  # 600 rows a part


def audit(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters A to E and step: ``part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley``.

    A fails texts of under 100 words, B those with under 80 distinct words in 100, C those with over 10 capitals in 100
    code points, D those with any of ``#$%&*|``, E those that a smaller doc_id has too, in any part, removed or not.

    Null text is empty: it fails A, and E if it repeats. A null part is the empty string. A row without an id counts as
    larger than any other: it fails E if a row with an id has its text, it has no label, and no row fails E for its sake.
    Rows that repeat id and text don't fail E for one another; each counts. Of labels that repeat an id, any that says
    so counts. Texts are read whole, one at a time, with their words; equality is that of SHA-256. An empty table gives
    no row, as it has no part; columns of other names are not read.
    """
    return replay(document_flags(docs, labels, text=text, id_col=id_col, part=part))
