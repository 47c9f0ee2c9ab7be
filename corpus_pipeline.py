"""From raw documents to packed training sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and
reread as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.decontam import drop_contaminated
from tidewell.llm.exact_dedup import drop_exact_copies
from tidewell.llm.jaccard_join import drop_near_copies
from tidewell.llm.packing import pack
from tidewell.llm.queries import tokenizer_path
from tidewell.llm.shared import staged, table
from tidewell.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that are not held out, does not reject.

    Edge rows are those of drop_toxic: null and empty texts stay unless the bias is toxic, ids may be null or repeat,
    repeated rows share a fate, an empty table stays empty, columns of any names are kept.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lowering A-Z, the row with the largest id.

    Edge rows are those of drop_exact_copies: null and empty texts are one group, a null id stays only where no
    row of its group has one, of rows that repeat the staying id one stays, an empty table stays empty.
    """
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar texts, the row with the smallest id.

    Edge rows are those of drop_near_copies: texts without words stay, null ids count by their text's hash, repeated
    rows are one, an empty table stays empty.
    """
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Edge rows are those of drop_contaminated: texts of fewer than five words stay, as do all where the benchmark is
    empty; ids may be null or repeat; repeated rows share a fate.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids.

    Edge rows are those of pack: null and empty texts are one end id, a null id stays null, repeated rows are packed
    each, an empty table gives none.
    """
    out = pack(docs, tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Restoration, the fitted scores and the tokenizer can't be said in SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's result written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, f"stage-{name}")
    return docs
