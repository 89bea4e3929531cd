"""A corpus pipeline of the training-data operators, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``, whatever their names; the last returns places
in sequences.  Every stage bears nulls in any column, empty and very long texts,
repeated rows and an empty table, as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm._shared import materialize
from quernel.llm.decontamination import drop_contaminated
from quernel.llm.labels import in_fold
from quernel.llm.near_dedup import drop_near_duplicates
from quernel.llm.packing import pack
from quernel.llm.substring_dedup import remove_repeats
from quernel.llm.toxicity import drop_toxic, learn_lexicon


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity of 0.7 or more; the lexicon is learned from the same fold as the query's.

    Null and empty texts have no hits and stay; repeated rows share their fate.
    An empty table, or one without usable labels of both classes, loses nothing
    unless all labels say toxic.
    """
    lexicon = learn_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~in_fold("doc_id", 3, 1))
    return drop_toxic(docs, lexicon)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of every component of near duplicates, at five words and 0.8.

    Null, empty and blank texts have no near duplicates and stay; of rows equal in id
    and text one stays.  A null id counts as the largest.
    """
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; every document stays, if only with an empty text.

    Null and empty texts stay as they are; ids rank occurrences, null last.
    """
    return remove_repeats(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay; items without words are nobody's; an
    empty benchmark rejects nothing.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences.

    Null, empty and blank texts have no tokens: a row each without a sequence.  An
    empty table gives no rows.
    """
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: Learned weights and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
