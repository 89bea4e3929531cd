"""Bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_fold(doc_id: str, mod: int, rest: int):
    """True where crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled documents of each class, chosen by a hash.

    Returns ``(doc_id, y, text)`` rows and the number of usable labels of each
    class.  Only ids are ranked; texts follow by a join with the bounded list.
    A document with several labels counts as 1 if any of them is; of rows that
    share an id the text of least hash is taken, so that an id is one document.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(usable).groupBy("doc_id").agg(F.max("y").alias("y"))
    totals = {int(r["y"]): int(r["count"]) for r in known.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = texts.join(F.broadcast(chosen), "doc_id")  # twice per_class ids at most
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return met.groupBy("doc_id", "y").agg(one).select("doc_id", "y", "text"), totals
