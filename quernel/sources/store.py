"""A chunk store that can lose and gain documents.

Chunks lie in partitions ``origin``, ``bucket``; the bucket is a hash of the content
hash, so that a document is in one partition.  A change reads and writes only the
buckets it touches, in three steps: the new contents of these buckets are written
aside, the journal says so, and the buckets are overwritten from there.  Whoever opens
the store next finishes a change that broke off after its entry in the journal; one
that broke off before has changed nothing.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_JOURNAL = "change string, state string, touched array<struct<origin: string, bucket: int>>"


def bucket_of(content_hash: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(content_hash), F.lit(buckets)).cast("int")


def table_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, empty where nothing has been written yet."""
    try:
        table = spark.read.schema(schema).parquet(path)
        table.schema  # noqa: B018  a missing path shows here at the latest
        return table
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class ChunkStore:
    """Chunks below ``path``: ``chunks/origin=/bucket=``, ``aside/<change>`` and ``journal``.

    ``schema`` is that of the chunks, with ``origin`` and ``content_hash``.  The number
    of buckets belongs to the store; its first change writes it down.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema
        known = table_or_empty(spark, f"{self.path}/layout", "buckets int").first()
        self.buckets = known["buckets"] if known else buckets
        self._recover()

    def chunks(self) -> DataFrame:
        stored = table_or_empty(self.spark, f"{self.path}/chunks", self._stored_schema())
        return stored.select(*self.schema.names)

    def bucketed(self) -> DataFrame:
        """The chunks with their ``bucket``."""
        return table_or_empty(self.spark, f"{self.path}/chunks", self._stored_schema())

    def _stored_schema(self):
        rest = [f for f in self.schema if f.name != "origin"]
        return self.spark.createDataFrame([], self.schema).select(*(f.name for f in rest), "origin").withColumn("bucket", F.lit(0)).schema

    def _journal(self) -> DataFrame:
        return table_or_empty(self.spark, f"{self.path}/journal", _JOURNAL)

    def _note(self, change: str, state: str, touched: list[tuple]) -> None:
        row = self.spark.createDataFrame([(change, state, touched)], _JOURNAL).coalesce(1)
        row.write.mode("append").parquet(f"{self.path}/journal")

    def _recover(self) -> None:
        states = self._journal().groupBy("change").agg(F.max_by("touched", F.size("touched")).alias("touched"), F.collect_set("state").alias("states"))
        for row in states.where(~F.array_contains("states", "done")).collect():  # one at most: there is one writer
            self._overwrite(row["change"], [tuple(t) for t in row["touched"]])

    def replace(self, removed: DataFrame, added: DataFrame | None = None) -> list[tuple]:
        """Takes out the documents in ``removed(origin, content_hash)`` and puts in ``added``; returns the touched ``(origin, bucket)``.

        A null origin in ``removed`` means all collections.  Documents that are added
        replace stored ones of the same origin and content.
        """
        change = uuid.uuid4().hex
        if table_or_empty(self.spark, f"{self.path}/layout", "buckets int").isEmpty():
            self.spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/layout")
        bucket = bucket_of(F.col("content_hash"), self.buckets)
        gone = removed.select("origin", "content_hash")
        if added is not None:
            added = added.select(*self.schema.names).withColumn("bucket", bucket)
            gone = gone.unionByName(added.select("origin", "content_hash"))
        gone = gone.distinct().withColumn("bucket", bucket)
        held = self.bucketed().select("origin", "bucket").distinct()  # partition values alone
        named = gone.select(F.col("origin").alias("of"), "bucket").distinct()
        touched = held.join(named, "bucket").where("of is null or of = origin").select("origin", "bucket")
        if added is not None:
            touched = touched.unionByName(added.select("origin", "bucket"))
        touched = sorted((tuple(r) for r in touched.distinct().collect()), key=str)  # as many as there are partitions
        if not touched:
            return []
        if odd := {o for o, _ in touched if not re.fullmatch(r"[\w-]+", o or "")}:
            raise ValueError(f"names of collections are words: {sorted(map(str, odd))}")
        out = (F.col("gone.content_hash") == F.col("rest.content_hash")) & (F.col("gone.origin").isNull() | (F.col("gone.origin") == F.col("rest.origin")))
        rest = self.of(touched).alias("rest").join(gone.alias("gone"), out, "left_anti")
        new = rest if added is None else rest.unionByName(added)
        new.hint("rebalance", "origin", "bucket").write.partitionBy("origin", "bucket").parquet(f"{self.path}/aside/{change}")
        self._note(change, "written", touched)
        self._overwrite(change, touched)
        return touched

    def of(self, touched: list[tuple]) -> DataFrame:
        """The chunks of some ``(origin, bucket)``; other partitions are not read."""
        met = F.lit(False)
        for origin in {o for o, _ in touched}:
            met |= (F.col("origin") == origin) & F.col("bucket").isin([b for o, b in touched if o == origin])
        return self.bucketed().where(met)

    def _overwrite(self, change: str, touched: list[tuple]) -> None:
        """Puts what lies aside in the place of the touched buckets; can be done again at any time before the next change."""
        aside = self.spark.read.schema(self._stored_schema()).parquet(f"{self.path}/aside/{change}")
        full = {tuple(r) for r in aside.select("origin", "bucket").distinct().collect()}  # partition values
        if full:
            # Files as they lie aside: a rebalanced bucket keeps its parts.
            aside.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origin", "bucket").parquet(f"{self.path}/chunks")
        for origin, bucket in set(touched) - full:  # a bucket without rows is no part of a dynamic overwrite
            empty = aside.where("false").drop("origin", "bucket")
            empty.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/chunks/origin={origin}/bucket={bucket}")
        self._note(change, "done", [])

    def append(self, chunks: DataFrame) -> list[tuple]:
        """Adds documents; those already stored in the same collection are replaced."""
        return self.replace(self.spark.createDataFrame([], "origin string, content_hash string"), chunks)

    def delete(self, hashes: DataFrame) -> list[tuple]:
        """Takes out the documents of ``hashes(content_hash[, origin])`` from one or all collections; parent blocks stay, as they may be shared."""
        origin = F.col("origin") if "origin" in hashes.columns else F.lit(None).cast("string")
        return self.replace(hashes.select(origin.alias("origin"), "content_hash"))
