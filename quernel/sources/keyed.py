"""A store of rows by key that keeps what it has, without reading all of it.

Rows lie in partitions by a hash of their key.  Beside each partition lies a Bloom
filter of its keys, in bitmaps of 32,768 bits.  New keys are held against the filters;
only partitions that may have one of them are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.sources.store import table_or_empty

BUCKETS = 256
HASHES = 4
PAGES = 64  # bitmaps of a partition's filter: 2 million bits, a false alarm in 400 at 200,000 keys
_PAGE_BITS = 32_768
FILTERS_AT_ONCE = 128  # partitions whose filters go to the workers together: 256 KB each, 32 MB


class KeyedStore:
    """``<name>/bucket=`` with ``key`` and ``value``, ``filters/bucket=`` with ``page, bits`` below ``path``.  One writer at a time.

    ``key`` names a column of ``key_type``, ``value`` is the DDL of the other columns.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, key: str, value: str, buckets: int = BUCKETS, key_type: str = "string"):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.key, self.table = key, f"{self.path}/{name}"
        self.schema = spark.createDataFrame([], f"{key} {key_type}, {value}").schema

    def _stored(self) -> DataFrame:
        return table_or_empty(self.spark, self.table, self.spark.createDataFrame([], self.schema).withColumn("bucket", F.lit(0)).schema)

    def rows(self) -> DataFrame:
        return self._stored().select(*self.schema.names)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _places(self) -> list[Column]:
        """The places of a key in its partition's filter, by number of the hash."""
        return [F.pmod(F.xxhash64(self.key, F.lit(k)), F.lit(PAGES * _PAGE_BITS)) for k in range(1, HASHES + 1)]

    def _filters(self, buckets: list[int]) -> DataFrame:
        """``bucket, pages``: the bitmaps of each of ``buckets``, null where a page has none; each change has added some of its own."""
        stored = table_or_empty(self.spark, f"{self.path}/filters", "page int, bits binary, bucket int").where(F.col("bucket").isin(buckets))
        pages = stored.groupBy("bucket", "page").agg(F.bitmap_or_agg("bits").alias("bits"))
        pages = pages.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("page", "bits"))).alias("pages"))
        return pages.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(PAGES - 1)), lambda p: F.try_element_at("pages", p)).alias("pages"))

    def doubtful_buckets(self, keys: DataFrame) -> list[int]:
        """The partitions that may hold one of the keys; as many as there are partitions at most.

        Filters are sent to the keys, those of ``FILTERS_AT_ONCE`` partitions in each pass, so that no key is shuffled.
        """

        def is_set(place: Column) -> Column:
            bit = place % _PAGE_BITS
            byte = F.substring(F.get("pages", F.floor(place / _PAGE_BITS).cast("int")), F.floor(bit / 8).cast("int") + 1, F.lit(1))
            return F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (bit % 8).cast("int")) == 1, F.lit(False))

        placed = keys.select(self.key, self._bucket().alias("bucket"))
        touched = sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())
        doubtful: list[int] = []
        for at in range(0, len(touched), FILTERS_AT_ONCE):
            maybe = placed.join(F.broadcast(self._filters(touched[at : at + FILTERS_AT_ONCE])), "bucket")
            for place in self._places():
                maybe = maybe.where(is_set(place))
            doubtful += [r["bucket"] for r in maybe.select("bucket").distinct().collect()]
        return sorted(doubtful)

    def mark(self, keys: DataFrame) -> None:
        """Puts keys into the filters, before their rows are added; keys that are in them, or come more than once, change nothing.

        Where a change breaks off between, the filters have bits too many, which
        costs a reading and nothing else.
        """
        places = keys.select(self._bucket().alias("bucket"), F.explode(F.array_distinct(F.array(*self._places()))).alias("place"))
        bits = places.select("bucket", F.floor(F.col("place") / _PAGE_BITS).cast("int").alias("page"), (F.col("place") % _PAGE_BITS).alias("bit"))
        pages = bits.groupBy("bucket", "page").agg(F.bitmap_construct_agg("bit").alias("bits"))
        pages.select("page", "bits", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/filters")

    def append(self, rows: DataFrame) -> None:
        """Adds rows whose keys are marked and not stored yet."""
        rows.select(*self.schema.names, self._bucket().alias("bucket")).write.mode("append").partitionBy("bucket").parquet(self.table)

    def without_known(self, rows: DataFrame, buckets: list[int]) -> DataFrame:
        """Those of ``rows`` whose keys are not stored; only ``buckets`` are read."""
        return rows.join(self._stored().where(F.col("bucket").isin(buckets)).select(self.key), self.key, "left_anti") if buckets else rows

    def upsert(self, rows: DataFrame) -> list[int]:
        """Adds rows whose keys are not stored yet, one for each key that is not null; returns the partitions that had to be read."""
        new = rows.select(*self.schema.names).where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        doubtful = self.doubtful_buckets(new)
        new = self.without_known(new, doubtful)
        self.mark(new)
        self.append(new)  # the filters now hold what is added, so it is told from the same table as before
        return doubtful
