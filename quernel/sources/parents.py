"""A store of parent blocks that ignores what it has, without reading all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.sources.keyed import BUCKETS, KeyedStore


class ParentStore(KeyedStore):
    """Blocks ``parent_ref, text`` below ``path``; ``upsert`` adds those that are not stored yet, once each."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        super().__init__(spark, path, "parents", "parent_ref", "text string", buckets)

    def parents(self) -> DataFrame:
        return self.rows()
