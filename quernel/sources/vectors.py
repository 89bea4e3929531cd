"""A store of vectors by content: a passage is embedded once, however often it comes back.

The key is a digest of the encoder's name and the passage, so a document that changed
embeds only the passages that it did not have before, and so does one that shares
passages with others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.search import embed, hash_encoder
from quernel.sources.keyed import BUCKETS, KeyedStore

KEY = "passage_key"


class VectorStore(KeyedStore):
    """Vectors of one encoder's passages below ``path``.

    ``encoder`` names the model and its settings: vectors of another name are never
    used.  Vectors are kept as they were first made; an encoder whose result depends
    on the texts beside a text in its batch may differ from them in the last digits.
    """

    def __init__(self, spark: SparkSession, path: str, encoder: str = "hash", buckets: int = BUCKETS):
        super().__init__(spark, path, "vectors", KEY, "embedding array<float>, change string", buckets, "binary")
        self.encoder = encoder

    def embed(self, df: DataFrame, text: str, make_encoder: Callable = hash_encoder) -> DataFrame:
        """``df`` with ``embedding`` of its ``text`` and ``kept``, whether the vector was stored before.

        Only distinct passages that are not stored go to the encoder; their vectors
        are stored before the result is given.  A null text counts as an empty one.
        Columns of ``df`` with the names of the added ones, of ``passage_key`` and of
        ``change`` are replaced.  An empty table gives no rows.  ``df`` is read for
        its keys, for its passages and for the result, and must be the same each
        time: a table that is dear to make, or made from what this changes, is
        written first.
        """
        passage = F.coalesce(text, F.lit(""))
        rows = df.drop("embedding", "kept", "change", KEY).withColumn(KEY, F.unhex(F.md5(F.concat_ws("\x01", F.lit(self.encoder), passage))))
        doubtful = self.doubtful_buckets(rows)
        self.mark(rows)
        change = uuid.uuid4().hex  # tells what this change adds from what was stored before
        # One row a key, so that the passages are told from stored ones where their copies were joined.
        fresh = self.without_known(rows.groupBy(KEY).agg(F.any_value(passage).alias("passage")), doubtful)
        self.append(embed(fresh, "passage", make_encoder).withColumn("change", F.lit(change)))
        # Vectors are read where they are stored, in these rows' partitions alone: rows are only ever added there.
        met = [r["bucket"] for r in rows.select(self._bucket().alias("bucket")).distinct().collect()]
        stored = self._stored().where(F.col("bucket").isin(met)).select(KEY, "embedding", F.coalesce(F.col("change") != change, F.lit(True)).alias("kept"))
        return rows.join(stored, KEY).drop(KEY)
