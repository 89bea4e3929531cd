"""Continuous ingestion of arriving files.

Which contents are known is state of the stream, kept by content hash in the state
store of its checkpoint: a batch reads what has arrived and its own statuses, never
the index.  Files are refused by name and length before they are opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quernel.functions import fixed
from quernel.functions.text import fill, passage_text, safe_filename, suffix
from quernel.operators.documents import build_chunks
from quernel.operators.search import embed, hash_encoder
from quernel.sources.store import table_or_empty
from quernel.sources.tables import READERS, kinds_glob, with_content_hash

STATUS = "path string, status string, chunks long, error string, batch_id long"
PARENTS = "parent_ref string, text string, batch_id long"
FILES = "path string, modificationTime timestamp, length long, content binary"
MARKED = "path string, file_name string, suffix string, content_hash string, text string, rejected string, stored_as string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES_AT_ONCE = 1000


def check_uploads(files: DataFrame, max_bytes: int = fixed.MAX_UPLOAD, suffixes=fixed.SUFFIXES) -> DataFrame:
    """Adds ``file_name``, ``suffix`` and the reason why a file is ``rejected``, or null."""
    named = files.withColumn("file_name", safe_filename(F.col("path"))).withColumn("suffix", suffix(F.col("file_name")))
    kind = fill(fixed.WRONG_KIND, F.coalesce("suffix", F.lit("")))
    size = F.lit(fixed.TOO_LARGE % (max_bytes // 1024 // 1024))
    return named.withColumn("rejected", F.when(~F.coalesce(F.col("suffix").isin(*suffixes), F.lit(False)), kind).when(F.col("length") > max_bytes, size))


def file_text(files: DataFrame, readers=READERS) -> DataFrame:
    """Adds ``text``, read by the reader of a file's suffix; ``rejected`` where there is none."""
    text: Column | None = None
    for kind, read in readers.items():
        hit = F.col("suffix") == kind
        text = F.when(hit, read(F.col("content"))) if text is None else text.when(hit, read(F.col("content")))
    unread = F.when(~F.coalesce(F.col("suffix").isin(*readers), F.lit(False)), fill(fixed.NO_READER, F.coalesce("suffix", F.lit(""))))
    return files.withColumn("rejected", F.coalesce("rejected", unread)).withColumn("text", F.when(F.col("rejected").isNull(), text))


class KnownContents(StatefulProcessor):
    """Passes rows of a content on with ``stored_as``, the name under which an earlier batch had it; null for a new one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._name = handle.getValueState("stored_as", "file_name string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self._name.get()[0] if self._name.exists() else None
        first = None
        for part in rows:
            earliest = min(zip(part["path"], part["file_name"]))
            first = earliest if first is None else min(first, earliest)
            yield part.assign(stored_as=stored)
        if stored is None and first is not None:
            self._name.update((first[1],))

    def close(self) -> None:
        pass


def marked_files(listed: DataFrame, opened: DataFrame, max_bytes: int, readers=READERS) -> DataFrame:
    """Every arriving file with its text, or why it is ``rejected``, and whether its content is known.

    ``listed`` has all files, of which only path and length are read; ``opened`` those
    of allowed kinds, of which the bytes are read where they are short enough.  Only
    contents with text are known: a file without any is refused each time.
    """
    names = [n.split()[0] for n in MARKED.split(", ")]
    nothing = [F.lit(None).cast("string").alias(n) for n in ("content_hash", "text", "stored_as")]
    refused = check_uploads(listed.select("path", "length"), max_bytes).where("rejected is not null").select("path", "file_name", "suffix", "rejected", *nothing)
    short = opened.where(F.col("length") <= max_bytes)  # reaches the reader of files, which skips the rest
    read = file_text(check_uploads(with_content_hash(short, "content"), max_bytes), readers).select(*(n for n in names if n != "stored_as"))
    has_text = F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    void = read.where(~has_text).withColumn("rejected", F.coalesce("rejected", F.lit(fixed.NO_TEXT))).withColumn("stored_as", F.lit(None).cast("string"))
    known = read.where(has_text).groupBy("content_hash").transformWithStateInPandas(statefulProcessor=KnownContents(), outputStructType=MARKED, outputMode="append", timeMode="None")
    return known.unionByName(void.select(names)).unionByName(refused.select(names))


def ingest_batch(marked: DataFrame, batch_id: int, index_dir: str, origin: str = "user", make_encoder=hash_encoder) -> None:
    """Indexes one batch of ``marked_files``: parents, chunks with their vectors, then one status for each file.

    All three lie in folders of their batch, which a repeated batch writes anew; so one
    that broke off between its writes ends with the same chunks and statuses.
    """
    spark = marked.sparkSession
    chunks_dir, parents_dir, status_dir = (f"{index_dir}/{n}" for n in ("chunks", "parents", "status"))
    if not table_or_empty(spark, status_dir, STATUS).where(F.col("batch_id") == batch_id).isEmpty():  # one folder is read
        return
    kept: list[DataFrame] = []
    try:
        files = marked.persist()
        kept.append(files)
        good = files.where("rejected is null")
        fresh = good.where("stored_as is null")
        first = fresh.groupBy("content_hash").agg(F.min("path").alias("path"))
        new = fresh.join(first, ["content_hash", "path"], "left_semi").withColumn("source_label", F.col("file_name"))
        rows = build_chunks(new, origin).withColumn("passage", passage_text(F.col("doc_title"), F.col("heading_path"), F.col("text")))
        rows = embed(rows, "passage", make_encoder).drop("passage").persist()
        kept.append(rows)
        place = {"batch_id": F.lit(batch_id).cast("long")}
        of_batch = lambda df, *keys: df.withColumns(place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys, "batch_id")
        of_batch(rows.select("parent_ref", F.col("parent_text").alias("text")).dropDuplicates(["parent_ref"])).parquet(parents_dir)
        of_batch(rows.drop("parent_text"), "origin").parquet(chunks_dir)

        failed = lambda df, message: df.select("path", F.lit("error").alias("status"), F.lit(0).cast("long").alias("chunks"), message.alias("error"))
        counted = new.join(rows.groupBy("content_hash").agg(F.count("*").alias("n")), "content_hash")
        made = counted.select("path", F.lit("done").alias("status"), F.col("n").alias("chunks"), F.lit(None).cast("string").alias("error"))
        other = F.when(F.col("stored_as") != F.col("file_name"), fill(fixed.KNOWN_AS, F.col("stored_as"))).otherwise("")
        known = failed(good.where("stored_as is not null"), F.concat(F.lit(fixed.KNOWN_FILE), other))
        twins = failed(fresh.join(first, ["content_hash", "path"], "left_anti"), F.lit(fixed.KNOWN_FILE))
        refused = failed(files.where("rejected is not null"), F.col("rejected"))
        of_batch(made.unionByName(known).unionByName(twins).unionByName(refused)).parquet(status_dir)
    finally:
        for df in kept:
            df.unpersist()


def read_parents(spark: SparkSession, index_dir: str) -> DataFrame:
    """``parent_ref, text``: blocks that several batches have come once; of equal ones any will do."""
    return table_or_empty(spark, f"{index_dir}/parents", PARENTS).groupBy("parent_ref").agg(F.any_value("text").alias("text"))


def ingest_stream(spark: SparkSession, in_dir: str, index_dir: str, checkpoint: str, once: bool = False, make_encoder=hash_encoder, readers=READERS, max_bytes: int = fixed.MAX_UPLOAD, files_at_once: int = FILES_AT_ONCE):
    """Starts the stream over files that arrive below ``in_dir``; returns the streaming query.

    A batch takes ``files_at_once`` files.  The state store is RocksDB, so that
    contents known to a task need not fit in its memory.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    longest = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
    source = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).schema(FILES)
    marked = marked_files(source.load(in_dir), source.option("pathGlobFilter", kinds_glob(fixed.SUFFIXES)).load(in_dir), min(max_bytes, longest), readers)
    writer = marked.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: ingest_batch(df, n, index_dir, make_encoder=make_encoder))
    return (writer.trigger(availableNow=True) if once else writer).start()
