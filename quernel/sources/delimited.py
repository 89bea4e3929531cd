"""Delimited files read in parallel, whatever line breaks their quotes hold.

A file is read as lines by ranges of bytes.  A line break ends a record if an even
number of quotation marks comes before it, so each range is summed up first: whether
its marks are odd in number, and how many records begin in it if the count was even,
or odd, before.  Sums over the ranges of a file, one row each, then say where in its
records every range begins.  A record within one line is cut where it was read; only
lines of longer records are brought together.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINES = "file_id string, range long, n long, line string, inside boolean, ends_inside boolean, seq long, begun long"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file_id, range, n, line``, the lines of each range in order; ``range`` is its first byte."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))


def _running(lines: DataFrame) -> DataFrame:
    """Adds what holds if the marks before the range are even in number: whether a line begins and ends ``inside`` quotes, and
    how many lines of the range up to it there are (``seq``) and begin outside (``begun``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, odd, seq, begun = None, False, 0, 0
        for batch in batches:
            files, ranges = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            marks = pc.count_substring(batch.column(3), '"').to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                key = files[at], ranges[at]
                to = at + 1
                while to < batch.num_rows and (files[to], ranges[to]) == key:
                    to += 1
                if key != held:
                    held, odd, seq, begun = key, False, 0, 0
                after = (np.cumsum(marks[at:to]) + odd) % 2 == 1
                inside = np.concatenate([[odd], after[:-1]])
                starts, places = begun + np.cumsum(~inside), seq + np.arange(1, to - at + 1)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(inside), pa.array(after), pa.array(places), pa.array(starts)], names=["file_id", "range", "n", "line", "inside", "ends_inside", "seq", "begun"])
                odd, seq, begun, at = bool(after[-1]), int(places[-1]), int(starts[-1]), to

    return lines.mapInArrow(run, _LINES)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cells(records: pd.Series) -> pd.Series:
    csv.field_size_limit(sys.maxsize)
    return pd.Series([next(csv.reader(io.StringIO(r, newline="")), []) for r in records], dtype=object)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file_id, row_idx, cells``: the records of delimited files, numbered from 0, with all their cells.

    A line break is LF or CR LF; a mark at the head of a file is left out, and cells are
    cut as Python's ``csv`` cuts them.  An empty line is a record without cells.  Quotation
    marks within a field have to be doubled in a quoted one: a single one opens quotes.
    """
    lines = _running(_lines(spark, path))
    outside = F.count_if(~F.col("inside"))
    ranges = lines.groupBy("file_id", "range").agg(F.max_by("ends_inside", "n").alias("odd"), outside.alias("if_even"), (F.count("*") - outside).alias("if_odd"))
    before = Window.partitionBy("file_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    ranges = ranges.withColumn("flip", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    ranges = ranges.withColumn("records", F.when(F.col("flip"), F.col("if_odd")).otherwise(F.col("if_even")))
    ranges = ranges.select("file_id", "range", "flip", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("earlier"))

    placed = lines.join(ranges, ["file_id", "range"])
    flipped = lambda column: F.col(column) != F.col("flip")
    number = F.col("earlier") + F.when(F.col("flip"), F.col("seq") - F.col("begun")).otherwise(F.col("begun")) - 1
    placed = placed.select("file_id", "range", "n", "line", number.alias("row_idx"), (~flipped("inside") & ~flipped("ends_inside")).alias("whole"))
    parts = placed.where(~F.col("whole")).groupBy("file_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("range", "n", "line"))).alias("parts"))
    longer = parts.select("file_id", "row_idx", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("record"))
    records = placed.where("whole").select("file_id", "row_idx", F.col("line").alias("record")).unionByName(longer)
    bare = F.regexp_replace("record", r"\r\z", "")
    bare = F.when((F.col("row_idx") == 0) & F.startswith(bare, F.lit("\ufeff")), F.substring(bare, 2, 2**31 - 1)).otherwise(bare)
    return records.select("file_id", "row_idx", _cells(bare).alias("cells"))
