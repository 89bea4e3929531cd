"""Sources: files, delimited text, sheet cells, blocks and pages."""

from __future__ import annotations

import csv
import io
import re
import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quernel.functions import fixed
from quernel.functions.text import repair_text, strip, strip_toc_lines, suffix
from quernel.sources.delimited import read_records


def spread(scan: DataFrame) -> DataFrame:
    """A scanned table over all cores of the cluster.

    One that comes in fewer parts than there are cores (a few small files) is dealt
    out once, for the work on its texts; a larger one stays where it lies.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def list_files(spark: SparkSession, root: str, suffixes=fixed.SUFFIXES, excluded=fixed.EXCLUDED_FOLDERS) -> DataFrame:
    """``path, folder, source_label, file_name, suffix, length`` of the wanted files below ``root``; no file is opened."""
    base = F.regexp_replace(F.lit(root), "/+$", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length").withColumn("b", base)
    files = files.withColumn("source_label", F.expr("substring(path, instr(path, b) + length(b) + 1)")).drop("b")
    files = files.withColumn("file_name", F.element_at(F.split("source_label", "/"), -1)).withColumn("suffix", suffix(F.col("file_name")))
    files = files.withColumn("folder", F.expr("substring(path, 1, length(path) - length(file_name) - 1)"))
    folders = F.slice(F.split("source_label", "/"), 1, F.size(F.split("source_label", "/")) - 1)
    return files.where(F.col("suffix").isin(*suffixes) & ~F.arrays_overlap(folders, F.array(*map(F.lit, excluded))))


def _literal(path: str) -> str:
    """A path in which no character is a wild card."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def kinds_glob(suffixes) -> str:
    """A file name pattern of the suffixes, in any case."""
    return "{" + ",".join("*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"


def read_contents(spark: SparkSession, folders: list[str], suffixes=fixed.SUFFIXES) -> DataFrame:
    """``path, length, content`` of the files of these suffixes that lie in ``folders`` themselves."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", kinds_glob(suffixes))
    return reader.load([_literal(f) for f in folders]).select("path", "length", "content")


def scan_files(spark: SparkSession, root: str, suffixes=fixed.SUFFIXES, excluded=fixed.EXCLUDED_FOLDERS) -> DataFrame:
    """Files below ``root`` of the wanted kinds, outside the excluded folders, with their content hash.

    Files are listed first, then read from the folders that hold wanted ones: what is
    excluded is never opened.  The driver gets the names of these folders, fewer than
    the names of files that Spark's own listing keeps there.
    """
    listed = list_files(spark, root, suffixes, excluded)
    folders = sorted(r["folder"] for r in listed.select("folder").distinct().collect())
    names = ["path", "source_label", "file_name", "suffix", "length", "content", "content_hash"]
    if not folders:
        return listed.withColumn("content", F.lit(None).cast("binary")).withColumn("content_hash", F.lit(None).cast("string")).select(names)
    read = with_content_hash(read_contents(spark, folders, suffixes), "content")
    base = F.regexp_replace(F.lit(root), "/+$", "")
    labelled = read.withColumn("b", base).withColumn("source_label", F.expr("substring(path, instr(path, b) + length(b) + 1)")).drop("b")
    return labelled.withColumn("file_name", F.element_at(F.split("source_label", "/"), -1)).withColumn("suffix", suffix(F.col("file_name"))).select(names)


def with_content_hash(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("content_hash", F.sha2(F.col(column).cast("binary"), 256))


def read_csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """Records of delimited files as ``(file_id, row_idx, cells)``, in the order of each file; see ``read_records``."""
    return read_records(spark, path)


@F.pandas_udf(StringType())
def csv_content_to_text(content: pd.Series) -> pd.Series:
    """The rows of whole delimited files as text, blocks between blank lines; the header is the first record.

    A file that is not UTF-8 has its wrong bytes replaced.
    """

    def text(raw: bytes | None) -> str:
        csv.field_size_limit(sys.maxsize)
        records = list(csv.reader(io.StringIO((raw or b"").decode("utf-8-sig", "replace"), newline="")))
        lines = (", ".join(f"{h}: {v}" for h, v in zip(records[0], r) if v) for r in records[1:])
        return "\n\n".join(x for x in lines if x)

    return content.map(text)


#: How the bytes of a file become text, by suffix; other kinds need a reader of the caller's.
READERS = {".csv": csv_content_to_text}


def csv_rows_to_text(cells: DataFrame) -> DataFrame:
    """``header: value`` pairs of non-empty values joined by commas; the header is row 0."""
    header = cells.where("row_idx = 0").select("file_id", F.col("cells").alias("header"))
    rows = cells.where("row_idx > 0").join(header, "file_id")
    n = F.least(F.size("header"), F.size("cells"))
    pairs = F.zip_with(F.slice("header", F.lit(1), n), F.slice("cells", F.lit(1), n), lambda h, v: F.when(strip(v) != "", F.concat(F.coalesce(h, F.lit("")), F.lit(": "), v)))
    return rows.select("file_id", "row_idx", F.array_join(F.filter(pairs, lambda p: p.isNotNull()), ", ").alias("text")).where("text <> ''")


def sheet_rows_to_text(cells: DataFrame, looked_at: int = 20) -> DataFrame:
    """``header: value`` pairs joined by semicolons; the header is the fullest of the first rows."""
    filled = F.size(F.filter("cells", lambda c: F.coalesce(strip(c), F.lit("")) != ""))
    best = cells.where(F.col("row_idx") < looked_at).groupBy("file_id", "sheet_idx").agg(F.max_by(F.struct("row_idx", "cells"), F.struct(filled, -F.col("row_idx"))).alias("h"))
    rows = cells.join(best.select("file_id", "sheet_idx", F.col("h.row_idx").alias("at"), F.col("h.cells").alias("header")), ["file_id", "sheet_idx"]).where("row_idx > at")
    n = F.least(F.size("header"), F.size("cells"))
    clean = lambda x: strip(F.coalesce(x, F.lit("")))
    pairs = F.zip_with(F.slice("header", F.lit(1), n), F.slice("cells", F.lit(1), n), lambda h, v: F.when((clean(h) != "") & (clean(v) != ""), F.concat(F.replace(clean(h), F.lit("\n"), F.lit(" ")), F.lit(": "), clean(v))))
    return rows.select("file_id", "sheet_idx", "row_idx", F.array_join(F.filter(pairs, lambda p: p.isNotNull()), "; ").alias("text")).where("text <> ''")


def load_registry(cells: DataFrame, marker: str = fixed.HEADER_MARK) -> DataFrame:
    """``(file_id, row_id, fields)``: rows below the header row of the first sheet.

    The header is the first row whose first cell is ``marker``.  Null cells have no
    entry; of equal headers the last one counts.
    """
    sheet = cells.where("sheet_idx = 0")
    heads = sheet.where(strip(F.element_at("cells", 1)) == marker).groupBy("file_id").agg(F.min_by(F.struct("row_idx", "cells"), "row_idx").alias("h"))
    rows = sheet.join(heads, "file_id").where("row_idx > h.row_idx").where(F.exists("cells", lambda c: c.isNotNull()))
    keys = F.transform(F.col("h.cells"), lambda c: strip(F.coalesce(c, F.lit(""))))
    n = F.least(F.size(keys), F.size("cells"))
    pairs = F.zip_with(F.slice(keys, F.lit(1), n), F.slice("cells", F.lit(1), n), lambda k, v: F.struct(k.alias("key"), strip(v).alias("value")))
    rows = rows.select("file_id", F.col("row_idx").alias("row_id"), F.filter(pairs, lambda p: p["value"].isNotNull() & (p["key"] != "")).alias("pairs"))
    names = F.transform("pairs", lambda p: p["key"])
    last = F.filter("pairs", lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), p["key"]))
    return rows.select("file_id", "row_id", F.map_from_entries(last).alias("fields"))


def registry_columns(registry: DataFrame, columns: dict[str, str] = fixed.COLUMNS) -> DataFrame:
    """The register with one string column for each known header; absent cells are null."""
    return registry.select("row_id", *(F.col("fields").getItem(header).alias(name) for name, header in columns.items()))


def blocks_to_text(blocks: DataFrame) -> DataFrame:
    """Paragraphs, then table rows as cells between bars, with blank lines between.

    A document's blocks meet in one row, as its text does in the end.
    """
    line = F.array_join(F.transform("cells", lambda c: strip(F.coalesce(c, F.lit("")))), " | ")
    lines = blocks.select("doc_id", F.when(F.col("kind") == "table", 1).otherwise(0).alias("late"), "block_idx", line.alias("line")).where(F.regexp_replace("line", r"[\s|]", "") != "")
    return _joined(lines, ["late", "block_idx", "line"], "line")


def pages_to_text(pages: DataFrame) -> DataFrame:
    """A document's pages with blank lines between; a missing page text is empty."""
    return _joined(pages.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("line")), ["page_no", "line"], "line")


def _joined(lines: DataFrame, order: list[str], column: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*order)))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p[column]), "\n\n").alias("text"))


def useful_text(docs: DataFrame, min_chars: int = fixed.MIN_USEFUL) -> DataFrame:
    """Adds ``useful`` and the ``reason`` where a text is too short to be used."""
    n = F.length(strip(F.coalesce("text", F.lit(""))))
    reason = F.when(n == 0, "empty").when(n < min_chars, "short")
    return docs.withColumn("useful", n >= min_chars).withColumn("reason", reason)


def pdf_layer_text(docs: DataFrame, min_chars: int = fixed.MIN_USEFUL) -> DataFrame:
    """Texts of ``.pdf`` rows repaired, without contents lines, and empty where too little is left; others as they are."""
    clean = strip_toc_lines(repair_text(F.col("text")))
    kept = F.when(F.length(strip(clean)) >= min_chars, clean).otherwise("")
    return docs.withColumn("text", F.when(F.col("suffix") == ".pdf", kept).otherwise(F.col("text")))
