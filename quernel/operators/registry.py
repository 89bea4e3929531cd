"""Register facts for a table of questions.

``questions(question_id, question)``; ``registry(row_id, name, model, serial,
address, qty_raw, unit, replace_year_raw)`` with string values.  Whether a row
matches a question depends on the stems of its name and model alone, so rows of
the same set of stems (a kind) are matched once, and the register is summed by
description, then by kind before it is joined: the joins grow with the number of
kinds.  The key of a kind is a digest of its stems.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernel.functions import fixed
from quernel.functions.text import asked_year, fill, format_number, matches, replacement_words, significant_words, stems, strip, to_number, to_year
from quernel.sources.scratch import held

BITMAP_BYTES = 4096  # of Spark's bitmaps


def _digest(*columns: str):
    return F.md5(F.concat_ws("\x01", *(F.coalesce(c, F.lit("")) for c in columns)))


def with_kind(registry: DataFrame) -> DataFrame:
    """Adds ``kind_stems``, the sorted distinct stems of name and model, and ``kind``, their digest."""
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("model", F.lit("")))
    words = F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: F.length(w) >= 4)
    return registry.withColumn("kind_stems", F.array_sort(stems(words))).withColumn("kind", F.md5(F.array_join("kind_stems", " ")))


def numbered(kinds: DataFrame) -> DataFrame:
    """``kind, kind_stems, kind_no`` of the distinct kinds; numbers of one part of the table follow one another."""
    return held(kinds.select("kind", "kind_stems").distinct().withColumn("kind_no", F.monotonically_increasing_id()), "kinds")


def stem_bitmaps(kinds: DataFrame) -> DataFrame:
    """``stem, bucket, bits``: the numbers of the kinds that have a stem, 32,768 in a bitmap."""
    rows = kinds.select((F.col("kind_no") + 1).alias("n"), F.explode("kind_stems").alias("stem"))
    return rows.groupBy("stem", F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def match_by_stem(questions: DataFrame, kinds: DataFrame) -> DataFrame:
    """``(question_id, kind_no)`` where a numbered kind shares a stem with the question's ``stems``.

    A common stem is a few bitmaps, not a row for each kind, and a question's bitmaps
    are or-ed before they are read, so that no pair comes twice and none is made distinct.
    """
    asked = questions.select("question_id", F.explode("stems").alias("stem"))
    met = asked.join(stem_bitmaps(kinds), "stem").groupBy("question_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    schema = T.StructType([questions.schema["question_id"], T.StructField("kind_no", T.LongType())])
    arrow = to_arrow_schema(schema)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bits = np.frombuffer(batch.column(2)[row].as_py(), np.uint8)
                numbers = np.flatnonzero(np.unpackbits(bits, bitorder="little")) + (batch.column(1)[row].as_py() - 1) * 8 * BITMAP_BYTES
                question = batch.column(0).take(pa.array(np.full(len(numbers), row)))
                yield pa.RecordBatch.from_arrays([question.cast(arrow.field(0).type), pa.array(numbers.astype(np.int64))], schema=arrow)

    return met.mapInArrow(unfold, schema)


def _asked_terms(questions: DataFrame, stop_words) -> DataFrame:
    asked = questions.withColumn("matched_terms", significant_words(F.col("question"), stop_words)).where(F.size("matched_terms") > 0)
    return asked.withColumn("stems", stems(F.col("matched_terms")))


def count_cells(questions: DataFrame, registry: DataFrame, stop_words=fixed.COUNT_STOP_WORDS) -> DataFrame:
    """``question_id, address, unit, positions, quantity, first``: what matches each question, by address and unit.

    An absent address has a text of its own, a blank one stays blank; ``first`` is the first row.
    """
    unit = strip(F.coalesce("unit", F.lit("")))
    address = F.coalesce("address", F.lit(fixed.NO_ADDRESS))
    counts = [F.count("*").alias("positions"), F.sum(to_number(F.col("qty_raw"))).alias("quantity"), F.min("row_id").alias("first")]
    again = [F.sum("positions").alias("positions"), F.sum("quantity").alias("quantity"), F.min("first").alias("first")]
    described = registry.groupBy("name", "model", address.alias("address"), unit.alias("unit")).agg(*counts)
    kinds = with_kind(described).groupBy("kind", "kind_stems", "address", "unit").agg(*again)
    summed = held(kinds, "summed")  # read for the match and for the sums
    of_kinds = numbered(summed)
    met = match_by_stem(_asked_terms(questions, stop_words), of_kinds).join(of_kinds.select("kind_no", "kind"), "kind_no").join(summed.drop("kind_stems"), "kind")
    return met.groupBy("question_id", "address", "unit").agg(*again)


def _totals(questions: DataFrame, cells: DataFrame, stop_words) -> DataFrame:
    by_unit = cells.groupBy("question_id", "unit").agg(F.sum("positions").alias("n"), F.sum("quantity").alias("q"), F.min("first").alias("first"))
    best = F.min_by("unit", F.when(F.col("unit") != "", F.struct((-F.col("n")).alias("n"), "first"))).alias("unit")
    totals = by_unit.groupBy("question_id").agg(F.sum("n").alias("total_positions"), F.sum("q").alias("total_quantity"), best)
    out = totals.join(_asked_terms(questions, stop_words).select("question_id", "matched_terms"), "question_id")
    return out.select("question_id", "matched_terms", "total_positions", "total_quantity", F.coalesce("unit", F.lit("")).alias("unit"))


def _by_address(cells: DataFrame) -> DataFrame:
    return cells.groupBy("question_id", "address").agg(F.sum("quantity").alias("quantity"), F.min("first").alias("first_row"))


def count_equipment(questions: DataFrame, registry: DataFrame, stop_words=fixed.COUNT_STOP_WORDS) -> DataFrame:
    """``question_id, matched_terms, total_positions, total_quantity, unit`` where anything matches.

    The unit is the most frequent one that is not blank; of equals the one met first.
    """
    return _totals(questions, count_cells(questions, registry, stop_words), stop_words)


def quantity_by_address(questions: DataFrame, registry: DataFrame, stop_words=fixed.COUNT_STOP_WORDS) -> DataFrame:
    """``question_id, address, quantity, first_row``: the matching quantity at each address."""
    return _by_address(count_cells(questions, registry, stop_words))


def replacements_due(questions: DataFrame, registry: DataFrame, as_of_year: int, show: int = 20, stop_words=fixed.COUNT_STOP_WORDS, words=None) -> tuple[DataFrame, DataFrame]:
    """Positions whose replacement year has come, as ``(totals, rows)``.

    ``totals``: question_id, matched_terms, year, total_positions.  ``rows``: the
    first ``show`` of each question by year, then row.  A question without a word
    for equipment gets all due positions: their counts by year and first ``show``
    rows are the same for all such questions and found once.
    """
    found = significant_words(F.col("question"), stop_words) if words is None else words
    asked = questions.withColumn("matched_terms", replacement_words(found)).withColumn("year", asked_year(F.col("question"), as_of_year))
    asked = asked.withColumn("stems", stems(F.col("matched_terms")))
    due = registry.withColumn("due_year", to_year(F.col("replace_year_raw"))).where("due_year is not null")
    described = with_kind(due.groupBy("name", "model", "due_year").agg(F.count("*").alias("n")))
    counts = held(described.groupBy("kind", "kind_stems", "due_year").agg(F.sum("n").alias("n")), "due")
    of_kinds = numbered(counts)
    named = asked.where(F.size("stems") > 0)
    met = match_by_stem(named, of_kinds).join(of_kinds.select("kind_no", "kind"), "kind_no").join(named.select("question_id", "year"), "question_id")
    # One row a kind: its years, of which there are 200, with what is due by then.
    running = F.sum("n").over(Window.partitionBy("kind").orderBy("due_year"))
    by_year = counts.withColumn("n", running).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("due_year", "n"))).alias("years"))
    by_then = F.try_element_at(F.filter("years", lambda y: y["due_year"] <= F.col("year")), F.lit(-1))["n"]
    of_named = met.join(by_year, "kind").select("question_id", by_then.alias("n")).where("n is not null").groupBy("question_id").agg(F.sum("n").alias("total_positions"))
    # No question shows more than the first rows of one description, or of one kind.
    first = lambda rows, key: rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("due_year", "row_id"))).where(F.col("k") <= show).drop("k")
    early = first(with_kind(first(due.withColumn("described", _digest("name", "model")), "described")), "kind").drop("described", "kind_stems")
    rows = met.join(early, "kind").where("due_year <= year")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("due_year", "row_id"))).where(F.col("rank") <= show)
    shown = ["row_id", "name", "address", "replace_year_raw", "due_year"]

    # One row of at most a few hundred years, one of ``show`` positions.
    open_ones = asked.where(F.size("stems") == 0).select("question_id", "year")
    years = counts.groupBy("due_year").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("due_year", "n")).alias("years"))
    until = F.aggregate(F.filter("years", lambda y: y["due_year"] <= F.col("year")), F.lit(0).cast("long"), lambda s, y: s + y["n"])
    of_open = open_ones.join(F.broadcast(years)).select("question_id", until.alias("total_positions")).where("total_positions > 0")
    top = due.select(*shown).orderBy("due_year", "row_id").limit(show)
    top = top.agg(F.array_sort(F.collect_list(F.struct("due_year", "row_id", "name", "address", "replace_year_raw"))).alias("top"))
    of_top = open_ones.join(F.broadcast(top)).select("question_id", "year", F.posexplode("top").alias("place", "x")).where("x.due_year <= year")
    of_top = of_top.select("question_id", (F.col("place") + 1).alias("rank"), *(F.col(f"x.{c}").alias(c) for c in shown))

    totals = of_named.unionByName(of_open).join(asked.select("question_id", "matched_terms", "year"), "question_id")
    return totals.select("question_id", "matched_terms", "year", "total_positions"), rows.select("question_id", "rank", *shown).unionByName(of_top)


def count_text(counts: DataFrame, by_address: DataFrame) -> DataFrame:
    """``question_id, facts_text`` of a count; addresses by quantity, then as first met."""
    line = F.concat(F.lit("  - "), F.col("address"), F.lit(": "), format_number(F.col("quantity")))
    shown = by_address.select("question_id", (-F.col("quantity")).alias("q"), "first_row", line.alias("line"))
    lines = shown.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("q", "first_row", "line"))).alias("places"))
    head = fill(fixed.COUNTED, F.array_join("matched_terms", " "), F.col("total_positions").cast("string"), format_number(F.col("total_quantity")), F.col("unit"))
    text = F.concat(strip(head), F.lit(fixed.BY_ADDRESS), F.array_join(F.transform("places", lambda p: p["line"]), "\n"))
    return counts.join(lines, "question_id").select("question_id", text.alias("facts_text"))


def due_text(totals: DataFrame, rows: DataFrame, show: int = 20) -> DataFrame:
    """``question_id, facts_text`` of a list of positions that are due."""
    item = fill(fixed.DUE_ITEM, *(F.coalesce(c, F.lit("")) for c in ("name", "replace_year_raw", "address")))
    lines = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("line")))).alias("items"))
    head = fill(fixed.DUE, F.col("total_positions").cast("string"), F.col("year").cast("string"))
    more = F.when(F.col("total_positions") > show, fill(fixed.DUE_MORE, (F.col("total_positions") - show).cast("string"))).otherwise("")
    return totals.join(lines, "question_id").select("question_id", F.concat(head, F.array_join(F.transform("items", lambda x: x["line"]), "\n"), more).alias("facts_text"))


def answer_from_registry(questions: DataFrame, registry: DataFrame, as_of_year: int, stop_words=fixed.COUNT_STOP_WORDS, count=fixed.FACT_COUNT, replacement=fixed.FACT_REPLACEMENT) -> DataFrame:
    """``question_id, kind, facts_text`` of the questions that ask for register facts and have any.

    The register is matched once; its counts by address and unit are written and
    summed both ways.
    """
    due = matches(F.col("question"), replacement)
    counted = questions.where(~due & matches(F.col("question"), count))
    totals, rows = replacements_due(questions.where(due), registry, as_of_year, stop_words=stop_words)
    cells = held(count_cells(counted, registry, stop_words), "cells")
    counts = count_text(_totals(counted, cells, stop_words), _by_address(cells))
    return counts.withColumn("kind", F.lit("count")).unionByName(due_text(totals, rows).withColumn("kind", F.lit("replacement"))).select("question_id", "kind", "facts_text")


def _prefixes(w):
    """A word and its beginnings of at least 5 letters that lack 1 to 3 letters."""
    n = F.length(w)
    low = F.greatest(F.lit(5), n - 3)
    shorter = F.when(low < n, F.transform(F.sequence(low, n - 1), lambda k: F.substring(w, F.lit(1), k))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(w), shorter)


def find_matching_rows(questions: DataFrame, registry: DataFrame, limit: int = 20, stop_words=fixed.SEARCH_STOP_WORDS) -> DataFrame:
    """``question_id, rank, score, row_id, name, model, serial``: register rows that share enough words.

    Words match if equal, or if one of at least 5 letters begins the other and at
    most 3 are missing.  Question words that match no row at all do not count;
    of the others all must match if there are one or two, else half.  Rows are found
    by a question's rarest words alone, then all of its words are looked for in them.
    """
    asked = questions.select("question_id", F.posexplode(significant_words(F.col("question"), stop_words)).alias("pos", "w"))
    fields = ("model", "serial", "name")
    rows = registry.withColumn("text", _digest(*fields))
    whole = F.concat_ws("\x01", *(F.coalesce(c, F.lit("")) for c in fields))
    parts = F.array_distinct(F.filter(F.split(F.lower(whole), r"(?U)\W+"), lambda w: F.length(w) >= 3))
    texts = held(rows.select("text", *fields).distinct().select("text", parts.alias("words")), "texts")
    words = texts.select("text", F.explode("words").alias("c"))
    often = held(words.groupBy("c").agg(F.count("*").alias("df")), "often")
    q = asked.select("w").distinct()
    longer = q.join(often.select("c", "df", F.explode(_prefixes(F.col("c"))).alias("w")), "w").select("w", "c", "df")
    shorter = often.join(q.select("w", F.explode(_prefixes(F.col("w"))).alias("c")), "c").select("w", "c", "df")
    roots = longer.unionByName(shorter).distinct().groupBy("w").agg(F.collect_list("c").alias("cs"), F.sum("df").alias("df"))

    known = held(asked.join(roots, "w"), "known")
    n = F.count("*").over(Window.partitionBy("question_id"))
    by_rarity = F.row_number().over(Window.partitionBy("question_id").orderBy("df", "pos"))
    needed = F.when(F.col("n") <= 2, F.col("n")).otherwise(F.floor((F.col("n") + 1) / 2))
    # A row that has enough of the words has one of the rarest: of n words, n less those needed may be missing.
    rare = known.withColumn("n", n).withColumn("place", by_rarity).where(F.col("place") <= F.col("n") - needed + 1)
    met = rare.select("question_id", F.explode("cs").alias("c")).distinct().join(words, "c").select("question_id", "text").distinct()
    wanted = known.groupBy("question_id").agg(F.collect_list("cs").alias("wanted"), F.count("*").alias("n")).withColumn("needed", needed).drop("n")
    score = F.size(F.filter("wanted", lambda cs: F.arrays_overlap(cs, F.col("words")))).cast("long")
    scores = met.join(wanted, "question_id").join(texts, "text").select("question_id", "text", "needed", score.alias("score")).where("score >= needed").drop("needed")
    early = rows.withColumn("k", F.row_number().over(Window.partitionBy("text").orderBy("row_id"))).where(F.col("k") <= limit)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "row_id")
    out = scores.join(early, "text").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return out.select("question_id", "rank", "score", "row_id", "name", "model", "serial")


def shown_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, shown``: whether any row has a value that is not blank."""
    any_value = rows.agg(*(F.max(F.coalesce(strip(F.col(c)), F.lit("")) != "").alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.coalesce(c, F.lit(False)).alias("shown")) for c in columns)))
    return any_value.select(pairs.alias("p")).select("p.*")


def drop_blank_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Only those of ``columns`` that are not blank throughout, beside all others."""
    shown = {r["column_name"] for r in shown_columns(rows, columns).where("shown").collect()}  # one row a column
    return rows.select(*(c for c in rows.columns if c not in columns or c in shown))
