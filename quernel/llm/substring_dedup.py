"""Substring removal by hashing lines.

A text is cut into pieces: its lines, and long lines again at sentence ends, so
that a passage is found in the middle of a line too.  Units are pieces with
enough words, and the shortest runs of pieces with enough words that begin or end
with a shorter piece: so every run of whole pieces with enough words in all that
an earlier place has too goes whole, however short its pieces are.  Units are
normalised and hashed, digests are grouped over the whole corpus, the earliest
ranked occurrence stays and the others go, with their offsets in the original text.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm._shared import keyed, map_batches, materialize, plain_words, same_document, unused

MIN_WORDS = 8  # shorter passages recur by chance and always stay
_BORDER = re.compile(r"(?<=[.!?…؟۔।])\s+|(?<=[。！？])\s*|\n+")
# Scripts written without spaces: two characters count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def pieces(text: str) -> list[tuple[int, int, int, int, bytes]]:
    """``(start, end, next_start, size, normalised)`` of the pieces with words; size is in words."""
    out = []
    at = 0
    ascii_only = text.isascii()
    for a, b in [*(m.span() for m in _BORDER.finditer(text)), (len(text), len(text))]:
        if at < a:
            part = text[at:a]
            words = plain_words(part.encode("utf-8", "surrogatepass"))
            if words:
                size = len(words) if ascii_only or part.isascii() else len(words) + len(_UNSPACED.findall(part)) // 2
                out.append((at, a, b, size, b" ".join(words)))
        at = b
    return out


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, bytes]]:
    """``(start, end, next_start, normalised)`` of the units, in order of start, then end.

    Offsets count code points; ``next_start`` is after the unit's separator.  A
    piece of fewer than ``min_words`` is joined to those after it until there are
    enough words, and in another unit to those before it.  No unit lies inside
    another without sharing its start or end.
    """
    p = pieces(text)
    runs = set()
    for i, x in enumerate(p):
        if x[3] >= min_words:
            runs.add((i, i))
            continue
        for step in (1, -1):
            j, size = i, x[3]
            while size < min_words and 0 <= j + step < len(p):
                j += step
                size += p[j][3]
            if size >= min_words:
                runs.add((min(i, j), max(i, j)))
    return [(p[i][0], p[j][1], p[j][2], p[i][4] if i == j else b"\n".join(x[4] for x in p[i : j + 1])) for i, j in sorted(runs)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def unit_table(docs: DataFrame, min_words: int) -> DataFrame:
    """One row for each unit; ``again`` marks a repeat within its own document, apart from the first occurrence."""

    def work(c):
        out = {"doc_id": [], "th": [], "hi": [], "lo": [], "start": [], "end": [], "next": [], "again": []}
        for doc_id, th, text in zip(c["doc_id"], c["th"], c["text"]):
            seen: dict[int, int] = {}
            for a, b, after, norm in units(text or "", min_words):
                d = xxhash.xxh3_128_intdigest(norm)
                out["doc_id"].append(doc_id)
                out["th"].append(th)
                out["hi"].append(_signed(d >> 64))
                out["lo"].append(_signed(d & (2**64 - 1)))
                out["start"].append(a)
                out["end"].append(b)
                out["next"].append(after)
                out["again"].append(d in seen and a >= seen[d])
                seen.setdefault(d, after)
        return out

    return map_batches(docs, work, "doc_id long, th long, hi long, lo long, start int, end int, next int, again boolean")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, th, spans)``: what goes from each document, in order of offset and apart."""
    found = materialize(unit_table(docs, min_words), "units")
    often = materialize(found.groupBy("hi", "lo").agg(F.count("*").alias("times")).where("times > 1").select("hi", "lo"), "often")
    found = materialize(found.join(often, ["hi", "lo"], "left_semi"), "repeats")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = materialize(found.groupBy("hi", "lo").agg(F.min(rank).alias("first")), "first")
    goes = F.col("again") | ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))
    gone = found.join(first, ["hi", "lo"]).where(goes)
    spans = gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end", "next"))).alias("spans"))

    def work(c):
        return {"doc_id": c["doc_id"], "th": c["th"], "spans": [apart(x) for x in c["spans"]]}

    return materialize(map_batches(spans, work, "doc_id long, th long, spans array<struct<start:int,end:int,next:int>>"), "spans")


def apart(spans: list[dict]) -> list[dict]:
    """Sorted spans with those that overlap joined."""
    out: list[dict] = []
    for x in spans:
        if out and x["start"] < out[-1]["next"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], x["end"]), "next": max(out[-1]["next"], x["next"])}
        else:
            out.append(x)
    return out


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the half-open ``spans``, which are sorted and apart."""
    if not spans:
        return text
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` with ``text`` cut, ``n_chars`` recounted and ``removed_spans``.

    The rank of an occurrence is document id (null last), then text hash, then
    offset.  ``removed_spans`` holds ``start`` and ``end`` of each removed unit in
    the original text, in code points, overlapping units as one; the separator
    goes with it.  Units are
    compared by their words (letters, digits, non-ASCII; A-Z lower-cased).

    * Null and empty texts have no units and stay as they are; a null text's
      ``n_chars`` is 0.
    * Rows equal in id and text are one document: each keeps its first units.
    * Other columns, of whatever name, stay (``n_chars`` is replaced).
    * An empty table gives no rows.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars", "removed_spans")]
    key, of_id, of_th, gone, shorter_name = unused(docs, "key", "of_id", "of_th", "gone", "shorter")
    spans = repeated_spans(keyed(docs), min_words).select(F.col("doc_id").alias(of_id), F.col("th").alias(of_th), F.col("spans").alias(gone))
    joined = docs.withColumn(key, F.xxhash64("text")).join(spans, same_document("doc_id", key, of_id, of_th), "left")

    @F.pandas_udf("string")
    def shorter(text, gone):
        import pandas as pd

        return pd.Series([t if g is None else cut(t, [(x["start"], x["next"]) for x in g]) for t, g in zip(text, gone)], dtype=object)

    # Rows without repeats do not pass through Python.
    cut_text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(shorter("text", gone))
    shown = F.transform(F.coalesce(gone, F.array()), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    joined = joined.withColumn(shorter_name, cut_text)
    columns = {"text": F.col(shorter_name), "n_chars": F.coalesce(F.length(shorter_name), F.lit(0)).cast("long")}
    kept = [F.col(c) if c in rest else columns[c].alias(c) for c in docs.columns if c in rest or c in columns]
    if "n_chars" not in docs.columns:
        kept.append(columns["n_chars"].alias("n_chars"))
    return joined.select(*kept, shown.alias("removed_spans"))
