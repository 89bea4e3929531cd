"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items are patterns over the numbers of normalised
words.  Every document is normalised and scanned once; hits are kept as word
ranges, which map back to offsets of the original text.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm._shared import built_once, keyed, map_batches, new_key, plain_words

WINDOW = 10
BLOCK_BYTES = 2_000_000  # of benchmark text in one automaton, which takes about 90 bytes of memory for each
PIECE_WORDS = 20_000  # of an item that are sent as one row
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def windows(words: list, width: int) -> set[tuple]:
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


class Matcher:
    """The automaton of ``(item_id, text)`` rows; a pattern's value is (words, item ids)."""

    def __init__(self, items: list[tuple], width: int):
        self.numbers: dict[bytes, int] = {}  # of the words of items; others are 0
        patterns: dict[tuple, set] = {}
        for item_id, text in items:
            words = plain_words((text or "").encode("utf-8", "surrogatepass"))
            for w in windows([self.numbers.setdefault(x, len(self.numbers) + 1) for x in words], width):
                patterns.setdefault(w, set()).update([] if item_id is None else [item_id])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, ids in patterns.items():
            self.automaton.add_word(w, (len(w), tuple(ids)))
        self.automaton.make_automaton()

    def hits(self, words: list[bytes]):
        """``(last word, (words, item ids))`` of every occurrence, in order of the last word."""
        if not self.numbers or not words:
            return iter(())
        number = self.numbers.get
        return self.automaton.iter(tuple(number(w, 0) for w in words))

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged half-open word ranges that are hit, and the ids of the items met."""
        ranges: list[list[int]] = []
        items: set = set()
        for end, (n, ids) in self.hits(words):
            start, last = end + 1 - n, end + 1
            items.update(ids)
            while ranges and start <= ranges[-1][1]:
                start = min(start, ranges.pop()[0])
            ranges.append([start, last])
        return ranges, items


def offsets(text: str, ranges: list[list[int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of word ranges."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def benchmark_pieces(benchmark: DataFrame, width: int) -> DataFrame:
    """``item_id, text``: items of up to ``PIECE_WORDS`` words, longer ones in parts that overlap by all but one word of a window.

    The parts of an item have the windows that the whole has, so that no row that is
    sent to a worker grows with an item.
    """
    plain = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_WORD.pattern), F.lit(0))
    cut = plain.select("item_id", words.alias("words")).where(F.size("words") > 0)
    step = max(1, PIECE_WORDS - width + 1)
    last = F.greatest(F.size("words") - width, F.lit(0))
    starts = F.sequence(F.lit(0), last - last % step, F.lit(step))
    pieces = cut.select("item_id", F.explode(F.transform(starts, lambda a: F.array_join(F.slice("words", a + 1, step + width - 1), " "))).alias("text"))
    return pieces.distinct()


def _blocks(pieces: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The pieces in parts whose texts have ``block_bytes`` or so, by size."""
    total = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    if n == 1:
        return [pieces] if total else []
    return [pieces.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, th, n_words, n_hit, items, spans``, one row per row of ``docs``.

    A word inside any occurrence of a window is hit.  ``items`` holds the ids of
    the items met, as strings in order; ``spans`` the hit ranges as ``start`` and
    ``end`` code points of the original text.

    The benchmark is a stated query set, sent to the workers only in blocks of
    ``block_bytes`` of text; a larger one takes several blocks, each scanned over
    all documents and merged by document.

    * Null and empty texts have no words; items without words are nobody's hit.
      An item with a null id hits words but is left out of ``items``.
    * A repeated item id is one item.  A repeated document row gives a row each.
    * Other columns are not read.  Empty tables: no rows, or no hits.
    """
    docs = keyed(docs)
    parts = []
    for block in _blocks(benchmark_pieces(benchmark, width), block_bytes):
        items = [tuple(r) for r in block.collect()]  # block_bytes or so, in pieces of bounded size
        parts.append(_scan_block(docs, items, width))
    parts = parts or [_scan_block(docs, [], width)]
    if len(parts) == 1:
        return parts[0].select("doc_id", "th", "n_words", _hit("ranges").alias("n_hit"), "items", "spans")
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    merged = merged.groupBy("doc_id", "th").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("ranges"))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"),
        (F.count("*") / len(parts)).cast("int").alias("times"),
    )
    merged = merged.withColumn("time", F.explode(F.sequence(F.lit(1), "times")))  # repeated rows
    return merged.select("doc_id", "th", "n_words", _hit("ranges").alias("n_hit"), "items", "spans")


def _hit(ranges: str):
    """Words in the union of sorted, perhaps overlapping ranges."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def step(acc, x):
        a = F.greatest(x["a"], acc["upto"])
        return F.struct((acc["n"] + F.greatest(x["b"] - a, F.lit(0))).alias("n"), F.greatest(x["b"], acc["upto"]).alias("upto"))

    return F.aggregate(ranges, start, step)["n"]


def _scan_block(docs: DataFrame, items: list[tuple], width: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)
    key = new_key()

    def work(c):
        matcher = built_once(key, lambda: Matcher(held.value, width))
        out = {k: c[k] for k in ("doc_id", "th")} | {"n_words": [], "ranges": [], "items": [], "spans": []}
        for text in c["text"]:
            words = plain_words((text or "").encode("utf-8", "surrogatepass"))
            ranges, met = matcher.scan(words)
            out["n_words"].append(len(words))
            out["ranges"].append([{"a": a, "b": b} for a, b in ranges])
            out["items"].append(sorted(met))
            out["spans"].append([{"start": a, "end": b} for a, b in offsets(text, ranges)] if ranges else [])
        return out

    schema = "doc_id long, th long, n_words long, ranges array<struct<a:int,b:int>>, items array<string>, spans array<struct<start:int,end:int>>"
    return map_batches(docs, work, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any hit word, with all their columns.

    The scan runs beside the row, so that no join is needed.  Treats nulls,
    repeats and empty tables as ``contamination`` does; a null text stays.
    """
    kept = docs
    for block in _blocks(benchmark_pieces(benchmark, width), BLOCK_BYTES):
        held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in block.collect()])
        kept = kept.where(~_is_hit(held, width)(F.col("text")))
    return kept


def _is_hit(held, width: int):
    key = new_key()

    @F.pandas_udf("boolean")
    def hit(text):
        import pandas as pd

        matcher = built_once(key, lambda: Matcher(held.value, width))
        return pd.Series([bool(t) and next(matcher.hits(plain_words(t.encode("utf-8", "surrogatepass"))), None) is not None for t in text], dtype=bool)

    return hit


def items_digest(items: str = "items"):
    """Lower-case hex SHA-256 of the item ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)
