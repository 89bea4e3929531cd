"""Best-fit packing into sequences of several permitted lengths.

Each task packs the documents it holds, in blocks, so that nothing is shuffled
and a lost task is packed again by itself.  Items go, longest first, to the
fullest bin that still has room.  Where none has, a bin is opened of the length
that will cost least per token after downsizing, judged by what is left to pack;
so lengths are mixed as the items need.  A block is packed that way and once for
every permitted length as the only one to open; bins are downsized to the least
permitted length that holds their contents, and the packing of least total cost
stays.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

LENGTHS = (256, 512, 1024, 2048)
PER_SEQUENCE = 8.0  # cost of a sequence besides its length
BLOCK = 65_536  # pieces that are packed together


def cost(capacity: int, per_sequence: float = PER_SEQUENCE) -> float:
    return capacity + per_sequence


class Remaining:
    """Sizes that are still to be packed, which go longest first."""

    def __init__(self, sizes: list[int]):
        count = Counter(sizes)
        self.sizes = sorted(count)
        self.counts = [count[s] for s in self.sizes]

    def take(self, size: int) -> None:
        at = bisect_left(self.sizes, size)
        self.counts[at] -= 1
        while self.counts and not self.counts[-1]:
            self.sizes.pop()
            self.counts.pop()

    def filling(self, room: int) -> int:
        """Tokens that the longest items that still fit would bring into ``room``, one after another."""
        filled, upto = 0, len(self.sizes)
        while upto:
            upto = bisect_right(self.sizes, room - filled, 0, upto)
            if upto:
                upto -= 1
                filled += self.sizes[upto] * min(self.counts[upto], (room - filled) // self.sizes[upto])
        return filled


def _packed(sizes: list[int], order: list[int], lengths: tuple[int, ...], only: int | None, per_sequence: float) -> tuple[list[int], list[int]]:
    """The bin of each item and the tokens of each bin; ``only`` opens one length, else what is left decides."""
    open_at: list[int] = []  # distinct free room of open bins, ascending
    bins_with: dict[int, list[int]] = {}
    used: list[int] = []
    where = [0] * len(sizes)
    left = Remaining(sizes) if only is None else None
    for k in order:
        size = sizes[k]
        if left:
            left.take(size)
        p = bisect_left(open_at, size)
        if p < len(open_at):
            room = open_at[p]
            b = bins_with[room].pop()
            if not bins_with[room]:
                del bins_with[room]
                open_at.pop(p)
        else:
            fits = [c for c in lengths if c >= size]
            if left is None:
                room = max(only, fits[0])
            else:
                tokens = {c: size + left.filling(c - size) for c in fits}
                room = min(fits, key=lambda c: (cost(smallest(lengths, tokens[c]), per_sequence) / tokens[c], c))
            b = len(used)
            used.append(0)
        where[k] = b
        used[b] += size
        room -= size
        if room:
            if room not in bins_with:
                insort(open_at, room)
                bins_with[room] = []
            bins_with[room].append(b)
    return where, used


def smallest(lengths: tuple[int, ...], tokens: int) -> int:
    return lengths[bisect_left(lengths, tokens)]


def best_fit(sizes: list[int], lengths: tuple[int, ...], per_sequence: float = PER_SEQUENCE) -> tuple[list[int], list[int]]:
    """The bin of each item, and the permitted length of each bin, by least total cost.

    ``sizes`` are from 1 to the longest of ``lengths``, which ascend.
    """
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    best = None
    for only in (None, *lengths):
        where, used = _packed(sizes, order, lengths, only, per_sequence)
        small = [smallest(lengths, u) for u in used]
        total = sum(cost(c, per_sequence) for c in small)
        if best is None or total < best[0]:
            best = total, where, small
    return best[1], best[2]


def cut_pieces(n_tokens: int, most: int) -> list[tuple[int, int]]:
    """``(start, size)`` of the pieces of a document: full sequences, then the rest."""
    return [(a, min(most, n_tokens - a)) for a in range(0, n_tokens, most)]


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, n_tokens=None, per_sequence: float = PER_SEQUENCE) -> DataFrame:
    """Places in sequences for every row of ``docs(doc_id, text, ...)``.

    ``n_tokens`` is a column that counts a row's tokens; by default its words
    between white space and an end mark, or 0 for a text without words.

    Returns ``doc_id, piece, start, n_tokens, task, bin, place, used, capacity``: the
    piece ``[start, start + n_tokens)`` of the document lies at ``place`` in sequence
    ``(task, bin)``, of permitted length ``capacity``, of which ``used`` are filled.

    * A document longer than the longest sequence is cut into full ones and a rest.
    * Null, empty and blank texts have no tokens: one row with ``n_tokens`` 0 and no
      sequence.  A null or negative count is 0.
    * Repeated rows and null ids are packed like any others.
    * Other columns are not read; an empty table gives no rows.
    """
    lengths = tuple(sorted(set(lengths)))
    if not lengths or lengths[0] < 1:
        raise ValueError("lengths must be positive")
    if n_tokens is None:
        words = F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+"))
        n_tokens = F.when(words > 0, words + 1).otherwise(0)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(n_tokens.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    schema = T.StructType.fromDDL("doc_id long, piece int, start long, n_tokens long, task int, bin long, place long, used long, capacity long")
    arrow = to_arrow_schema(schema)

    def packed(pieces: list[tuple], task: int, first: int) -> tuple[pa.RecordBatch, int]:
        full = [k for k, p in enumerate(pieces) if p[3]]
        where, capacity = best_fit([pieces[k][3] for k in full], lengths, per_sequence)
        used = [0] * len(capacity)
        rows: list[tuple] = [(*p, task, None, None, None, None) for p in pieces]
        for k, b in zip(full, where):
            rows[k] = (*pieces[k], task, first + b, used[b], b, None)
            used[b] += pieces[k][3]
        rows = [r if r[5] is None else (*r[:7], used[r[7]], capacity[r[7]]) for r in rows]
        columns = list(zip(*rows)) if rows else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow), first + len(capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        for batch in batches:
            for doc_id, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held += [(doc_id, k, a, size) for k, (a, size) in enumerate(cut_pieces(n, lengths[-1]))] or [(doc_id, 0, 0, 0)]
                if len(held) >= BLOCK:
                    out, first = packed(held, task, first)
                    held = []
                    yield out
        if held:
            yield packed(held, task, first)[0]

    return counted.mapInArrow(run, schema)


def filled(placed: DataFrame) -> DataFrame:
    """Sequences, tokens and the share of their room that is filled, by permitted length."""
    bins = placed.where("bin is not null").groupBy("task", "bin").agg(F.max("capacity").alias("capacity"), F.sum("n_tokens").alias("tokens"))
    return bins.groupBy("capacity").agg(F.count("*").alias("sequences"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.sum("capacity")).alias("fill"))
