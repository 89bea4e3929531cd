"""Document fingerprints from closed syncmers.

A stretch of K code points is an anchor if the least hash among its inner
stretches of S code points lies at its first or last place.  Whether a stretch
is an anchor depends on nothing around it, so that equal passages have equal
anchors wherever they stand.  A fingerprint is a bottom sketch of the anchors;
two texts are compared by all their anchors, matched in order of position.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernel.llm._shared import keyed, map_batches, same_document

K = 16
S = 5
SKETCH = 96  # anchors in a fingerprint
PIECE = 32_768  # anchors of a text full of repeats that are held as bits at once; no result depends on it
SAMPLED = 64  # ids for each range of documents

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(33))


def syncmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in code points and 64-bit hashes of the closed syncmers of ``text``.

    A text shorter than K has one anchor, the whole.  A longer one without any
    closed syncmer has one too: its least inner stretch.  An empty one has none.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if n < K:
        acc = np.array([n], np.uint64)
        for k in range(n):
            acc = _mixed(acc * _A + points[k : k + 1])
        return np.zeros(1, np.int64), acc
    inner = points[: n - S + 1].copy()
    for j in range(1, S):
        inner = inner * _A + points[j : n - S + 1 + j]
    inner = _mixed(inner)
    width = K - S + 1
    least, have = inner, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    count = n - K + 1
    at = np.flatnonzero((inner[:count] == least) | (inner[width - 1 :] == least))
    if not len(at):
        low = int(inner.argmin())
        return np.array([low]), inner[low : low + 1]
    acc = inner[at]
    for j in (S, 2 * S, width - 1):
        acc = _mixed(acc * _A + inner[at + j])
    return at, acc


def least(hashes: np.ndarray) -> np.ndarray:
    """The least ``SKETCH`` distinct 32-bit anchor hashes, ascending."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:SKETCH]


def sketch(text: str) -> np.ndarray:
    return least(syncmers(text)[1])


def as_text(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared anchors of both texts over their mean number (Dice), estimated from sketches.

    1 for two empty fingerprints, 0 for one.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:SKETCH]
    j = np.intersect1d(np.intersect1d(a, both, True), b, True).size / len(both)
    return 2 * j / (1 + j)


def in_order(a: np.ndarray, b: np.ndarray) -> int:
    """The most anchors that stand in both texts in the same order (longest common subsequence).

    Exact at every length.  Texts so full of repeats that pairs of equal anchors outnumber anchors
    64 times are matched in bits, whose time grows with the length of one text times the
    anchors that are left out, at most with the product of both lengths.
    """
    short = min(len(a), len(b))
    apart = np.flatnonzero(a[:short] != b[:short])
    ahead = int(apart[0]) if len(apart) else short
    a, b = a[ahead:], b[ahead:]
    short -= ahead
    apart = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    behind = int(apart[0]) if len(apart) else short
    a, b = a[: len(a) - behind], b[: len(b) - behind]
    ahead += behind
    a, b = a[np.isin(a, b)], b[np.isin(b, a)]
    if not len(a):
        return ahead
    _, named = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = named[: len(a)], named[len(a) :]
    by_name, starts = np.argsort(x, kind="stable"), np.searchsorted(np.sort(x), np.arange(named.max() + 2))
    n_x = np.diff(starts)
    if int(n_x[y].sum()) <= 64 * (len(x) + len(y)):
        # Few pairs of equal anchors: the longest ascending run of places, later places of one anchor first.
        tails: list[int] = []
        for k in y.tolist():
            for place in by_name[starts[k] : starts[k + 1]][::-1].tolist():
                at = bisect_left(tails, place)
                tails[at : at + 1] = [place]
        return ahead + len(tails)
    # Many: the same in bits, one for each place, first as if few anchors were left out.
    likely = max(0, min(len(x), len(y)) - PIECE)
    found = _matched(x, y, likely)
    return ahead + (found if found >= likely else _matched(x, y, found))


def _matched(x: np.ndarray, y: np.ndarray, sure: int) -> int:
    """The longest common subsequence of two sequences of names; where it is shorter than ``sure``, no more than it.

    ``PIECE`` places of ``x`` at a time meet those of ``y``; what a place of ``y`` adds to the pieces so far
    is carried into the next.  Places so far apart that fewer than ``sure`` could match beside them do not meet.
    """
    carried = bytearray(len(y))
    found = 0
    for start in range(0, len(x), PIECE):
        piece = x[start : start + PIECE]
        low, high = max(0, start - len(x) + sure), min(len(y), start + len(piece) + len(y) - sure)
        top = 1 << len(piece)
        state = top - 1
        places: dict[int, int] = {}
        for at, k in enumerate(y[low:high].tolist(), low):
            bits = places.get(k)
            if bits is None:
                bits = places[k] = int.from_bytes(np.packbits(piece == k, bitorder="little").tobytes(), "little")
            both = state & bits
            grown = state + both
            if carried[at]:
                grown += 1
            state = grown | (state ^ both)
            if state >= top:
                state ^= top
                carried[at] = 1
            else:
                carried[at] = 0
        own = len(piece) - state.bit_count()
        beyond = np.frombuffer(carried, np.uint8)[high:]
        taken = np.flatnonzero(beyond)[:own]  # without matches here, each takes the place of one found here
        beyond[taken] = 0
        found += own - len(taken)
    return found


def nearness(a: np.ndarray, b: np.ndarray) -> float:
    """Anchors of both texts that match in order over their mean number (Dice), from all anchors in order of position.

    1 for two texts without anchors, 0 for one.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = in_order(a, b)
    j = both / (len(a) + len(b) - both)
    return 2 * j / (1 + j)


def anchors(docs: DataFrame) -> DataFrame:
    """``doc_id, th, place, anchor``: every closed syncmer of every text, for positional matching.

    Null and empty texts have none.  Other columns are not read.
    """

    def work(c):
        out = {"doc_id": [], "th": [], "place": [], "anchor": []}
        for doc_id, th, text in zip(c["doc_id"], c["th"], c["text"]):
            at, h = syncmers(text or "")
            out["doc_id"] += [doc_id] * len(at)
            out["th"] += [th] * len(at)
            out["place"] += at.tolist()
            out["anchor"] += h.view(np.int64).tolist()
        return out

    return map_batches(keyed(docs), work, "doc_id long, th long, place long, anchor long", rows=64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, th, n_chars, fingerprint``, one row per row of ``docs``.

    Equal texts have equal fingerprints; null and empty texts have the empty one.
    Other columns are not read; an empty table gives no rows.
    """

    def work(c):
        texts = [t or "" for t in c["text"]]
        return {"doc_id": c["doc_id"], "th": c["th"], "n_chars": [len(t) for t in texts], "fingerprint": [as_text(sketch(t)) for t in texts]}

    return map_batches(keyed(docs), work, "doc_id long, th long, n_chars long, fingerprint string")


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by the first as many code points of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _in_order(key: tuple) -> tuple:
    return key[0] is None, 0 if key[0] is None else -key[0], key[1]


class Ranges:
    """Ranges of the descending order of ids (null last, ties by text hash), cut at quantiles of sampled ``(doc_id, th)``.

    Ids are compared as integers.  An id that holds many rows is cut by text hash, so
    that no id fills a task; rows equal in id and text share a range.
    """

    def __init__(self, sample: list[tuple], parts: int):
        keys = sorted(sample, key=_in_order)
        cuts = sorted({keys[len(keys) * k // parts] for k in range(1, parts)} if keys else (), key=_in_order)
        self.ids = np.array([~k[0] for k in cuts if k[0] is not None], np.int64)  # ascending, as ids fall
        self.th = np.array([k[1] for k in cuts if k[0] is not None], np.int64)
        self.null_th = np.array([k[1] for k in cuts if k[0] is None], np.int64)

    def number(self, doc_id: np.ndarray, missing: np.ndarray, th: np.ndarray) -> np.ndarray:
        """Numbers of ranges, ascending in the order of documents; ``doc_id`` does not count where ``missing``."""
        low, high = (np.searchsorted(self.ids, ~doc_id, side) for side in ("left", "right"))
        out = low.copy()
        for at in np.unique(low[(low < high) & ~missing]).tolist():  # ids that cuts lie in
            own = (low == at) & (low < high) & ~missing
            end = int(high[own][0])
            out[own] = at + np.searchsorted(self.th[at:end], th[own], "right")
        return np.where(missing, len(self.ids) + np.searchsorted(self.null_th, th, "right"), out)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text and the next document.

    Documents stand in descending order of id (null last; ties by text hash);
    after the last comes the first.  The table is cut into ranges of ids at
    quantiles of a sample, each range also gets the first document of the next one, and a
    range is read as a stream in order, so that texts move once and no task
    holds more than two of them.

    Returns ``doc_id, th, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``; both likenesses come from all anchors.

    * A null text is empty.  A table of one row has itself as the next document.
    * Repeated rows are documents of their own, one after the other.
    * Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = keyed(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = docs.select("doc_id", "th").sample(min(1.0, SAMPLED * parts / max(1, docs.count())), seed=1)
    held = spark.sparkContext.broadcast(Ranges([tuple(r) for r in drawn.collect()], parts))  # only where ranges are cut depends on the sample

    @F.pandas_udf("int")
    def number(doc_id, missing, th):
        import pandas as pd

        return pd.Series(held.value.number(doc_id.to_numpy(np.int64), missing.to_numpy(bool), th.to_numpy(np.int64)).astype(np.int32))

    ranged = docs.withColumn("range", number(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "th"))
    # One row for each range: no more than twice as many as partitions.
    heads = ranged.groupBy("range").agg(F.max(F.struct("doc_id", F.bitwise_not("th").alias("th"))).alias("head"))
    heads = heads.select("range", F.col("head.doc_id").alias("head_id"), F.bitwise_not(F.col("head.th")).alias("head_th"))
    heads = heads.withColumn("before", F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy(F.lit(0)))))
    met = docs.join(F.broadcast(heads.drop("range")), same_document("doc_id", "th", "head_id", "head_th"))
    ghosts = met.groupBy("doc_id", "th", F.col("before").alias("range")).agg(F.first("text").alias("text"))
    rows = ranged.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    schema = T.StructType.fromDDL("doc_id long, th long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    arrow = to_arrow_schema(schema)

    def row(held: tuple, text: str, own: np.ndarray) -> tuple:
        changed = edited(held[2], text)
        other = syncmers(changed)[1]
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return held[0], held[1], len(held[2]), sha, as_text(least(held[3])), as_text(least(other)), nearness(held[3], other), nearness(held[3], own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # doc_id, th, text, anchors
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                made = []
                for ghost, doc_id, th, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if held is None and ghost:
                        continue
                    text = text or ""
                    s = syncmers(text)[1]
                    if held is not None:
                        made.append(row(held, text, s))
                    held = None if ghost else (doc_id, th, text, s)
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    spread = rows.repartitionByRange(parts, "range").sortWithinPartitions("range", "ghost", F.col("doc_id").desc_nulls_last(), "th")
    return spread.select("ghost", "doc_id", "th", "text").mapInArrow(run, schema)
