"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

Documents are read once for their terms; what they hold of the asked terms is
written as postings.  Each task sorts the postings of a shard of documents by term
and falling impact and reads the lists of an item's terms in step, in blocks.  Every
document met has a lower score, the sum of the impacts read, and an upper one, which
adds for each list not met in yet the impact at which that list stands.  Reading
goes on until no other document can reach the best ``k`` and all scores that can
have met their upper ones.  Documents are never looked up in a list.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernel.llm._shared import discard, map_batches, materialize, plain_words

K = 50
SHARD_POSTINGS = 1_000_000  # of the documents whose lists a task sorts and reads at once
FIRST_READ = 256  # postings of each list in the first round; later rounds read twice as many as before
BLOCK_BYTES = 2_000_000  # of asked terms that one pass over the documents looks for
NO_ID = np.iinfo(np.int64).max  # a null id is the last of equal scores


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: the distinct terms of every item; items without terms give none."""
    lowered = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select("item_id", F.explode(terms).alias("term")).distinct()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def document_postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``doc_id, n, terms, tfs``: a document's number of terms, and the numbers in ``vocabulary`` and counts of those asked for.

    ``terms`` and ``tfs`` are 32-bit integers in a row.  Documents without any term give no row.
    """
    numbers = docs.sparkSession.sparkContext.broadcast({t.encode("utf-8", "surrogatepass"): k for k, t in enumerate(vocabulary)})

    def work(c: dict[str, list]) -> dict[str, list]:
        number = numbers.value
        out = {"doc_id": [], "n": [], "terms": [], "tfs": []}
        for doc_id, text in zip(c["doc_id"], c["text"]):
            words = plain_words(text)
            if words:
                met = [(number[w], tf) for w, tf in Counter(words).items() if w in number]
                out["doc_id"].append(doc_id)
                out["n"].append(len(words))
                out["terms"].append(np.array([t for t, _ in met], np.int32).tobytes())
                out["tfs"].append(np.array([tf for _, tf in met], np.int32).tobytes())
        return out

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return map_batches(read.where("text is not null"), work, "doc_id long, n long, terms binary, tfs binary", rows=64)


def document_frequencies(postings: DataFrame, size: int) -> DataFrame:
    """``term, df``; each task counts its own rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for terms in batch.column(0).to_pylist():
                df[np.frombuffer(terms, np.int32)] += 1  # a document's terms are distinct
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    return postings.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Lists:
    """The impact-sorted lists of a shard; a posting is a place in ``ids`` and an impact."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray):
        self.ids = ids
        place = np.repeat(np.arange(len(ids), dtype=np.int64), sizes)
        impact = impacts(weights[terms], tfs.astype(np.int64), m[place])
        order = np.lexsort((-impact, terms))
        order = order[impact[order] > 0]
        self.place, self.impact = place[order], impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def best(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best documents for ``terms``: all of them whose score is ``least`` or more, or the best of these."""
        at, end = self.starts[terms], self.starts[terms + 1]
        at, end = at[at < end], end[at < end]
        lower = np.zeros(len(self.ids), np.int64)
        met = np.zeros((len(self.ids), len(at)), bool)  # in which lists a document has been met
        reach, open_ = FIRST_READ, None  # open_: the documents that may still be among the best
        while True:
            upto = np.minimum(at + reach, end)
            for t in np.flatnonzero(at < upto):
                where = self.place[at[t] : upto[t]]
                lower[where] += self.impact[at[t] : upto[t]]  # a list has a document once
                met[where, t] = True
            at = upto
            standing = np.where(at < end, self.impact[np.minimum(at, end - 1)], 0)
            rest = int(standing.sum())  # the most that a document not met at all can have
            bar = max(least, 1)
            if open_ is None:
                known = np.flatnonzero(lower)
                if len(known) >= k:
                    bar = max(bar, int(np.partition(lower[known], len(known) - k)[len(known) - k]))
                if rest < bar:
                    open_ = known  # whoever was not met yet cannot come in
            else:
                known = open_
                if len(known) >= k:
                    bar = max(bar, int(np.partition(lower[known], len(known) - k)[len(known) - k]))
            near = known[lower[known] + rest >= bar]
            missing = (~met[near]) @ standing if rest else np.zeros(len(near), np.int64)
            within = lower[near] + missing >= bar
            near, missing = near[within], missing[within]
            if open_ is not None:
                open_ = near
                if not missing.any():  # the scores of all that are left have met their upper ones
                    break
            reach *= 2
        order = np.lexsort((self.ids[near], -lower[near]))[:k]
        return near[order], lower[near[order]]


def _search(postings: DataFrame, asked: dict, k: int, item_type: T.DataType) -> DataFrame:
    """``item_id, doc_id, score``: each task's best ``k`` for every item."""
    held = postings.sparkSession.sparkContext.broadcast(asked)
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = held.value
        n_docs, n_terms, weights, items = ask["n_docs"], ask["n_terms"], ask["weights"], ask["items"]
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)  # scores and ids so far

        def search(rows: list[tuple]) -> None:
            ids = np.array([NO_ID if r[0] is None else r[0] for r in rows], np.int64)
            m = np.array([50 + 50 * r[1] * n_docs // n_terms for r in rows], np.int64)
            terms, tfs = (np.frombuffer(b"".join(r[j] for r in rows), np.int32) for j in (2, 3))
            lists = Lists(ids, m, np.array([len(r[2]) // 4 for r in rows]), terms, tfs, weights)
            for i, (_, own) in enumerate(items):
                scores, best = top[i]
                place, found = lists.best(own, k, int(scores[-1]) if len(scores) == k else 1)
                if len(place):
                    scores, best = np.concatenate([scores, found]), np.concatenate([best, ids[place]])
                    order = np.lexsort((best, -scores))[:k]
                    top[i] = scores[order], best[order]

        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and size + len(row[2]) // 4 > SHARD_POSTINGS:
                    search(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2]) // 4
        if rows:
            search(rows)
        for (item_id, _), (scores, ids) in zip(items, top):
            if len(ids):
                found = pa.array(ids, pa.int64(), mask=ids == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(ids), arrow.field(0).type), found, pa.array(scores)], schema=arrow)

    return postings.mapInArrow(run, schema)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score for each item, exactly.

    ``docs(doc_id, text)`` are ranked for ``items(item_id, text)``.  Terms are runs of
    letters, digits and characters above ASCII, with A-Z lower-cased.  Weights and
    lengths are taken over all documents; scores are 64-bit integers.

    Items are a stated query set.  Their terms go to the workers in blocks of
    ``block_bytes``; a larger set takes several passes.  A task leaves its best ``k``
    for each item, so the closing window gets no more, however the documents lie.

    * A null text has no terms: it is no document for the counts and is never found.
      Items without terms, or without documents of positive score, give no rows.
    * Equal scores go by ascending ``doc_id``, null last.  Repeated document rows are
      ranked each; rows that repeat an item id are one item with the terms of all.
    * Other columns are not read; an empty table on either side gives no rows.
    """
    item_type = items.schema["item_id"].dataType
    asked = materialize(item_terms(items), "asked")
    total = asked.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    blocks = [asked if n == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) for b in range(n)]
    found = None
    for block in blocks:
        terms_of: dict = {}
        for item_id, term in block.collect():  # block_bytes or so
            terms_of.setdefault(item_id, []).append(term)
        vocabulary = sorted({t for terms in terms_of.values() for t in terms})
        postings = materialize(document_postings(docs, vocabulary), "postings")
        size = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in document_frequencies(postings, len(vocabulary)).collect():  # one row for each asked term
            weights[term] = term_weight(size["docs"], df)
        number = {t: i for i, t in enumerate(vocabulary)}
        own = [(item_id, np.array([number[t] for t in terms], np.int64)) for item_id, terms in terms_of.items()]
        ask = {"n_docs": size["docs"], "n_terms": size["terms"] or 1, "weights": weights, "items": own}
        part = _search(postings, ask, k, item_type)
        found = part if found is None else found.unionByName(part)
    discard(asked)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
