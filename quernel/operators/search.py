"""Lexical and vector top-k search and rank fusion for a table of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernel.functions.text import tokenize
from quernel.sources.scratch import held

K1, B, FLOOR = 1.5, 0.75, 0.25
FEW = 10_000  # collections whose sizes may be sent to every task
MOST_WEIGHTS = 1_000_000  # (collection, term) weights that may be sent to every task
SCAN_QUESTIONS, SCAN_TERMS, SCAN_BYTES = 16_384, 400_000, 64_000_000  # of the questions that one scan of the chunks answers


def postings(chunks: DataFrame, text: str = "text") -> DataFrame:
    """``origin, chunk_id, term, tf, length``: term frequencies of every chunk.

    A chunk's tokens are exploded in one task, so partial aggregation sums them before the shuffle.
    """
    tokens = chunks.select("origin", "chunk_id", tokenize(F.col(text)).alias("tokens"))
    exploded = tokens.select("origin", "chunk_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return exploded.groupBy("origin", "chunk_id", "term", "length").agg(F.count("*").alias("tf"))


def corpus_stats(chunks: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(terms, sizes)``: idf of each term and size of each collection, from one pass over the texts.

    A negative idf becomes a quarter of the collection's mean idf.  Each chunk gives
    its distinct terms and one row without a term for its length, which partial
    aggregation sums before the shuffle; the counts are written once.  Sizes of up
    to ``FEW`` collections are sent to every task, more are joined by shuffles.
    """
    tokens = chunks.select("origin", tokenize(F.col(text)).alias("tokens"))
    whole = F.struct(F.lit(None).cast("string").alias("term"), F.size("tokens").cast("long").alias("n"))
    each = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.lit(0).cast("long").alias("n")))
    rows = tokens.select("origin", F.explode(F.concat(F.array(whole), each)).alias("x")).select("origin", "x.term", "x.n")
    counted = held(rows.groupBy("origin", "term").agg(F.count("*").alias("df"), F.sum("n").alias("n")), "terms")
    sizes = counted.where("term is null").select("origin", F.col("df").alias("n_chunks"), (F.col("n") / F.col("df")).alias("avg_length"))
    few = F.broadcast if sizes.count() <= FEW else (lambda x: x)
    raw = counted.where("term is not null").join(few(sizes), "origin")
    raw = raw.withColumn("raw", F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("origin").agg(F.avg("raw").alias("mean"))
    terms = raw.join(few(mean), "origin").select("origin", "term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return terms, sizes


class Best:
    """The best ``k`` of the rows met so far for each of ``n`` questions, by key, then by id; each has a value beside its key."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.limit = np.full(n, np.inf)  # the k-th key so far
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def offer(self, keys: np.ndarray, values: np.ndarray, ids: np.ndarray) -> None:
        """``keys`` and ``values`` have a row for each id and a column for each question; infinite keys do not count."""
        rows, asked = np.nonzero((keys <= self.limit) & (keys < np.inf))
        self.parts.append((asked, keys[rows, asked], values[rows, asked], ids[rows]))
        self.size += len(rows)
        if self.size > 2 * self.k * len(self.limit) + 20_000:
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Questions, values and ids of the best, question by question."""
        asked, keys, values, ids = map(np.concatenate, zip(*self.parts))
        _, order_of_id = np.unique(ids, return_inverse=True)
        order = np.lexsort((order_of_id, keys, asked))
        place = np.arange(len(order)) - np.searchsorted(asked[order], asked[order])
        last, order = order[place == self.k - 1], order[place < self.k]
        self.limit[asked[last]] = keys[last]
        self.parts, self.size = [(asked[order], keys[order], values[order], ids[order])], len(order)
        return asked[order], values[order], ids[order]


def _best_of_chunks(chunks: DataFrame, questions: DataFrame, setup, k: int, column: str, value: str, scored: Callable, rows: int) -> DataFrame:
    """``question_id, origin, chunk_id, value``: each task's best ``k`` chunks for every question of ``setup``.

    ``scored(setup, origin, column of rows)`` gives keys, of which less is better, and
    values, both of chunks by questions.  The chunks are read where they lie; only what may win is shuffled.
    """
    sent = chunks.sparkSession.sparkContext.broadcast(setup)
    types = {f.name: f.dataType for f in chunks.schema}
    schema = T.StructType([T.StructField("question_id", questions.schema["question_id"].dataType), T.StructField("origin", types["origin"]), T.StructField("chunk_id", types["chunk_id"]), T.StructField(value, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = sent.value
        question_ids = np.array([*ask["ids"], None], object)[:-1]
        best: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                origins = np.array([*part.column("origin").to_pylist(), None], object)[:-1]
                ids = part.column("chunk_id").to_numpy(zero_copy_only=False)
                for origin in dict.fromkeys(origins.tolist()):
                    own = np.array([o == origin for o in origins.tolist()])
                    got = scored(ask, origin, part.column(column).filter(pa.array(own)))
                    if got is not None:
                        best.setdefault(origin, Best(len(question_ids), k)).offer(*got, ids[own])
        for origin, b in best.items():
            asked, values, ids = b.compact()
            columns = [question_ids[asked], [origin] * len(asked), ids, values]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return chunks.select("origin", "chunk_id", column).mapInArrow(run, schema)


def _scans(asked: DataFrame, n: int) -> list[DataFrame]:
    return [asked] if n <= 1 else [asked.where(F.pmod(F.xxhash64("question_id"), F.lit(n)) == b) for b in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bm25_topk(questions: DataFrame, chunks: DataFrame, terms: DataFrame, sizes: DataFrame, k: int = 20, text: str = "text") -> DataFrame:
    """``question_id, origin, chunk_id, score, rank``: the best chunks of each collection with a positive score.

    A token that a question repeats counts as often; ties go by chunk id.  The
    questions' terms and their weights are sent to the chunks, and each task leaves
    only its own best ``k`` for a question; up to ``SCAN_QUESTIONS`` are answered by
    one scan.  Where the weights are too many to send, postings are joined instead.
    """
    asked = questions.select("question_id", F.explode(tokenize(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("times"))
    asked = held(asked, "asked")
    weights = held(terms.join(asked.select("term").distinct(), "term", "left_semi").select("origin", "term", "idf"), "weights")
    if weights.count() > MOST_WEIGHTS or sizes.count() > FEW:
        scores = scores_by_join(asked, postings(chunks, text), weights, sizes)
    else:
        idf = weights.toPandas()
        lengths = {r["origin"]: r["avg_length"] for r in sizes.collect()}
        n = asked.agg(F.count_distinct("question_id").alias("questions"), F.count("*").alias("terms")).first()
        tokens = chunks.select("origin", "chunk_id", tokenize(F.col(text)).alias("tokens"))
        scans = _scans(asked, max(-(-n["questions"] // SCAN_QUESTIONS), -(-n["terms"] // SCAN_TERMS)))
        found = [_best_of_chunks(tokens, questions, _lexical_setup(part.toPandas(), idf, lengths), k, "tokens", "score", _lexical_keys, 128) for part in scans]
        scores = _union(found)
    order = Window.partitionBy("question_id", "origin").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _lexical_setup(asked: pd.DataFrame, idf: pd.DataFrame, lengths: dict) -> dict:
    """The asked terms that the collections have, by number; the terms of a question lie together."""
    vocabulary = pd.Index(sorted(set(asked["term"]) & set(idf["term"])))
    known = asked[asked["term"].isin(vocabulary)].sort_values("question_id", kind="stable")
    weight = {}
    for origin, own in idf.groupby("origin", dropna=False):
        w = np.zeros(len(vocabulary))
        at = vocabulary.get_indexer(own["term"])
        w[at[at >= 0]] = own["idf"].to_numpy()[at >= 0]
        weight[None if origin is None or origin != origin else origin] = w
    ids, starts = np.unique(pd.factorize(known["question_id"])[0], return_index=True)
    return {
        "ids": known["question_id"].iloc[starts].tolist(), "starts": starts, "terms": vocabulary.get_indexer(known["term"]), "times": known["times"].to_numpy(np.float64),
        "vocabulary": pa.array(vocabulary.tolist(), pa.string()), "weight": weight, "length": lengths,
    }


def _lexical_keys(ask: dict, origin, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
    """Rounded scores with the sign turned round, infinite where they are not positive, and the scores."""
    if origin not in ask["weight"] or not len(ask["ids"]):
        return None
    n, v = len(tokens), len(ask["vocabulary"])
    length = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    number = pc.fill_null(pc.index_in(tokens.flatten(), value_set=ask["vocabulary"]), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), length)[number >= 0]
    tf = np.bincount(row * v + number[number >= 0], minlength=n * v).reshape(n, v).astype(np.float64)
    norm = K1 * (1 - B + B * length / (ask["length"][origin] or 1.0))
    part = tf * (K1 + 1) / (tf + norm[:, None] + (tf == 0)) * ask["weight"][origin]
    scores = np.empty((n, len(ask["ids"])))
    starts = np.append(ask["starts"], len(ask["terms"]))
    for q in range(0, len(ask["ids"]), 1024):  # questions at once, so that their terms fit in memory
        upto = min(q + 1024, len(ask["ids"]))
        a, b = starts[q], starts[upto]
        scores[:, q:upto] = np.add.reduceat(part[:, ask["terms"][a:b]] * ask["times"][a:b], starts[q:upto] - a, axis=1)
    return np.where(scores > 0, -np.round(scores, 9), np.inf), scores


def scores_by_join(asked: DataFrame, posts: DataFrame, weights: DataFrame, sizes: DataFrame) -> DataFrame:
    """``question_id, origin, chunk_id, score`` by a join of postings and asked terms, for any number of collections."""
    met = posts.join(asked.join(weights, "term"), ["origin", "term"]).join(sizes, "origin")
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / norm
    return met.groupBy("question_id", "origin", "chunk_id").agg(F.sum(part).alias("score")).where("score > 0")


def vector_topk(questions: DataFrame, chunks: DataFrame, k: int = 20) -> DataFrame:
    """``question_id, origin, chunk_id, distance, rank`` by exact cosine distance.

    ``questions(question_id, embedding)``, ``chunks(chunk_id, origin, embedding)``.
    Questions are a stated set: as many as ``SCAN_BYTES`` hold go to the workers at
    once, and each task leaves only its own best ``k`` for a question.
    """
    asked = questions.select("question_id", "embedding").where("embedding is not null")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    scans = max(-(-size["n"] // SCAN_QUESTIONS), -(-size["n"] * (size["width"] or 0) * 8 // SCAN_BYTES))
    known = chunks.where("embedding is not null")
    parts = [_best_of_chunks(known, questions, _vector_setup(part.toPandas()), k, "embedding", "distance", _vector_keys, 256) for part in _scans(asked, scans)]
    order = Window.partitionBy("question_id", "origin").orderBy("distance", "chunk_id")
    return _union(parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(rows: list) -> np.ndarray:
    m = np.array([np.asarray(e, np.float64) for e in rows])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if len(m) else m


def _vector_setup(asked: pd.DataFrame) -> dict:
    return {"ids": asked["question_id"].tolist(), "matrix": _unit(asked["embedding"].tolist())}


def _vector_keys(ask: dict, origin, embeddings: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
    distance = np.round(1 - _unit(embeddings.to_pylist()) @ ask["matrix"].T, 12) if len(ask["ids"]) else None
    return None if distance is None else (distance, distance)


def rrf_fuse(lists: DataFrame, k: int = 60) -> DataFrame:
    """``question_id, origin, chunk_id, score, distance, position``: reciprocal rank fusion.

    ``lists(question_id, origin, chunk_id, list_no, rank, distance)``.  Ties go by
    the first list that has the chunk, then by its rank there.
    """
    fused = lists.groupBy("question_id", "origin", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.max("distance").alias("distance"), F.min(F.struct("list_no", "rank")).alias("first"))
    order = Window.partitionBy("question_id", "origin").orderBy(F.desc(F.round("score", 12)), "first", "chunk_id")
    return fused.withColumn("position", F.row_number().over(order)).drop("first")


MAX_TOKENS = 512  # of a text that an encoder takes


def pooled(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean of token vectors ``(texts, tokens, size)``, scaled to length 1; zero where no token counts."""
    weight = mask.astype(np.float64)[:, :, None]
    mean = (vectors * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def token_encoder(make_model: Callable, max_tokens: int = MAX_TOKENS) -> Callable:
    """An encoder from a model of token vectors.

    ``make_model()`` gives a function of texts and of the most tokens, which returns
    ``(vectors, mask)`` of shapes ``(texts, tokens, size)`` and ``(texts, tokens)``.
    """

    def make():
        model = make_model()

        def encode(texts: list[str]) -> np.ndarray:
            vectors, mask = model(texts, max_tokens)
            return pooled(np.asarray(vectors)[:, :max_tokens], np.asarray(mask)[:, :max_tokens])

        return encode

    return make


def hash_model(size: int = 64):
    """Token vectors without a model file: a token is one signed place of a hashed vector."""
    import re
    from functools import lru_cache
    from hashlib import md5

    @lru_cache(65_536)
    def hashed(token: str) -> tuple[int, float]:
        h = int.from_bytes(md5(token.encode(), usedforsecurity=False).digest()[:4])
        return h % size, 1.0 if h & 0x10000 else -1.0

    def model(texts: list[str], max_tokens: int) -> tuple[np.ndarray, np.ndarray]:
        tokens = [re.findall("[a-zа-яё0-9]+", (t or "").lower())[:max_tokens] for t in texts]
        lengths = np.array([len(found) for found in tokens], np.int64)
        width = max(1, int(lengths.max(initial=0)))
        vectors = np.zeros((len(texts), width, size), np.float32)
        mask = (np.arange(width) < lengths[:, None]).astype(np.int64)
        if lengths.any():
            slots, signs = zip(*(hashed(token) for found in tokens for token in found))
            row, place = np.nonzero(mask)  # in the order of the tokens
            vectors[row, place, slots] = signs
        return vectors, mask

    return model


#: The default encoder, for use without a model file.
hash_encoder = token_encoder(hash_model)


def embed(df: DataFrame, text: str, make_encoder=hash_encoder, batch: int = 32, column: str = "embedding") -> DataFrame:
    """Adds the vectors of ``text``; the encoder is made once in each worker and fed small batches."""

    @F.pandas_udf("array<float>")
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for series in texts:
            values = series.tolist()
            yield pd.Series([v for at in range(0, len(values), batch) for v in encode(values[at : at + batch])], dtype=object)

    return df.withColumn(column, vectors(F.col(text)))
