"""Quality by random-indexing word vectors and a small network.

Random indexing gives every word a fixed sparse random vector; a word's own
vector is the sum of the random vectors of its neighbours over the whole
corpus.  Words are hashed into a fixed number of rows, so the table of vectors
has a fixed size.  A document is the mean of its words' vectors beside the mean
of their random vectors; a two-layer network scores it, and a temperature
fitted on rows that the network has not seen calibrates the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernel.llm._shared import keyed, map_batches
from quernel.llm.labels import labelled_sample

PER_CLASS = 8000  # labelled documents of each class on which the network is trained
ROWS = 8192  # hashed words
SIZE = 32  # of a vector
REACH = 2  # neighbours on either side
HIDDEN = 24
EPOCHS = 40

_RNG = np.random.default_rng(7)


def _ternary(n: int) -> np.ndarray:
    """Random vectors with a few entries of 1 and -1."""
    out = np.zeros((n, SIZE), np.float32)
    for k in range(n):
        at = _RNG.choice(SIZE, 6, replace=False)
        out[k, at[:3]], out[k, at[3:]] = 1, -1
    return out


INDEX = _ternary(ROWS)
_CASE = bytes((0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b) for b in range(256))


class FormRows(dict):
    """Rows of token forms: case, digits and signs of a token's ends, with runs cut short."""

    def __missing__(self, ends: bytes) -> int:
        short = bytes(b for k, b in enumerate(ends) if not k or b != ends[k - 1])
        row = self[ends] = xxhash.xxh3_64_intdigest(b"\0" + short) % ROWS
        return row


class TokenCodes(dict):
    """Remembers ``word row * ROWS + form row`` of tokens, up to a bound."""

    def __init__(self):
        super().__init__()
        self.forms = FormRows()

    def __missing__(self, token: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
            self.forms.clear()
        word = xxhash.xxh3_64_intdigest(token.lower()) % ROWS
        code = self[token] = word * ROWS + self.forms[(token[:2] + token[-3:]).translate(_CASE)]
        return code


def token_rows(text: str | None, codes: TokenCodes) -> np.ndarray:
    """Hashed rows ``(words, forms)`` of the text's tokens; a repeat of the last token has a form of its own."""
    tokens = (text or "").encode("utf-8", "surrogatepass").split()
    code = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
    rows = np.array(np.divmod(code, ROWS))
    rows[1, 1:][code[1:] == code[:-1]] = 1
    return rows


def neighbours(rows: np.ndarray) -> np.ndarray:
    """For each token the sum of its neighbours' random vectors."""
    own = INDEX[rows[0]] + INDEX[rows[1]]
    total = np.zeros_like(own)
    for k in range(1, REACH + 1):
        total[:-k] += own[k:]
        total[k:] += own[:-k]
    return total


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors over all of ``docs``, with rows of length 1 or 0.

    Each task sums its own table and returns it once; Spark adds the tables.
    The result has ``ROWS * SIZE`` numbers, whatever the input.
    """
    names = [f"c{k}" for k in range(SIZE)]
    schema = T.StructType.fromDDL("slot int, " + ", ".join(f"{n} double" for n in names))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((ROWS, SIZE))
        codes = TokenCodes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for text in batch.slice(at, 64).column(0).to_pylist():
                    rows = token_rows(text, codes)
                    if rows.shape[1]:
                        slots = rows[0]
                        order = np.argsort(slots, kind="stable")
                        starts = np.flatnonzero(np.diff(slots[order], prepend=-1))
                        table[slots[order][starts]] += np.add.reduceat(neighbours(rows)[order], starts, axis=0)
        used = np.flatnonzero(np.abs(table).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(table[used, k]) for k in range(SIZE))], schema=arrow)

    parts = docs.select(F.col("text").cast("string")).mapInArrow(run, schema)
    total = parts.groupBy("slot").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    table = np.zeros((ROWS, SIZE))
    table[total["slot"].to_numpy()] = total[names].to_numpy()
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return np.divide(table, length, out=table, where=length > 0).astype(np.float32)


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def pooled(text: str | None, vectors: np.ndarray, codes: TokenCodes) -> np.ndarray:
    """Mean word vector, mean random vector of the words' forms, and log length."""
    words, forms = token_rows(text, codes)
    n = len(words)
    if not n:
        return np.zeros(2 * SIZE + 1, np.float32)
    return np.concatenate([vectors[words].mean(axis=0), INDEX[forms].mean(axis=0), [np.log1p(n) / 10]]).astype(np.float32)


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> QualityModel:
    rng = np.random.default_rng(11)
    order = rng.permutation(len(x))
    held = order[: len(x) // 6]
    used = order[len(x) // 6 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    n = x.shape[1]
    p = [rng.normal(0, np.sqrt(2 / n), (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z = (x - mean) / scale
    step = 0
    for epoch in range(EPOCHS):
        rng.shuffle(used)
        rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
        for at in range(0, len(used), 256):
            k = used[at : at + 256]
            h = np.maximum(z[k] @ p[0] + p[1], 0)
            e = weight[k] * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - y[k]) / len(k)
            dh = np.outer(e, p[2]) * (h > 0)
            grads = [z[k].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if len(held):
        logits = model.logits(x[held])

        def loss(t: float) -> float:
            q = np.clip(logits / t, -30, 30)
            return float((weight[held] * (np.logaddexp(0, q) - y[held] * q)).sum())

        model.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return model


def learn_quality(docs: DataFrame, labels: DataFrame, usable, per_class: int = PER_CLASS) -> QualityModel:
    """Word vectors over all of ``docs``; a network from labels ``quality`` where ``usable`` holds.

    ``per_class`` bounds the labelled documents that the network is trained on.
    Where a class has no label every score is the share of label 1, or 0.5.
    """
    vectors = word_vectors(docs)
    sample, totals = labelled_sample(docs, labels, "quality", usable, per_class)
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    width = 2 * SIZE + 1
    if not n1 or not n0:
        bias = 0.0 if n1 + n0 == 0 else (20.0 if n1 else -20.0)
        return QualityModel(vectors, np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), bias, 1.0)
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    codes = TokenCodes()

    def work(c):
        return {"doc_id": c["doc_id"], "y": c["y"], "x": [pooled(t, held.value, codes).tobytes() for t in c["text"]]}

    rows = map_batches(sample, work, "doc_id long, y int, x binary").collect()  # at most twice per_class
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, width).astype(np.float64)
    y = np.array([r["y"] for r in rows], float)
    weight = np.where(y == 1, n1 / max(1, (y == 1).sum()), n0 / max(1, (y == 0).sum()))
    return _train(x, y, weight / weight.mean(), vectors)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, th, n_tokens, score``, one row per row of ``docs``.

    * Null, empty and blank texts have no tokens; their vector is zero, and they
      get its score.
    * Repeated rows get a row each; equal texts get equal scores.
    * Null ids stay null; other columns are not read; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    codes = TokenCodes()

    def work(c):
        m = held.value
        x = np.array([pooled(t, m.vectors, codes) for t in c["text"]], np.float64).reshape(-1, 2 * SIZE + 1)
        score = m.probability(x)
        return {"doc_id": c["doc_id"], "th": c["th"], "n_tokens": [len((t or "").encode("utf-8", "surrogatepass").split()) for t in c["text"]], "score": score.tolist()}

    return map_batches(keyed(docs), work, "doc_id long, th long, n_tokens long, score double")
