"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

The lexicon is learned from labelled documents: word beginnings and whole words
that are much commoner in toxic documents, with log odds as weights, and
exceptions, which are words, pairs and triples in which a match does not count.
A document's hits are summed, normalised by its length, and turned into a
probability by a logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm._shared import built_once, keyed, map_batches, new_key, plain_words, unused
from quernel.llm.labels import labelled_sample

PER_CLASS = 6000  # labelled documents of each class from which the lexicon is learned
LEAST = 3  # toxic documents that hold an entry
SURE = 15.1  # least log-likelihood ratio of an entry's counts: a chance of 1e-4
PREFIXES = range(4, 9)  # lengths of word beginnings

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u", "ց": "g", "α": "a",
    "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a",
    "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}

_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}  # full-width forms
_HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | _WIDE | _HIDDEN
_LOOKALIKE = re.compile("[" + "".join(HOMOGLYPHS) + "！-～­​‌‍⁠﻿]")
_SIGN = re.compile(r"[01345789@$!|]")
_WRITTEN = re.compile(r"[\w@$!|]+")
_PUT = str.maketrans(SUBSTITUTES)


def _unmask(m: re.Match) -> str:
    word = m[0].rstrip("@$!|")
    if not _SIGN.search(word) or sum(map(str.isalpha, word)) < 2:
        return m[0]
    return word.translate(_PUT) + m[0][len(word) :]


def fold(text: str) -> bytes:
    """Lower-cased text with look-alikes and substitutes folded; words joined by a space.

    Letters of mathematical and other styles become plain ones; accents stay, as words
    of other languages differ by them.

    A substitute is folded where it is written together with two letters or more;
    signs at the end of a word are not.  Starts and ends with a space unless there
    are no words.
    """
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKC", low).lower()
        if _LOOKALIKE.search(low):
            low = low.translate(_FOLD)
    if _SIGN.search(low):
        low = " ".join(t if t.isalpha() or not _SIGN.search(t) else _WRITTEN.sub(_unmask, t) for t in low.split())
    words = plain_words(low.encode("utf-8", "surrogatepass"))
    return b" %s " % b" ".join(words) if words else b""


@dataclass
class Lexicon:
    """Entries are folded text: `` word`` is a beginning, `` word `` a whole word."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = 0.0
    slopes: tuple[float, ...] = (0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        a = ahocorasick.Automaton()
        for p in self.exceptions:
            a.add_word(p, (len(p), None))
        for p, w in self.weights.items():
            a.add_word(p, (len(p), w))
        a.make_automaton()
        return a


def measures(folded: bytes, automaton) -> tuple[float, float, float, int]:
    """Summed weight, the same over the root of the length, strongest weight, and hits.

    Of entries that start at the same word the strongest counts, unless an
    exception covers it.
    """
    if automaton is None or not folded:
        return 0.0, 0.0, 0.0, 0
    at: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(folded.decode("utf-8", "surrogatepass")):
        start = end - n + 1
        if w is None:
            spared.append((start, end))
        else:
            at[start] = max(w, at.get(start, 0.0))
    if spared:
        spared.sort()
        reach = k = 0
        for start in sorted(at):
            while k < len(spared) and spared[k][0] <= start:
                reach = max(reach, spared[k][1])
                k += 1
            if start < reach:
                del at[start]
    if not at:
        return 0.0, 0.0, 0.0, 0
    total = sum(at.values())
    return math.log1p(total), total / math.sqrt(folded.count(b" ")), max(at.values()), len(at)


def _entries(word: str) -> list[str]:
    return [*(f" {word[:n]}" for n in PREFIXES if n <= len(word)), f" {word} "] if len(word) >= 3 else []


def _candidates(folded: bytes, of: set[str] | None = None, chosen=()) -> set[str]:
    """Entries that the text holds; with ``of``, only those, and at words that no chosen entry matches."""
    found = set()
    for word in set(folded.decode("utf-8", "surrogatepass").split()):
        own = _entries(word)
        if of is None:
            found.update(own)
        elif not any(e in chosen for e in own):
            found.update(e for e in own if e in of)
    return found


def _around(folded: bytes, weights: dict[str, float]) -> set[str]:
    """Words that an entry matches, and the pairs and triples that they stand in."""
    words = folded.decode("utf-8", "surrogatepass").split()
    known = {w: any(e in weights for e in _entries(w)) for w in set(words)}
    found = set()
    for i, w in enumerate(words):
        if known[w]:
            for n in (1, 2, 3):
                found.update(f" {' '.join(words[k : k + n])} " for k in range(max(0, i - n + 1), min(i, len(words) - n) + 1))
    return found


def _folded(sample: DataFrame) -> DataFrame:
    return map_batches(sample.select("y", "text"), lambda c: {"y": c["y"], "folded": [fold(t or "") for t in c["text"]]}, "y int, folded binary")


def _counts(sample: DataFrame, held: Callable[[bytes], set[str]]) -> DataFrame:
    """Documents of each class that contain each of what ``held`` finds."""

    def work(c):
        toxic, clean = Counter(), Counter()
        for y, folded in zip(c["y"], c["folded"]):
            (toxic if y else clean).update(held(folded))
        entries = list(toxic.keys() | clean.keys())
        return {"entry": entries, "toxic": [toxic[e] for e in entries], "clean": [clean[e] for e in entries]}

    parts = map_batches(sample, work, "entry string, toxic long, clean long", rows=4096)
    return parts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _evident(of_toxic: int, of_clean: int):
    """Entries that are at least four times as common in toxic documents, and not by chance."""
    t, c = F.col("toxic"), F.col("clean")
    by_chance = (t + c) / float(of_toxic + of_clean)
    ratio = 2 * (t * F.log(t / (by_chance * of_toxic)) + F.when(c > 0, c * F.log(c / (by_chance * of_clean))).otherwise(0.0))
    commoner = (t + 0.5) * (of_clean + 1) >= 4.0 * (c + 0.5) * (of_toxic + 1)
    return F.when(t >= LEAST, commoner & (ratio >= SURE)).otherwise(False)


def choose(rows: list[tuple[str, int, int]], of_toxic: int, of_clean: int) -> tuple[dict[str, float], set[str]]:
    """Weights of chosen entries, and beginnings of chosen entries that await their own counts.

    An entry goes only if a chosen beginning is its prefix.  A beginning that
    ranks below a longer entry is not judged by the documents of that entry.
    """
    weight = {e: _weight(t, c, of_toxic, of_clean) for e, t, c in rows}
    chosen: dict[str, float] = {}
    above: set[str] = set()
    later = set()
    for e, t, _ in sorted(rows, key=lambda r: (-weight[r[0]] * r[1], r[0].endswith(" "), -len(r[0]), r[0])):
        begins = [e[: n + 1] for n in PREFIXES if n + 1 < len(e)]
        if any(k in chosen for k in begins):
            continue
        if e in above:
            later.add(e)
        else:
            chosen[e] = weight[e]
            above.update(begins)
    return chosen, later


def _weight(toxic: int, clean: int, of_toxic: int, of_clean: int) -> float:
    return math.log((toxic + 0.5) / (of_toxic + 1)) - math.log((clean + 0.5) / (of_clean + 1))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn_lexicon(docs: DataFrame, labels: DataFrame, usable, per_class: int = PER_CLASS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from labels ``toxic`` of rows where ``usable`` holds.

    ``per_class`` bounds the labelled documents that are looked at.  ``exceptions``
    adds phrases in which no match counts.  Without labels of both classes the
    lexicon is empty and every score is the share of toxic labels, or 0.
    """
    sample, totals = labelled_sample(docs, labels, "toxic", usable, per_class)
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Lexicon(bias=0.0 if n1 + n0 == 0 else (-20.0 if n0 else 20.0))
    sample = _folded(sample).persist()
    seen = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    of_toxic, of_clean = seen.get(1, 0), seen.get(0, 0)
    evident = _evident(of_toxic, of_clean)
    weights: dict[str, float] = {}
    later: set[str] | None = None
    while later is None or later:
        counts = _counts(sample, partial(_candidates, of=later, chosen=set(weights)))
        rows = counts.where(evident).collect()  # as many as the labelled sample shows
        more, later = choose([(r["entry"], r["toxic"], r["clean"]) for r in rows], of_toxic, of_clean)
        weights |= more
    lexicon = Lexicon(weights, [fold(p).decode("utf-8", "surrogatepass") for p in exceptions if fold(p)])
    # Words under an entry, and pairs and triples around a hit, that are no commoner in toxic documents are exceptions.
    if weights:
        innocent = _counts(sample, partial(_around, weights=weights)).where((F.col("clean") >= 3) & (F.col("toxic") * of_clean <= F.col("clean") * of_toxic))
        lexicon.exceptions += sorted(r["entry"] for r in innocent.select("entry").collect())
    held = _measure(sample.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("th"), "y", F.col("folded").alias("text")), lexicon, ["y"], folded=True)
    got = held.select("y", "m0", "m1", "m2").collect()  # at most twice per_class rows
    sample.unpersist()
    x = np.array([[r["m0"], r["m1"], r["m2"]] for r in got])
    y = np.array([r["y"] for r in got], float)
    w = np.where(y == 1, n1 / max(1, of_toxic), n0 / max(1, of_clean))
    b = _logistic(x, y, w * len(w) / w.sum())
    lexicon.bias, lexicon.slopes = float(b[0]), tuple(float(k) for k in b[1:])
    return lexicon


def _measure(docs: DataFrame, lexicon: Lexicon, more: list[str], folded: bool = False) -> DataFrame:
    key = new_key()

    def work(c):
        automaton = built_once(key, lexicon.automaton)
        m = [measures(t if folded else fold(t or ""), automaton) for t in c["text"]]
        return {k: c[k] for k in ("doc_id", "th", *more)} | {f"m{i}": [x[i] for x in m] for i in range(4)}

    schema = "doc_id long, th long, " + "".join(f"{k} int, " for k in more) + "m0 double, m1 double, m2 double, m3 long"
    return map_batches(docs, work, schema)


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, th, score, n_hits, strongest``, one row per row of ``docs``.

    * Null and empty texts have no hits and get the score of a text without hits.
    * Repeated rows get a row each; equal texts get equal scores.
    * Null ids stay null; other columns are not read; an empty table gives no rows.
    """
    m = _measure(keyed(docs), lexicon, [])
    return m.select("doc_id", "th", _score(lexicon, F.col("m0"), F.col("m1"), F.col("m2")).alias("score"), F.col("m3").alias("n_hits"), F.col("m2").alias("strongest"))


def _score(lexicon: Lexicon, *m):
    z = F.lit(lexicon.bias)
    for slope, x in zip(lexicon.slopes, m):
        z = z + F.lit(slope) * x
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, at_least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is below ``at_least``, with all their columns.

    Treats nulls, empty texts, repeats and empty tables as ``score_toxicity`` does.
    """
    key = new_key()

    @F.pandas_udf("struct<m0:double,m1:double,m2:double>")
    def measured(text):
        import pandas as pd

        automaton = built_once(key, lexicon.automaton)
        return pd.DataFrame([measures(fold(t or ""), automaton)[:3] for t in text], columns=["m0", "m1", "m2"], dtype=float)

    (name,) = unused(docs, "measured")
    marked = docs.withColumn(name, measured("text"))
    return marked.where(_score(lexicon, *(F.col(name)[f"m{k}"] for k in range(3))) < at_least).drop(name)
