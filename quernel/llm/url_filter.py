"""URL rules by a Bloom filter cascade.

A rule is a host and a path beginning.  A url's candidate keys are the ends of
its host of as many labels as listed keys have, each with the path beginning of
a listed key's length.  The first filter of a cascade encodes the listed keys;
the second the keys of the corpus that pass the first without being listed; the
third the listed keys that pass the second; and so on until nothing passes
wrongly.  Over the keys it was built for, membership is exact and needs no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm._shared import materialize

MOST_BYTES = 256_000_000  # of all cascades, which are sent to every worker


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both are empty for a null url or one without ``://``."""
    cut = F.instr(F.col(url), "://")
    rest = F.when(cut > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": lower, "path": path})


def shape_of(key: str) -> tuple[int, int]:
    """Labels of a key's host, and characters of its path beginning."""
    host, slash, _ = key.partition("/")
    if not host or not slash:
        raise ValueError(f"a key is a host, a slash and perhaps more path, not {key!r}")
    return host.count(".") + 1, len(key) - len(host)


def candidate_keys(shapes: list[tuple[int, int]]):
    """Array of a row's keys of the given shapes, longest first, ties in order of the alphabet.

    Labels are counted from the end of the host, so that a host of any length has
    all keys that can be listed.
    """
    labels = F.size(F.split("host", r"\."))
    made = [F.when((labels >= n) & (F.length("path") >= k), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, k))) for n, k in shapes]
    keys = F.array_distinct(F.array_compact(F.array(*made))) if made else F.array().cast("array<string>")
    ranked = F.array_sort(F.transform(keys, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("key"))))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(ranked, lambda x: x["key"]))


def _places(keys: list[str], level: int, bits: int, hashes: int) -> np.ndarray:
    raw = [k.encode("utf-8", "surrogatepass") for k in keys]
    one = np.fromiter((xxhash.xxh3_64_intdigest(k, 2 * level) for k in raw), np.uint64, len(raw))
    two = np.fromiter((xxhash.xxh3_64_intdigest(k, 2 * level + 1) for k in raw), np.uint64, len(raw)) | np.uint64(1)
    return ((one[:, None] + two[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


@dataclass
class Bloom:
    level: int
    bits: int
    hashes: int
    table: np.ndarray

    @classmethod
    def of(cls, keys: list[str], rate: float, level: int) -> "Bloom":
        bits = max(64, math.ceil(len(keys) * -math.log(rate) / math.log(2) ** 2))
        hashes = max(1, round(bits / max(1, len(keys)) * math.log(2)))
        hashes = min(hashes, 30)
        table = np.zeros((bits + 7) // 8, np.uint8)
        at = _places(keys, level, bits, hashes).ravel()
        np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return cls(level, bits, hashes, table)

    def passes(self, keys: list[str]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        at = _places(keys, self.level, self.bits, self.hashes)
        return ((self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


@dataclass
class Cascade:
    levels: list[Bloom]

    def holds(self, keys: list[str]) -> np.ndarray:
        """Membership of keys of the universe: decided by the first level that a key does not pass."""
        out = np.zeros(len(keys), bool)
        alive = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            passed = level.passes([keys[i] for i in alive])
            # Odd levels hold listed keys: who fails there is out; even ones hold the rest: who fails is in.
            out[alive[~passed]] = k % 2 == 1
            alive = alive[passed]
        out[alive] = len(self.levels) % 2 == 1
        return out


def build_cascades(universe: DataFrame, lists: dict[str, list[str]]) -> dict[str, Cascade]:
    """A cascade for each list over the distinct keys ``universe(key)``, which are read once for all lists.

    The first level's rate is so low that about as many foreign keys pass as are
    listed, so that a cascade's size follows the list and the logarithm of the
    universe; the keys that pass are few, and only they are looked at again.
    """
    listed = {name: sorted(set(keys)) for name, keys in lists.items()}
    named = [name for name, keys in listed.items() if keys]
    n = max(1, universe.count())
    first = [Bloom.of(listed[name], min(0.5, len(listed[name]) * math.sqrt(0.5) / n), 0) for name in named]
    held = universe.sparkSession.sparkContext.broadcast(first)

    @F.pandas_udf("array<boolean>")
    def passes(keys):
        import pandas as pd

        values = keys.tolist()
        return pd.Series(list(np.array([level.passes(values) for level in held.value]).reshape(len(held.value), len(values)).T), dtype=object)

    wrong: dict[str, set[str]] = {name: set() for name in named}
    if named:
        marked = universe.select("key", passes.asNondeterministic()("key").alias("passed"))
        # Expected to be fewer than the lists, by the rates above; the lists themselves are on the driver.
        for r in marked.where(F.exists("passed", lambda p: p)).toLocalIterator():
            for name, p in zip(named, r["passed"]):
                if p:
                    wrong[name].add(r["key"])
    out = {name: Cascade([]) for name in listed}
    for name, level in zip(named, first):
        levels, inside, outside = [level], listed[name], sorted(wrong[name] - set(listed[name]))
        while outside:
            level = Bloom.of(outside, 0.5, len(levels))
            levels.append(level)
            inside, outside = outside, [k for k, p in zip(inside, level.passes(inside)) if p]
        out[name] = Cascade(levels)
    if sum(x.table.nbytes for c in out.values() for x in c.levels) > MOST_BYTES:
        raise ValueError(f"cascades of more than {MOST_BYTES} bytes are not sent to workers; split the lists by host")
    return out


def build_cascade(universe: DataFrame, listed: list[str]) -> Cascade:
    """The cascade of one list."""
    return build_cascades(universe, {"listed": listed})["listed"]


def judge_urls(pages: DataFrame, rules: dict[str, str], otherwise: str = "allow", blocked: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``pages(page_id, url, ...)`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` maps keys such as ``example.com/en/`` to ``allow`` or ``block``; a key
    is a host, a slash and perhaps more path.  The longest key that fits wins, of
    two of equal length the first in order of the alphabet.  Where none fits,
    ``blocked`` keys block, and the rest get ``otherwise``; their ``rule`` is null.

    * A null url, or one without ``://``, has an empty host and path and fits none.
    * Hosts of any number of labels and urls of any length are judged whole.
    * A repeated row gets a row each; an empty table gives none.
    * Columns named like the added ones are replaced; only ``page_id`` and ``url``
      are read.
    """
    spark = pages.sparkSession
    parsed = with_host_path(pages.select("page_id", "url"))
    keys = candidate_keys(sorted({shape_of(k) for k in [*rules, *blocked]}))
    universe = materialize(parsed.select(F.explode(keys).alias("key")).distinct(), "url-keys")
    lists = {verdict: [k for k, v in rules.items() if v == verdict] for verdict in ("allow", "block")}
    held = spark.sparkContext.broadcast(build_cascades(universe, lists | {"blocked": list(blocked)}))

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def judged(keys):
        import pandas as pd

        flat = [k for row in keys for k in row]
        found = {name: c.holds(flat) for name, c in held.value.items()}
        rule, verdict, at = [], [], 0
        for row in keys:
            hit = [(k, "allow" if found["allow"][at + i] else "block") for i, k in enumerate(row) if found["allow"][at + i] or found["block"][at + i]]
            own = found["blocked"][at : at + len(row)].any()
            rule.append(hit[0][0] if hit else None)
            verdict.append(hit[0][1] if hit else "block" if own else otherwise)
            at += len(row)
        return pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series(verdict, dtype=object)})

    out = parsed.withColumn("judged", judged(keys))
    return out.select("page_id", "url", "host", "path", "judged.rule", "judged.verdict")
