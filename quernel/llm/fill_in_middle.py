"""Fill-in-the-middle transformation of whole texts.

A text is cut in blocks of a fixed number of UTF-8 bytes.  A Fenwick tree over the
blocks holds how many units end in each and how many code points begin in it.  A
cut after a number of units is found by a binary-lifting descent of the tree, which
names the block and the code points before it, and then inside that block alone.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm._shared import map_batches, unused

BLOCK = 4096  # bytes of a text block
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class BlockTree:
    """A Fenwick tree of two counts for each block: units and code points."""

    def __init__(self, units: np.ndarray, points: np.ndarray):
        at = np.arange(1, len(units) + 1)
        below = at - (at & -at)
        sums = np.zeros((2, len(units) + 1), np.int64)
        np.cumsum(units, out=sums[0, 1:])
        np.cumsum(points, out=sums[1, 1:])
        self.tree = sums[:, at] - sums[:, below]
        self.top = 1 << len(units).bit_length()
        self.total = int(sums[0, -1])

    def block_of(self, unit: int) -> tuple[int, int, int]:
        """The block in which a unit (from 1) ends, with the units and the code points of the blocks before it."""
        units, points = self.tree
        block, left, before, step = 0, unit, 0, self.top
        while step:
            to = block + step
            if to <= len(units) and units[to - 1] < left:
                block, left, before = to, left - int(units[to - 1]), before + int(points[to - 1])
            step >>= 1
        return block, unit - left, before


class CutText:
    """A text with its tree; ``cut`` gives places after a number of units.

    Units are the matches of a pattern, left to right, or single code points where
    there is none.  Memory besides the text follows the number of blocks, not of units.
    """

    def __init__(self, text: str, unit: re.Pattern | None = None, block: int = BLOCK):
        self.text, self.unit, self.block = text, unit, block
        self.data = text.encode("utf-8", "surrogatepass")
        begins = (np.frombuffer(self.data, np.uint8) & 0xC0) != 0x80
        starts = np.arange(0, len(begins), block)
        points = np.add.reduceat(begins, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        if unit is None:
            self.tree = BlockTree(points, points)
        else:
            self.tree = BlockTree(self._count(np.cumsum(points)), points)

    def _ends(self, start: int = 0):
        return (m.end() for m in self.unit.finditer(self.text, start) if m.end() > m.start())

    def _count(self, upto: np.ndarray) -> np.ndarray:
        """Units that end in each block; keeps where the matching of a block has to go on."""
        units = np.zeros(len(upto), np.int64)
        self.resume = np.zeros(len(upto), np.int64)
        bounds, at, last = upto.tolist(), 0, 0
        for end in self._ends():
            while end > bounds[at]:
                at += 1
                self.resume[at] = last
            units[at] += 1
            last = end
        self.resume[at + 1 :] = last
        return units

    def cut(self, unit: int) -> tuple[int, int]:
        """The byte and the code point after ``unit`` units; zeros for none."""
        if unit <= 0:
            return 0, 0
        block, units, points = self.tree.block_of(unit)
        start = block * self.block
        part = np.frombuffer(self.data, np.uint8, min(self.block, len(self.data) - start), start)
        begins = np.flatnonzero((part & 0xC0) != 0x80)
        if self.unit is None:
            point = points + unit - units
        else:
            ends = self._ends(int(self.resume[block]))
            for _ in range(unit - units):
                point = next(ends)
        inside = point - points
        if inside < len(begins):
            return start + int(begins[inside]), point
        end = start + len(part)  # the block's last code point may reach into the next
        while end < len(self.data) and self.data[end] & 0xC0 == 0x80:
            end += 1
        return end, point


def draws(doc_id, seed: str) -> list[int]:
    """The first four 8-digit groups of the SHA-256 of ``seed:doc_id``; a null id counts as empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def fill_in_middle(docs: DataFrame, unit: str | None = None, seed: str = "1", plain_of_100: int = 10, spm_of_100: int = 20, block: int = BLOCK) -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars, output``.

    A text is cut into ``n`` units: code points, or the matches of the pattern
    ``unit``.  Two draws from the hash of the id say after how many units the prefix
    and the middle end; what is left is the suffix.  ``form`` is ``psm`` (prefix,
    suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain`` (the text as it
    is): for empty texts, for texts that hold one of the three marks, and for
    ``plain_of_100`` of a hundred others.

    * A null text is empty, a null id is drawn for as the empty one.
    * Repeated rows give a row each, with equal draws; texts of any length are cut whole.
    * Other columns stay; added names that clash are put behind underscores.  An
      empty table gives no rows.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    names = unused(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    kept = docs.columns
    pattern = re.compile(unit) if unit is not None else None

    def work(c: dict[str, list]) -> dict[str, list]:
        out = {name: [] for name in names}
        for doc_id, text in zip(c["doc_id"], c["text"]):
            held = CutText(text or "", pattern, block)
            n = held.tree.total
            h1, h2, h3, h4 = draws(doc_id, seed)
            whole = not text or h3 % 100 >= 100 - plain_of_100 or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))
            if whole:
                made = n, "plain", None, None, text or ""
            else:
                (a, a_point), (b, b_point) = (held.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                prefix, middle, suffix = (p.decode("utf-8", "surrogatepass") for p in (held.data[:a], held.data[a:b], held.data[b:]))
                if h4 % 100 < spm_of_100:
                    made = n, "spm", a_point, b_point - a_point, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
                else:
                    made = n, "psm", a_point, b_point - a_point, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
            for name, value in zip(names, made):
                out[name].append(value)
        return {name: c[name] for name in kept} | out

    types = dict(zip(names, ("long", "string", "long", "long", "string")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` {t}" for n, t in types.items())])
    return map_batches(docs, work, schema, rows=64)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, 2**31 - 1)
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(body))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(rest))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    late_suffix, late_prefix, late_middle = parts(SUFFIX, PREFIX)
    psm, spm = F.concat(prefix, middle, suffix), F.concat(late_prefix, late_middle, late_suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
