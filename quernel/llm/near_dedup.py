"""Near duplicates by a chosen-path set similarity join.

Every document is a set of word shingles, held as minwise tokens.  Independent
trees branch the distinct sets: a node takes one minwise coordinate and its
sets go to the child of their token there.  Small nodes are compared
exhaustively on the tokens, large ones branch again, and what is still large at
the last level holds sets that agree on every chosen token and is linked whole.
The number of trees follows from the wanted recall.  The links found this way
are only a covering, in whose components only pairs that reach the threshold
exactly on full sets are links.  A component of one tile is compared whole.  A
larger one is compared within its tiles, then with a few central sets of all its
tiles; what hangs together by then is a part, and only tiles of different parts
are compared after that, so that a large group of near copies costs about as
many comparisons as it has sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm._shared import Forest, connected_components, discard, hashes, keyed, map_batches, materialize, same_document, spaced_words, unused

TOKENS = 128  # minwise tokens of a set
SMALL = 256  # largest node that is compared exhaustively
CHILDREN = 2  # coordinates by which a large node branches
LEVELS = 2  # branchings below the root
TILE = 128  # sets in a tile of the exact comparison
TILE_SHINGLES = 200_000  # shingles in a tile, about
CENTRAL = 48  # central sets with which all tiles of a component are compared

_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240607)
_MULTIPLY = _RNG.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, TOKENS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes(words)
    if len(h) < width:
        width = len(h)
    n = len(h) - width + 1
    acc = np.full(n, width, np.uint64)
    for j in range(width):
        acc = _mixed(acc + h[j : j + n])
    return np.unique(acc)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """``TOKENS`` minwise tokens of 32 bits."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        low = np.minimum(low, (shingles[at : at + 1024, None] * _MULTIPLY + _ADD).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def trees_for(threshold: float, recall: float) -> int:
    """Trees by which a pair at the threshold is met with probability ``recall``."""
    once = threshold * (1 - (1 - threshold) ** CHILDREN) ** LEVELS
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    def work(c):
        out = {"doc_id": c["doc_id"], "th": c["th"], "n": [], "d": [], "w": [], "tokens": [], "low": []}
        for text in c["text"]:
            s = shingle_set(spaced_words(text or b""), width)
            digest = xxhash.xxh3_128_intdigest(s.tobytes())
            t = minwise(s)
            out["n"].append(len(s))
            out["d"].append(_signed(digest >> 64))
            out["w"].append(_signed(digest & (2**64 - 1)))
            out["tokens"].append(t.tobytes() if len(s) else None)
            out["low"].append(t.astype(np.uint8).tobytes() if len(s) else None)
        return out

    return map_batches(docs.select("doc_id", "th", F.col("text").cast("binary").alias("text")), work, "doc_id long, th long, n long, d long, w long, tokens binary, low binary")


def with_vertices(classes: DataFrame) -> DataFrame:
    """Adds a vertex number ``v`` to distinct sets with 128-bit digests ``(d, w)``.

    It is ``d``, unless sets share that; then the one of least ``w`` keeps it and the
    others get a hash of both halves, so that different sets are different vertices.
    """
    shared = classes.groupBy("d").agg(F.count("*").alias("sets"), F.min("w").alias("first")).where("sets > 1").select("d", "first")
    shared = materialize(shared, "shared")
    if shared.isEmpty():
        discard(shared)
        return classes.withColumn("v", F.col("d"))
    other = F.col("first").isNotNull() & (F.col("w") != F.col("first"))
    return classes.join(shared, "d", "left").withColumn("v", F.when(other, F.xxhash64("d", "w")).otherwise(F.col("d"))).drop("first")


def _branch(rows: DataFrame, root: bool, trees: int) -> DataFrame:
    """Children of nodes: rows ``(node, v, tokens)``, or ``(v, tokens)`` at the root."""

    def work(c):
        out = {"node": [], "v": []}
        for k, (v, tokens) in enumerate(zip(c["v"], c["tokens"])):
            t = np.frombuffer(tokens, np.uint32)
            for j in range(trees if root else CHILDREN):
                # Trees start from different coordinates; below, the node chooses.
                name = f"{'root' if root else c['node'][k]}/{j}"
                i = j % TOKENS if root else xxhash.xxh3_64_intdigest(name) % TOKENS
                out["node"].append(_signed(xxhash.xxh3_64_intdigest(f"{name}/{i}/{t[i]}")))
                out["v"].append(v)
        return out

    return map_batches(rows, work, "node long, v long", rows=2048)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, one list for each run of equal first ``keys`` columns.

    Of rows that are equal in the next column too one is held.
    """
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            if not held or held[-1][keys] != row[keys]:
                held.append(row)
    if held:
        yield held


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], schema=_EDGES)


def _compare_small(nodes: DataFrame, least: float) -> DataFrame:
    """A spanning forest of each small node's pairs whose tokens agree often enough."""

    def run(batches):
        found = []
        for rows in _runs(batches, 1):
            m = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), TOKENS)
            forest = Forest(len(rows))
            for x in range(len(rows) - 1):
                alike = (m[x + 1 :] == m[x]).sum(axis=1)
                found += [(rows[x][1], rows[x + 1 + y][1]) for y in np.flatnonzero(alike >= least * TOKENS).tolist() if forest.join(x, x + 1 + y)]
            if len(found) > 4096:
                yield _edges(found)
                found = []
        yield _edges(found)

    spread = nodes.repartition("node").sortWithinPartitions("node", "v")
    return spread.select("node", "v", "low").mapInArrow(run, "a long, b long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _compare_exact(tiles: DataFrame, share: int, of: int) -> DataFrame:
    """A spanning forest of each tile's pairs with ``of * intersection >= share * union``.

    ``tiles`` has ``comp, ti, tj, v, shingles``.  The set that is likest to the
    others of a tile is given as a link with itself.
    """

    def run(batches):
        found = []
        for rows in _runs(batches, 3):
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(r[4], np.uint64) for r in rows]
            common = intersections(sets)
            size = np.array([len(s) for s in sets], np.int64)
            union = size[:, None] + size[None, :] - common
            linked = of * common >= share * union
            forest = Forest(len(rows))
            for x, y in zip(*(k.tolist() for k in np.nonzero(np.triu(linked, 1)))):
                if forest.join(x, y):
                    found.append((rows[x][3], rows[y][3]))
            central = rows[int((common / union).sum(axis=1).argmax())][3]
            found.append((central, central))
            if len(found) > 4096:
                yield _edges(found)
                found = []
        yield _edges(found)

    spread = tiles.repartition("comp", "ti", "tj").sortWithinPartitions("comp", "ti", "tj", "v")
    return spread.select("comp", "ti", "tj", "v", "shingles").mapInArrow(run, "a long, b long")


def _tile_count(sets: str, shingles: str):
    return F.ceil(F.greatest(F.col(sets) / TILE, F.col(shingles) / TILE_SHINGLES)).cast("int")


def _tile_of(v: str, salt: str):
    return F.pmod(F.xxhash64(v, F.lit(salt)), F.col("tiles")).cast("int")


def exact_links(sets: DataFrame, sizes: DataFrame, share: int, of: int) -> list[DataFrame]:
    """Written tables of exact links ``(a, b)`` by which the sets of each covering component hang together.

    ``sets`` has ``root, tiles, v, n, shingles``, a row for each set; ``sizes`` has
    ``root`` and the number of its ``tiles``.
    """
    whole = sets.where("tiles = 1").select(F.col("root").alias("comp"), F.lit(0).alias("ti"), F.lit(0).alias("tj"), "v", "shingles")
    if sizes.where("tiles > 1").isEmpty():
        return [materialize(_compare_exact(whole, share, of), "links")]
    large = materialize(sets.where("tiles > 1"), "sets")
    tiled = large.withColumn("comp", F.col("root")).withColumn("ti", _tile_of("v", "tile")).withColumn("tj", F.col("ti"))
    inside = materialize(_compare_exact(whole.unionByName(tiled.select("comp", "ti", "tj", "v", "shingles")), share, of), "links")

    # The central sets go to every tile of their component.
    few = Window.partitionBy("root").orderBy(F.xxhash64("v", F.lit("central")))
    central = inside.where("a = b").select(F.col("a").alias("v")).distinct().join(large.select("root", "v"), "v")
    central = central.withColumn("k", F.row_number().over(few)).where(F.col("k") <= CENTRAL).select("root", "v")
    spread = large.join(central, ["root", "v"], "left_semi").select("root", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("ti"), "v", "shingles")
    beside = tiled.select("root", "ti", "v", "shingles").unionByName(spread)
    beside = beside.select(F.col("root").alias("comp"), "ti", F.col("ti").alias("tj"), "v", "shingles")
    outward = materialize(_compare_exact(beside, share, of), "links")

    parts = connected_components(inside.unionByName(outward))
    of_part = large.select("root", "v", "n").join(parts.withColumnRenamed("root", "part"), "v", "left").withColumn("part", F.coalesce("part", "v"))
    of_part = materialize(of_part, "parts")
    sized = of_part.groupBy("root", "part").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    # A large part has tiles of its own; small ones share tiles.
    own = (F.col("sets") >= TILE // 2) | (F.col("shingles") >= TILE_SHINGLES // 2)
    sized = sized.withColumn("own", F.when(own, F.col("part")))
    shared = sized.groupBy("root", "own").agg(F.sum("sets").alias("sets"), F.sum("shingles").alias("shingles")).withColumn("tiles", _tile_count("sets", "shingles"))
    by_root = Window.partitionBy("root")
    running = by_root.orderBy(F.col("own").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = shared.withColumn("first", F.sum("tiles").over(running).cast("int") - F.col("tiles")).withColumn("last", F.sum("tiles").over(by_root).cast("int") - 1)
    apart = materialize(placed.where((F.col("last") >= F.col("tiles")) | F.col("own").isNull()).select("root", "own", "tiles", "first", "last"), "places")
    if apart.isEmpty():
        discard(large, of_part, apart)
        return [inside, outward]
    where = of_part.join(sized.select("root", "part", "own"), ["root", "part"]).select("root", "v", "own")
    where = where.join(apart, (where.root == apart.root) & where.own.eqNullSafe(apart.own)).select("v", where.own, "tiles", "first", "last")
    where = where.select("v", "own", "first", "last", "tiles", (F.col("first") + _tile_of("v", "part")).alias("at"))
    others = F.filter(F.sequence(F.lit(0), F.col("last")), lambda k: F.col("own").isNull() | (k < F.col("first")) | (k >= F.col("first") + F.col("tiles")))
    met = large.select("root", "v", "shingles").join(where, "v").withColumn("other", F.explode(others))
    pairs = met.select(F.col("root").alias("comp"), F.least("at", "other").alias("ti"), F.greatest("at", "other").alias("tj"), "v", "shingles")
    across = materialize(_compare_exact(pairs, share, of), "links")
    discard(large, of_part, apart)
    return [inside, outward, across]


def candidate_edges(classes: DataFrame, threshold: float, recall: float) -> list[DataFrame]:
    """Written tables of links ``(a, b)`` whose components cover every pair at or over the threshold.

    ``classes`` has ``v``, ``tokens`` and ``low``, one row for each distinct set.
    """
    spread = math.sqrt(threshold * (1 - threshold) / TOKENS)
    least = threshold - 6 * spread
    rows = _branch(classes.select("v", "tokens"), True, trees_for(threshold, recall))
    tokens = classes.select("v", "tokens")
    edges: list[DataFrame] = []
    done: list[DataFrame] = []
    for level in range(LEVELS + 1):
        rows = materialize(rows, "nodes")
        sizes = materialize(rows.groupBy("node").agg(F.count("*").alias("size"), F.min("v").alias("a")).where("size > 1"), "sizes")
        small = rows.join(sizes.where(F.col("size") <= SMALL), "node").select("node", "v")
        met = _compare_small(small.join(classes.select("v", "low"), "v"), least)
        large = sizes.where(F.col("size") > SMALL)
        ended = large.isEmpty()
        if level == LEVELS and not ended:
            met = met.unionByName(rows.join(large, "node").select("a", F.col("v").alias("b")))
        edges.append(materialize(met, "met"))
        discard(*done)
        done = [rows, sizes]
        if ended or level == LEVELS:
            break
        rows = _branch(rows.join(large.select("node"), "node", "left_semi").join(tokens, "v").select("node", "v", "tokens"), False, 0)
    discard(*done)
    return edges


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, share: int = 80, of: int = 100, recall: float = 1 - 1e-8) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)`` with its near-duplicate component.

    Texts are lower-cased in A-Z and cut at ASCII white space; a text's set is
    its distinct shingles of ``width`` words, or the whole sequence where it has
    fewer.  Two texts are linked where ``of * |a & b| >= share * |a | b|``.

    Returns ``doc_id, th, n_shingles, component_id, kept``; ``th`` is
    ``xxhash64(text)`` and tells apart rows that share an id.

    * Null, empty and blank texts have no shingles, are linked with nothing and
      are kept; their component is their own id.
    * A null id counts as the largest: the component takes its smallest id that
      is not null, and is null if there is none.  ``kept`` is false for a null
      id unless the whole component has none.
    * Rows that repeat an id share their flag if their texts are in the same
      component.
    * Other columns of ``docs`` are not read.  An empty table gives no rows.
    """
    docs = keyed(docs)
    signed = materialize(_signatures(docs, width), "signatures")
    some = signed.where("n > 0")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep")
    classes = some.groupBy("d", "w").agg(rep, F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("low").alias("low"))
    classes = materialize(classes.select("d", "w", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"), "n", "tokens", "low"), "classes")
    classes = with_vertices(classes)

    candidates = candidate_edges(classes, share / of, recall)
    covering = connected_components(_union(candidates))
    roots = covering.select(F.col("root").alias("v"), "root").distinct()
    members = materialize(covering.select("v", "root").unionByName(roots).join(classes.select("v", "rep_id", "rep_th", "n"), "v"), "members")
    discard(*candidates, covering)
    sizes = members.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    sizes = materialize(sizes.select("root", _tile_count("sets", "shingles").alias("tiles")), "tiles")
    members = members.join(sizes, "root").select("v", "n", "root", "tiles", "rep_id", "rep_th")
    texts = docs.join(members, same_document("doc_id", "th", "rep_id", "rep_th")).select("v", "n", "root", "tiles", F.col("text").cast("binary").alias("text"))

    def sets(c):
        return {k: c[k] for k in ("v", "n", "root", "tiles")} | {"shingles": [shingle_set(spaced_words(t), width).tobytes() for t in c["text"]]}

    found = exact_links(map_batches(texts, sets, "v long, n long, root long, tiles int, shingles binary"), sizes, share, of)
    links = connected_components(_union(found))

    labelled = classes.select("v", "d", "w", "rep_id").join(links, "v", "left").select("d", "w", "rep_id", F.coalesce("root", "v").alias("root"))
    labelled = materialize(labelled, "labelled")
    discard(*found)
    least = materialize(labelled.groupBy("root").agg(F.min("rep_id").alias("component_id")), "least")
    of_class = materialize(labelled.join(least, "root").select("d", "w", "component_id"), "components")
    keys = [F.when(F.col("n") > 0, F.col(k)).alias(k) for k in ("d", "w")]
    joined = signed.select("doc_id", "th", F.col("n").alias("n_shingles"), *keys).join(of_class, ["d", "w"], "left")
    component = F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "th", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, share: int = 80, of: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component is kept.

    All columns of ``docs`` stay, of whatever name.  Where rows repeat both id and
    text, one stays.  Null, empty and blank texts stay; an empty table gives no rows.
    """
    key, of_id, of_th = unused(docs, "key", "of_id", "of_th")
    flags = near_duplicates(docs, width, share, of).where("kept")
    flags = materialize(flags.groupBy("doc_id", "th").agg(F.count("*").alias("times")).select(F.col("doc_id").alias(of_id), F.col("th").alias(of_th), "times"), "kept")
    marked = docs.withColumn(key, F.xxhash64("text"))
    kept = marked.join(flags.select(of_id, of_th), same_document("doc_id", key, of_id, of_th), "left_semi")
    if not flags.where("times > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", key])
    return kept.drop(key)
