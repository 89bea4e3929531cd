"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_OWN_DIR: dict[str, str] = {}
_BUILT: dict[str, object] = {}  # of a worker: what tasks of one job share

#: ASCII bytes that are not 0-9, A-Z, a-z become spaces; A-Z become a-z; bytes from 0x80 stay.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read and write: ``spark.checkpoint.dir``.

    Only on a local master (tests) may that setting be absent; a temporary folder is used then.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _OWN_DIR:
        _OWN_DIR["dir"] = tempfile.mkdtemp(prefix="spark-")
    return _OWN_DIR["dir"]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a table that outlives lost executors, and gives later
    joins plain scans whose skewed partitions adaptive execution can split.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more; others are left alone."""
    for df in tables:
        path = getattr(df, "written_to", None) if df is not None else None
        if path:
            context = df.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for added columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def built_once(key: str, make: Callable[[], object]) -> object:
    """``make()``, called once in each worker process for a key; a few of the newest are kept."""
    if key not in _BUILT:
        while len(_BUILT) >= 3:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[key] = make()
    return _BUILT[key]


def new_key() -> str:
    return uuid.uuid4().hex


def plain_words(data: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, with A-Z lower-cased."""
    return data.translate(WORD_TABLE).split()


def spaced_words(data: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return data.lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def map_batches(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = 256) -> DataFrame:
    """``mapInArrow`` in slices of at most ``rows`` rows.

    ``work`` gets the columns of a slice as lists and returns columns as lists;
    it may return more or fewer rows.  Slices keep memory in a worker small even
    when every text of a batch is long.
    """
    out = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                columns = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
                made = work(columns)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, text)``: ``th`` tells apart rows which share a document id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))


def same_document(left_id: str, left_th: str, right_id: str, right_th: str) -> Column:
    return F.col(left_id).eqNullSafe(F.col(right_id)) & (F.col(left_th) == F.col(right_th))


class Forest:
    """Union-find over ``0..n-1`` for one small group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """True if ``x`` and ``y`` were apart."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def connected_components(edges: DataFrame) -> DataFrame:
    """Labels of the components of ``edges(a long, b long)``.

    Returns ``(v, root)`` for every vertex that is not its own root.  Vertex
    numbers should be hashes, so that hooking each vertex to its smallest
    neighbour leaves short chains.  Each round hooks, flattens the chains by
    pointer jumping and contracts the edges; the number of edges falls
    geometrically.  Nothing is collected; every step is a written table.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    labels: DataFrame | None = None
    while not edges.isEmpty():
        parents = materialize(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("root")), "parents")
        while True:
            above = parents.select(F.col("v").alias("u"), F.col("root").alias("up"))
            joined = parents.join(above, parents.root == above.u, "left")
            if joined.where("up is not null").isEmpty():
                break
            flatter = materialize(joined.select("v", F.coalesce("up", "root").alias("root")), "parents")
            discard(parents)
            parents = flatter
        of_a = parents.select(F.col("v").alias("a"), F.col("root").alias("ra"))
        of_b = parents.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        both = edges.join(of_a, "a", "left").join(of_b, "b", "left")
        both = both.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
        both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fewer = materialize(both, "edges")
        discard(edges)
        edges = fewer
        if labels is None:
            labels = parents
        else:
            newer = parents.select(F.col("v").alias("u"), F.col("root").alias("up"))
            moved = labels.join(newer, labels.root == newer.u, "left").select("v", F.coalesce("up", "root").alias("root"))
            longer = materialize(moved.unionByName(parents), "labels")
            discard(labels, parents)
            labels = longer
    if labels is None:
        labels = edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return labels
