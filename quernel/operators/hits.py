"""What happens to search hits: parents, boost, section scan, dedupe, cut, display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions import fixed
from quernel.functions.text import file_stem, is_procedural, procedural_markers, relevance_percent, snippet
from quernel.sources.scratch import held


def with_parent_text(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """``text`` from the parent block, or the hit's own ``snippet`` if there is none."""
    held = parents.select("parent_ref", F.col("text").alias("parent_text"))
    joined = hits.join(held, "parent_ref", "left")
    return joined.withColumn("text", F.coalesce(F.nullif("parent_text", F.lit("")), "snippet")).drop("parent_text")


def boost_procedural(hits: DataFrame, question: str = "question", asked: str = fixed.PROCEDURAL_QUESTION, told: str = fixed.PROCEDURAL_TEXT) -> DataFrame:
    """Raises the score of texts about procedures where the question asks for one."""
    n = F.least(procedural_markers(F.col("text"), told), F.lit(5))
    return hits.withColumn("score", F.when(is_procedural(F.col(question), asked), F.col("score") * (1 + n * 0.15)).otherwise(F.col("score")))


def top_sources(hits: DataFrame, n: int = 3) -> DataFrame:
    """``question_id, source_file, source_no``: the first distinct sources in hit order (``position``)."""
    first = hits.where("source_file <> ''").groupBy("question_id", "source_file").agg(F.min("position").alias("at"))
    return first.select("question_id", "source_file", F.row_number().over(Window.partitionBy("question_id").orderBy("at", "source_file")).alias("source_no")).where(F.col("source_no") <= n)


def best_sections(chunks: DataFrame, sources: DataFrame, most: int = 400, told: str = fixed.PROCEDURAL_TEXT) -> DataFrame:
    """The chunk of each question's sources that speaks most of procedures, among a source's first ``most``.

    A source's best chunk is the same for every question, so it is found once and
    joined to the questions last.  The sources are read twice and so written once.
    Chunks that have ``markers``, counted when they were indexed, are not searched again.
    """
    sources = held(sources, "sources")
    own = chunks.where("origin = 'equipment'").join(sources.select("source_file").distinct(), "source_file", "left_semi")
    early = own.withColumn("k", F.row_number().over(Window.partitionBy("source_file").orderBy("chunk_order"))).where(F.col("k") <= most)
    marked = early.withColumn("n", F.col("markers") if "markers" in chunks.columns else procedural_markers(F.col("snippet"), told)).where("n > 0")
    best = marked.withColumn("b", F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("n"), "chunk_order"))).where("b = 1")
    return best.withColumn("score", 0.02 * F.least("n", F.lit(6))).drop("k", "b", "n").join(sources, "source_file")


def combine_hits(*parts: DataFrame) -> DataFrame:
    """Bag union in the given order, kept in ``part``."""
    out = None
    for no, p in enumerate(parts):
        p = p.withColumn("part", F.lit(no))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def light_hits(hits: DataFrame, prefix: int = 300) -> DataFrame:
    """Without ``text`` and ``snippet``, which the last few hits get again; ``begin`` is a digest of how the text begins."""
    return hits.withColumn("begin", F.md5(F.substring("text", 1, prefix))).drop("text", "snippet")


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Of hits whose texts begin alike (``begin``) the best stays; ties go by part and position."""
    order = Window.partitionBy("question_id", "begin").orderBy(F.desc(F.round("score", 12)), "part", "position")
    return hits.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def final_topk(hits: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 12)), "part", "position")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def found_docs(hits: DataFrame) -> DataFrame:
    """``question_id, rank, title, snippet, relevance`` as shown beside an answer."""
    return hits.select("question_id", "rank", file_stem(F.col("source_label")).alias("title"), snippet(F.col("snippet")).alias("snippet"), relevance_percent(F.col("distance")).alias("relevance"))


def sources(hits: DataFrame) -> DataFrame:
    """``question_id, sources``: distinct source labels, sorted."""
    return hits.groupBy("question_id").agg(F.array_sort(F.collect_set("source_label")).alias("sources"))
