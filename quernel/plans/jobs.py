"""Jobs that are made of operators: index build and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import fixed
from quernel.functions.text import is_procedural, passage_text, procedural_markers, query_text, searchable
from quernel.operators.articles import build_catalog, exact_articles, expand_query, fuzzy_articles, maximal_matches
from quernel.operators.documents import build_chunks, dedupe_files, new_sources
from quernel.operators.hits import best_sections, boost_procedural, combine_hits, dedupe_hits, final_topk, light_hits, top_sources, with_parent_text
from quernel.operators.lexical_index import LexicalIndex
from quernel.operators.search import bm25_topk, corpus_stats, embed, hash_encoder, rrf_fuse, vector_topk
from quernel.sources.parents import ParentStore
from quernel.sources.scratch import held
from quernel.sources.store import ChunkStore
from quernel.sources.tables import pdf_layer_text
from quernel.sources.vectors import VectorStore


def build_index(sources: DataFrame, existing: DataFrame, origin: str = "equipment", make_encoder=hash_encoder, vectors: VectorStore | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(chunks, parents, report, errors)`` of sources that are neither copies of one another nor indexed.

    ``sources(content_hash, file_name, source_label, suffix, text)``; the text of a
    PDF is its raw text layer.  ``errors`` has ``source_label`` and ``reason`` of
    files that give no chunk.  Where a store of ``vectors`` is given, only passages
    that it does not have are embedded, and chunks have ``kept``.
    """
    unique = dedupe_files(sources, "source_label").select("content_hash", F.col("kept").alias("source_label"), "copies")
    fresh = new_sources(sources.join(unique, ["content_hash", "source_label"], "left_semi"), existing)
    read = pdf_layer_text(fresh)
    usable = read.where(F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False)))
    rows = build_chunks(usable, origin)
    passages = rows.withColumn("passage", passage_text(F.col("doc_title"), F.col("heading_path"), F.col("text")))
    passages = passages.drop("parent_text")
    chunks = (embed(passages, "passage", make_encoder) if vectors is None else vectors.embed(held(passages, "passages"), "passage", make_encoder)).drop("passage")
    parents = rows.select("parent_ref", F.col("parent_text").alias("text")).dropDuplicates(["parent_ref"])
    known = existing.select("content_hash").distinct().withColumn("known", F.lit(1))
    marked = unique.join(known, "content_hash", "left").join(rows.groupBy("content_hash").agg(F.count("*").alias("chunks")), "content_hash", "left")
    failed = F.col("known").isNull() & F.col("chunks").isNull()
    report = marked.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("files_total"), F.count("*").alias("unique_files"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
        F.count("known").alias("already_indexed"), F.count_if(F.col("known").isNull()).alias("to_index"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("new_chunks"), F.count_if(failed).alias("failed"),
    )
    errors = marked.where(failed).select("source_label", F.lit(fixed.NO_TEXT).alias("reason"))
    return chunks, parents, report, errors


CHUNKS = (
    "chunk_id string, origin string, content_hash string, chunk_index int, chunk_count int, source_file string, source_label string, doc_title string, heading_path string, "
    "parent_ref string, text string, embedding array<float>, markers int"
)


class StoredIndex:
    """Chunks, parents and the inverted index below one folder, of which a change touches only the documents it names."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, encoder: str = "hash"):
        self.chunks_store = ChunkStore(spark, f"{folder}/chunks", CHUNKS, buckets)
        self.parents_store = ParentStore(spark, f"{folder}/parents")
        self.vectors = VectorStore(spark, f"{folder}/vectors", encoder)
        self.lexical = LexicalIndex(spark, f"{folder}/lexical")

    def chunks(self) -> DataFrame:
        return self.chunks_store.chunks()

    def parents(self) -> DataFrame:
        return self.parents_store.parents()

    def _reindex(self, touched: list[tuple]) -> None:
        corpus = self.chunks().withColumn("text", searchable(F.col("doc_title"), F.col("heading_path"), F.col("text")))
        if self.lexical.layout is None:
            self.lexical.build(corpus, self.chunks_store.buckets)
        else:
            self.lexical.update(corpus, touched)

    def add(self, sources: DataFrame, origin: str = "equipment", make_encoder=hash_encoder) -> tuple[DataFrame, DataFrame]:
        """Indexes new sources as ``build_index`` does; returns its report, with ``vectors_kept``, and errors."""
        return self.replace(None, sources, origin, make_encoder)

    def replace(self, hashes: DataFrame | None, sources: DataFrame, origin: str = "equipment", make_encoder=hash_encoder) -> tuple[DataFrame, DataFrame]:
        """Takes documents ``hashes(content_hash)`` of ``origin`` out and indexes ``sources`` in one change.

        Passages that any document ever had keep their vectors, so a changed document
        embeds what changed in it.  Markers of procedures are counted here, once for
        each chunk.  Returns the report, with ``vectors_kept``, and errors.
        """
        existing = self.chunks().where(F.col("origin") == origin).select("content_hash").distinct()
        gone = None if hashes is None else held(hashes.select(F.lit(origin).alias("origin"), "content_hash"), "gone")
        if gone is not None:
            existing = existing.join(gone, "content_hash", "left_anti")
        existing = held(existing, "known")
        chunks, parents, report, errors = build_index(sources, existing, origin, make_encoder, self.vectors)
        chunks = held(chunks.withColumn("markers", procedural_markers(F.col("text"))), "chunks")
        report = held(report.join(F.broadcast(chunks.agg(F.count_if("kept").alias("vectors_kept")))), "report")  # one row each
        errors = held(errors, "errors")
        self.parents_store.upsert(parents)
        touched = self.chunks_store.append(chunks) if gone is None else self.chunks_store.replace(gone, chunks)
        if touched:
            self._reindex(touched)
        return report, errors

    def remove(self, hashes: DataFrame) -> list[tuple]:
        """Takes documents out of the chunks and the inverted index; parents stay, as they may be shared."""
        touched = self.chunks_store.delete(hashes)
        if touched:
            self._reindex(touched)
        return touched


def search_lists(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int = 20, index: LexicalIndex | None = None) -> DataFrame:
    """The vector list (0) and the lexical list (1) of each question and collection; the latter from a stored index if there is one."""
    if index is None:
        terms, sizes = corpus_stats(chunks)
        found = bm25_topk(questions, chunks, terms, sizes, k)
    else:
        found, _ = index.topk(questions, k)
    lexical = found.select("question_id", "origin", "chunk_id", F.lit(1).alias("list_no"), "rank", F.lit(None).cast("double").alias("distance"))
    near = vector_topk(vectors, chunks, k).select("question_id", "origin", "chunk_id", F.lit(0).alias("list_no"), "rank", "distance")
    return near.unionByName(lexical)


def retrieve(questions: DataFrame, chunks: DataFrame, parents: DataFrame, registry: DataFrame, top_k: int = 5, make_encoder=hash_encoder, index: LexicalIndex | None = None) -> DataFrame:
    """The best fragments for each question: ``question_id, rank, text, snippet, source_file, source_label, origin, score, distance``.

    ``index`` is the stored inverted index of the same chunks, if there is one.
    """
    catalog = build_catalog(registry)
    exact = exact_articles(questions, catalog)
    articles = maximal_matches(exact).select("question_id", "rank", "canonical").unionByName(fuzzy_articles(questions, catalog, exact))
    asked = expand_query(questions, articles)
    queries = asked.select("question_id", query_text(F.col("expanded")).alias("q"))
    vectors = embed(queries, "q", make_encoder)
    corpus = chunks.select("chunk_id", "origin", "embedding", searchable(F.col("doc_title"), F.col("heading_path"), F.col("text")).alias("text"))
    lists = search_lists(asked.select("question_id", F.col("expanded").alias("question")), vectors, corpus, index=index)
    return finish(questions, rrf_fuse(lists), chunks, parents, top_k)


def finish(questions: DataFrame, fused: DataFrame, chunks: DataFrame, parents: DataFrame, top_k: int = 5) -> DataFrame:
    """Parents, boost, section scan, dedupe and cut for fused hits.

    Texts are read for the boost and the digest of their beginnings, then left
    behind; the last few hits of each question get them again.
    """
    known = chunks.select("chunk_id", "origin", F.col("text").alias("snippet"), "source_file", "source_label", "parent_ref", F.struct("content_hash", "chunk_index").alias("chunk_order"), *(c for c in chunks.columns if c == "markers"))
    hits = with_parent_text(fused.join(known, ["chunk_id", "origin"]), parents).join(questions, "question_id")
    boosted = boost_procedural(hits).withColumn("position", F.struct(F.when(F.col("origin") == "equipment", 0).otherwise(1).alias("o"), "position"))
    boosted = held(light_hits(boosted), "hits")  # used by both branches
    asking = boosted.where(is_procedural(F.col("question")))
    sections = best_sections(known, top_sources(asking)).withColumn("position", F.struct(F.lit(2).alias("o"), F.col("source_no").alias("position")))
    sections = light_hits(with_parent_text(sections, parents)).withColumn("distance", F.lit(None).cast("double"))
    names = ["question_id", "chunk_id", "origin", "begin", "score", "distance", "position"]
    best = final_topk(dedupe_hits(combine_hits(boosted.select(names), sections.select(names))), top_k)
    shown = with_parent_text(best.join(known, ["chunk_id", "origin"]), parents)
    return shown.select("question_id", "rank", "chunk_id", "text", "snippet", "source_file", "source_label", "origin", "score", "distance", "position")
