"""The chunk store and the stored inverted index, with changes that break off at every step."""

import random
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.functions.text import procedural_markers, tokenize
from quernel.operators import search
from quernel.operators.hits import best_sections
from quernel.operators.lexical_index import LexicalIndex
from quernel.plans import jobs
from quernel.sources import keyed
from quernel.sources.parents import ParentStore
from quernel.sources.store import ChunkStore
from quernel.sources.vectors import VectorStore

SCHEMA = "origin string, content_hash string, chunk_id string, chunk_index int, text string"


def rows(origin, *hashes, n=3):
    return [(origin, h, f"{h}_{k}", k, f"text {k} of {h} in {origin}") for h in hashes for k in range(n)]


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def held(store):
    return sorted(tuple(r) for r in store.chunks().collect())


@pytest.fixture
def store(spark, tmp_path):
    s = ChunkStore(spark, f"{tmp_path}/store", SCHEMA, buckets=8)
    s.append(spark.createDataFrame(rows("equipment", *(f"h{k}" for k in range(20))) + rows("user", "h1", "u1", "u2"), SCHEMA))
    return s


def test_only_touched_buckets_change(spark, store):
    before, old = files(f"{store.path}/chunks"), held(store)
    touched = store.delete(spark.createDataFrame([("h1",), ("absent",)], "content_hash string"))
    after = files(f"{store.path}/chunks")
    assert held(store) == [r for r in old if r[1] != "h1"] and 1 <= len(touched) <= 4
    of = lambda f: tuple(part.split("=")[1] for part in f.split("/")[:2])
    named = {(o, str(b)) for o, b in touched}
    assert {f for f in before if of(f) not in named} == {f for f in after if of(f) not in named}
    assert all(before[f] == after[f] for f in before if of(f) not in named)
    store.append(spark.createDataFrame(rows("user", "h1", n=1), SCHEMA))
    store.append(spark.createDataFrame(rows("user", "u2", n=2), SCHEMA))  # replaces the document
    assert held(store) == sorted([r for r in old if r[1] not in ("h1", "u2")] + rows("user", "h1", n=1) + rows("user", "u2", n=2))
    store.delete(spark.createDataFrame([("user", "u1"), ("equipment", "u2")], "origin string, content_hash string"))
    assert {r[1] for r in held(store) if r[0] == "user"} == {"h1", "u2"}


def test_everything_goes_and_comes_back(spark, store):
    old = held(store)
    everything = store.chunks().select("content_hash").distinct()
    store.delete(everything)
    assert held(store) == [] and store.delete(spark.createDataFrame([("h1",)], "content_hash string")) == []
    store.append(spark.createDataFrame(old, SCHEMA))
    assert held(store) == old and ChunkStore(spark, store.path, SCHEMA, buckets=99).buckets == 8


@pytest.mark.parametrize("step", ["before the journal", "before the overwrite", "before the end"])
def test_a_change_that_breaks_off(spark, store, monkeypatch, step):
    old = held(store)
    real_note, real_overwrite = ChunkStore._note, ChunkStore._overwrite

    def note(self, change, state, touched):
        if (step, state) in (("before the journal", "written"), ("before the end", "done")):
            raise RuntimeError(step)
        real_note(self, change, state, touched)

    def overwrite(self, change, touched):
        if step == "before the overwrite":
            raise RuntimeError(step)
        real_overwrite(self, change, touched)

    monkeypatch.setattr(ChunkStore, "_note", note)
    monkeypatch.setattr(ChunkStore, "_overwrite", overwrite)
    gone = spark.createDataFrame([("h3",), ("u1",)], "content_hash string")
    with pytest.raises(RuntimeError, match=step):
        store.delete(gone)
    monkeypatch.undo()
    again = ChunkStore(spark, store.path, SCHEMA)
    left = [r for r in old if r[1] not in ("h3", "u1")]
    assert held(again) == (old if step == "before the journal" else left)
    again.delete(gone)
    assert held(again) == left == held(ChunkStore(spark, store.path, SCHEMA))


# --- the stored inverted index


def ranked(df):
    return sorted((r["question_id"], r["origin"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in df.collect())


def by_join(questions, chunks, k):
    terms, sizes = search.corpus_stats(chunks)
    asked = questions.select("question_id", F.explode(tokenize(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("times"))
    scores = search.scores_by_join(asked, search.postings(chunks), terms, sizes)
    order = Window.partitionBy("question_id", "origin").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def documents(rng, n, words, origin, long=0):
    out = []
    for d in range(n):
        for i in range(rng.randrange(1, 4) + long):
            out.append((origin, f"{origin}{d}", f"{origin}{d:03}_{i}", i, " ".join(rng.choices(words, k=rng.choice([1, 4, 30]))) if d % 9 else None))
    return out


def test_index_finds_what_scoring_every_chunk_finds(spark, store, tmp_path):
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.9)) % 80}" for _ in range(2000)] + ["щит", "насос"] * 15
    # A few chunks full of rare words, so that most segments cannot reach the best ones.
    rows_of = documents(rng, 90, words, "equipment", long=2) + documents(rng, 4, ["a", "b"], "user") + [("equipment", f"top{k}", f"top{k}", 0, "щит щит насос насос щит") for k in range(9)]
    store = ChunkStore(spark, f"{tmp_path}/docs", SCHEMA, buckets=6)
    store.append(spark.createDataFrame(rows_of, SCHEMA))
    index = LexicalIndex(spark, f"{tmp_path}/index").build(store.chunks(), buckets=6, segment=8)
    questions = spark.createDataFrame([(1, "w1 w2 щит w1"), (2, "насос щит"), (3, "a b c"), (4, ""), (5, None), (6, "b w7 w9 absent")], "question_id long, question string")
    for k in (1, 5, 50):
        hits, report = index.topk(questions, k=k)
        assert ranked(hits) == ranked(by_join(questions, store.chunks(), k))
    shares = {(r["question_id"], r["origin"]): r for r in index.topk(questions, k=1, first=1)[1].collect()}
    assert all(r["segments_read"] <= r["segments"] and r["blocks_read"] <= r["blocks"] for r in shares.values())
    assert shares[2, "equipment"]["blocks_read"] < shares[2, "equipment"]["blocks"]

    # Documents change: only their buckets are indexed anew, and longer chunks raise the average length.
    before = files(f"{index.path}/blocks")
    long = [("equipment", f"new{k}", f"new{k}_0", 0, "щит насос " + "w1 w2 w3 " * 60) for k in range(3)] + [("user", "user1", "user1_0", 0, "a changed a")]
    touched = store.replace(spark.createDataFrame([("equipment", "equipment5"), (None, "user2")], "origin string, content_hash string"), spark.createDataFrame(long, SCHEMA))
    index = LexicalIndex(spark, index.path)
    index.update(store.chunks(), touched)
    after = files(f"{index.path}/blocks")
    named = {f"origin={o}/bucket={b}/" for o, b in touched}
    kept = {f for f in before if not f.startswith(tuple(named))}
    assert kept and all(before[f] == after.get(f) for f in kept) and len(named) < 12
    for k in (2, 20):
        assert ranked(index.topk(questions, k=k)[0]) == ranked(by_join(questions, store.chunks(), k))


# --- parents and the whole index


def test_parents_are_ignored_where_known(spark, tmp_path):
    store = ParentStore(spark, f"{tmp_path}/parents", buckets=16)
    schema = "parent_ref string, text string"
    block = lambda *ks: spark.createDataFrame([(f"r{k}", f"text {k}") for k in ks], schema)
    assert store.upsert(block(*range(300), *range(20))) == []
    assert store.upsert(block(*range(300, 400))) == []  # no filter says that one of them may be there
    read = store.upsert(block(7, 7, 8, *range(400, 420)).unionByName(spark.createDataFrame([(None, "x")], schema)))
    assert 1 <= len(read) <= 3
    got = sorted(tuple(r) for r in store.parents().collect())
    assert got == sorted((f"r{k}", f"text {k}") for k in range(420))
    assert store.upsert(block()) == [] and store.doubtful_buckets(block(1).select("parent_ref")) == store.doubtful_buckets(block(1, 1).select("parent_ref"))


def test_stored_index_adds_and_removes(spark, tmp_path):
    sources = "content_hash string, file_name string, source_label string, suffix string, text string"
    long = "# Насос\n" + "Техническое обслуживание насоса, перечень работ, осмотр узла. " * 4
    index = jobs.StoredIndex(spark, f"{tmp_path}/index", buckets=2)
    report, errors = index.add(spark.createDataFrame([("h1", "Насос.pdf", "d/Насос.pdf", ".pdf", long), ("h2", "t.csv", "t.csv", ".csv", "щит ВА47-63\n\nлампа"), ("h3", "e.pdf", "e.pdf", ".pdf", " ")], sources))
    assert report.first()["new_chunks"] == 3 and [r["source_label"] for r in errors.collect()] == ["e.pdf"]
    index = jobs.StoredIndex(spark, f"{tmp_path}/index")
    assert index.add(spark.createDataFrame([("h1", "x.pdf", "x.pdf", ".pdf", long), ("h4", "u.csv", "u.csv", ".csv", "щит учёта")], sources))[0].first()["already_indexed"] == 1
    reg = spark.createDataFrame([(1, "щит", "BA47-63")], "row_id long, name string, model string")
    questions = spark.createDataFrame([(1, "Как обслуживать насос"), (2, "щит ВА 47 63")], "question_id long, question string")
    found = lambda **kw: sorted(tuple(r) for r in jobs.retrieve(questions, index.chunks(), index.parents(), reg, **kw).select("question_id", "rank", "chunk_id", F.round("score", 9)).collect())
    both = found(index=index.lexical)
    assert {r[2] for r in both} >= {"h1_0", "h2_0"}
    parents = index.parents().count()
    assert index.remove(spark.createDataFrame([("h2",)], "content_hash string")) != []
    left = found(index=index.lexical)
    assert {r[2] for r in left} == {r[2] for r in both} - {"h2_0", "h2_1"} and index.parents().count() == parents


def encoder_without(*refused):
    """The default encoder, which fails on texts that hold one of ``refused``."""

    def make():
        encode = search.hash_encoder()

        def checked(texts):
            if bad := [t for t in texts if any(word in t for word in refused)]:
                raise ValueError(f"embedded again: {bad[0]}")
            return encode(texts)

        return checked

    return make


def test_filters_in_several_passes(spark, tmp_path, monkeypatch):
    kept = keyed.KeyedStore(spark, f"{tmp_path}/keys", "rows", "k", "v int", buckets=5)
    rows = lambda a, b: spark.createDataFrame([(f"key {i}", i) for i in range(a, b)], "k string, v int")
    assert kept.doubtful_buckets(rows(0, 40)) == []  # nothing is stored
    assert kept.upsert(rows(0, 40)) == []
    monkeypatch.setattr(keyed, "FILTERS_AT_ONCE", 2)
    assert kept.doubtful_buckets(rows(0, 40)) == [0, 1, 2, 3, 4]
    assert kept.doubtful_buckets(rows(0, 0)) == []
    kept.upsert(rows(30, 50))
    assert sorted(r["v"] for r in kept.rows().collect()) == list(range(50))


def test_vectors_are_kept_by_content(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/vectors", buckets=8)
    schema = "id long, t string, kept string"
    first = spark.createDataFrame([(1, "насос один", "x"), (2, "щит", "x"), (3, "насос один", "x"), (4, None, "x"), (5, "", "x")], schema)
    direct = lambda df: {r["id"]: list(r["embedding"]) for r in search.embed(df, "t").collect()}
    got = store.embed(first, "t")
    assert got.columns == ["id", "t", "embedding", "kept"] and {r["id"]: list(r["embedding"]) for r in got.collect()} == direct(first)
    assert got.where("kept").isEmpty() and store.rows().count() == 3  # equal passages once, null as empty
    second = spark.createDataFrame([(6, "щит", "x"), (7, "лампа", "x"), (8, "насос один", "x"), (9, None, "x"), (10, "лампа", "x")], schema)
    got = store.embed(second, "t", encoder_without("щит", "насос")).collect()
    assert {r["id"]: list(r["embedding"]) for r in got} == direct(second) and {r["id"] for r in got if r["kept"]} == {6, 8, 9}
    assert store.embed(second.limit(0), "t").isEmpty() and store.rows().count() == 4
    other = VectorStore(spark, f"{tmp_path}/vectors", encoder="another", buckets=8)
    assert other.embed(first, "t").where("kept").isEmpty()  # another model's vectors are not used
    assert store.embed(first, "t", encoder_without("")).where("not kept").isEmpty()


def test_vectors_after_a_change_that_broke_off(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/vectors", buckets=4)
    df = spark.createDataFrame([(k, f"passage {k % 7}") for k in range(20)], "id long, t string")
    table, store.table = store.table, "nowhere://vectors"
    with pytest.raises(Exception):
        store.embed(df, "t")  # the filters are written, the vectors are not
    store.table = table
    assert store.embed(df, "t").where("kept").isEmpty() and store.rows().count() == 7
    assert store.embed(df, "t").where("not kept").isEmpty() and store.rows().count() == 7


def test_a_changed_document_embeds_what_changed(spark, tmp_path):
    sources = "content_hash string, file_name string, source_label string, suffix string, text string"
    index = jobs.StoredIndex(spark, f"{tmp_path}/index", buckets=2)
    of = lambda *rows: spark.createDataFrame([(h, "t.csv", f"{h}.csv", ".csv", "\n\n".join(cells)) for h, *cells in rows], sources)
    assert index.add(of(("h1", "щит учёта", "лампа", "насос"), ("h2", "щит учёта", "кабель")))[0].first()["vectors_kept"] == 0
    hashes = spark.createDataFrame([("h1",), ("h2",)], "content_hash string")
    # One document has changed; the other is taken out and comes back in the same change.
    changed = of(("h1b", "щит учёта", "лампа новая", "насос"), ("h2", "щит учёта", "кабель"))
    report, errors = index.replace(hashes, changed, make_encoder=encoder_without("щит", "насос", "кабель"))
    assert (report.first()["vectors_kept"], report.first()["new_chunks"], errors.count()) == (4, 5, 0)
    stored = {(r["content_hash"], r["text"]): list(r["embedding"]) for r in index.chunks().collect()}
    assert set(stored) == {("h1b", "щит учёта"), ("h1b", "лампа новая"), ("h1b", "насос"), ("h2", "щит учёта"), ("h2", "кабель")}
    # The passage holds the document's title, which is the same in both.
    assert stored["h1b", "щит учёта"] == stored["h2", "щит учёта"]
    asked = spark.createDataFrame([(1, "лампа новая")], "question_id long, question string")
    assert index.lexical.topk(asked, k=1)[0].first()["chunk_id"] == "h1b_1"


def test_counted_markers_stand_for_texts(spark):
    rows = [("equipment", f"c{k}", f"s{k % 2}", k, "порядок проведения работ " * (k % 4)) for k in range(12)]
    chunks = spark.createDataFrame(rows, "origin string, chunk_id string, source_file string, chunk_order int, snippet string")
    asked = spark.createDataFrame([(1, "s0", 1), (1, "s1", 2)], "question_id long, source_file string, source_no int")
    best = lambda df: sorted((r["source_file"], r["chunk_id"], r["score"]) for r in best_sections(df, asked).collect())
    assert best(chunks) == best(chunks.withColumn("markers", procedural_markers(F.col("snippet")))) != []
