"""What needs files: discovery, sinks, the index job, retrieval and the stream."""

import pytest
from pyspark.sql import functions as F

from quernel.plans import jobs
from quernel.sources import sinks, tables
from quernel.streaming import ingest
from quernel.streaming.ingest import check_uploads, ingest_stream


def test_scan_leaves_out_folders_and_other_kinds(spark, tmp_path):
    for name in ("a.csv", "sub/b.PDF", "sub/c.txt", "chroma/d.csv", "sub/user_uploads/e.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"same")
    out = tables.scan_files(spark, f"file:{tmp_path}")
    assert sorted(r["source_label"] for r in out.collect()) == ["a.csv", "sub/b.PDF"]
    assert out.select("content_hash").distinct().count() == 1


def test_excluded_files_are_never_opened(spark, tmp_path):
    for name in ("a.csv", "s[1]{x}*/b.Csv", "chroma/long.csv", "s/long.txt", "s/k/user_uploads/long.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * (50_000 if "long" in name else 10))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        got = {r["source_label"]: r for r in tables.scan_files(spark, f"file:{tmp_path}/").collect()}
        assert set(got) == {"a.csv", "s[1]{x}*/b.Csv"} and all(bytes(r["content"]) == b"x" * 10 and r["length"] == 10 for r in got.values())
        assert tables.scan_files(spark, f"file:{tmp_path}/s").collect() == []
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


SOURCES = "content_hash string, file_name string, source_label string, suffix string, text string"


def test_index_and_retrieval(spark, tmp_path):
    rows = [
        ("h1", "Насос.pdf", "d/Насос.pdf", ".pdf", "# Насос\n" + "Техническое обслуживание насоса, перечень работ, осмотр узла. " * 4), ("h1", "Насос копия.pdf", "d/Насос копия.pdf", ".pdf", "x"),
        ("h2", "t.csv", "t.csv", ".csv", "щит ВА47-63\n\nлампа"), ("h3", "empty.pdf", "empty.pdf", ".pdf", "  \n"), ("h4", "old.pdf", "old.pdf", ".pdf", "old"),
    ]
    existing = spark.createDataFrame([("h4",)], "content_hash string")
    chunks, parents, report, errors = jobs.build_index(spark.createDataFrame(rows, SOURCES), existing)
    assert report.first().asDict() == {"files_total": 5, "unique_files": 4, "duplicates": 1, "already_indexed": 1, "to_index": 3, "new_chunks": 3, "failed": 1}
    assert [tuple(r) for r in errors.collect()] == [("empty.pdf", "пустой текст после парсинга")]
    sinks.write_chunks(chunks, f"{tmp_path}/chunks")
    sinks.write_chunks(chunks.withColumn("origin", F.lit("user")).where("content_hash = 'h2'"), f"{tmp_path}/chunks")
    stored = sinks.read_collections(spark, f"{tmp_path}/chunks")
    assert {(r["origin"], r["count"]) for r in stored.groupBy("origin").count().collect()} == {("equipment", 3), ("user", 2)}
    sinks.upsert_parents(parents.limit(0), parents, f"{tmp_path}/parents")
    held = spark.read.parquet(f"{tmp_path}/parents")
    assert sinks.new_parents(held, parents).count() == 0
    reg = spark.createDataFrame([(1, "щит", "BA47-63")], "row_id long, name string, model string")
    questions = spark.createDataFrame([(1, "Как обслуживать насос"), (2, "щит ВА 47 63")], "question_id long, question string")
    got = jobs.retrieve(questions, stored, held, reg).orderBy("question_id", "rank").collect()
    first = {r["question_id"]: r for r in reversed(got)}
    assert first[1]["source_file"] == "Насос.pdf" and first[2]["snippet"].startswith("щит")
    assert len({(r["question_id"], r["text"][:300]) for r in got}) == len(got)


def test_upload_guard(spark):
    rows = [("/x/a.exe", 1), ("/x/b.pdf", 300 * 1024 * 1024), ("/x/c.PDF", 5)]
    got = [r["rejected"] for r in check_uploads(spark.createDataFrame(rows, "path string, length long")).orderBy("path").collect()]
    assert got[0].startswith("Неподдерживаемый") and got[1] == "Файл больше 200 МБ" and got[2] is None


def test_pdf_layers_are_cleaned(spark):
    long = "слово " * 40
    rows = [(1, ".pdf", f"/uni0421{long}\nВведение ........ 5"), (2, ".pdf", "коротко"), (3, ".csv", "коротко")]
    got = {r["n"]: r["text"] for r in tables.pdf_layer_text(spark.createDataFrame(rows, "n int, suffix string, text string")).collect()}
    assert got == {1: f"С{long}", 2: "", 3: "коротко"}


def statuses(spark, index):
    return {r["path"].rsplit("/", 1)[1]: (r["status"], r["chunks"], r["error"]) for r in spark.read.parquet(f"{index}/status").collect()}


def test_stream_indexes_once(spark, tmp_path):
    arriving, index = tmp_path / "in", f"{tmp_path}/index"
    arriving.mkdir()
    run = lambda: ingest_stream(spark, f"file:{arriving}", index, f"{tmp_path}/cp", once=True).awaitTermination()
    (arriving / "a.csv").write_text('\ufeffимя,число\n"щит\nА",2\n,\nлампа,\n')
    (arriving / "b.csv").write_text("имя\n")
    (arriving / "d.pdf").write_bytes(b"%PDF-1.4 \xff\xfe")
    run()
    (arriving / "copy.csv").write_bytes((arriving / "a.csv").read_bytes())
    (arriving / "c.exe").write_text("x")
    run()
    run()
    assert statuses(spark, index) == {
        "a.csv": ("done", 2, None), "b.csv": ("error", 0, "пустой текст после парсинга"), "d.pdf": ("error", 0, "нет чтения формата .pdf"),
        "copy.csv": ("error", 0, "Этот документ уже добавлен — «a.csv»"), "c.exe": ("error", 0, "Неподдерживаемый формат: .exe"),
    }
    chunks = spark.read.parquet(f"{index}/chunks").orderBy("chunk_index").collect()
    assert [c["text"] for c in chunks] == ["имя: щит\nА, число: 2", "имя: лампа"] and all(abs(sum(x * x for x in c["embedding"]) - 1) < 1e-5 for c in chunks)


def test_oversize_files_get_a_status_unopened(spark, tmp_path):
    arriving, index = tmp_path / "in", f"{tmp_path}/index"
    arriving.mkdir()
    (arriving / "long.csv").write_text("k\n" + "x" * 5000)
    (arriving / "long.exe").write_text("x" * 5000)
    (arriving / "a.CSV").write_text("k\nодин")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        for _ in range(2):
            ingest_stream(spark, f"file:{arriving}", index, f"{tmp_path}/cp", once=True, files_at_once=1).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert statuses(spark, index) == {"a.CSV": ("done", 1, None), "long.csv": ("error", 0, "Файл больше 0 МБ"), "long.exe": ("error", 0, "Неподдерживаемый формат: .exe")}


def test_a_batch_that_broke_off_is_written_anew(spark, tmp_path, monkeypatch):
    """The status is lost after the chunks were written; the restarted stream ends as an unbroken one."""
    arriving, index = tmp_path / "in", f"{tmp_path}/index"
    arriving.mkdir()
    start = lambda: ingest_stream(spark, f"file:{arriving}", index, f"{tmp_path}/cp", once=True)
    (arriving / "o.csv").write_text("k\nold")
    start().awaitTermination()
    for name in ("a.csv", "b.csv"):
        (arriving / name).write_text("k\nодин\nдва")
    (arriving / "o2.csv").write_text("k\nold")
    real = ingest.fill
    monkeypatch.setattr(ingest, "fill", lambda pattern, *a: real(pattern, F.raise_error(F.lit("broken"))) if pattern == ingest.fixed.KNOWN_AS else real(pattern, *a))
    with pytest.raises(Exception, match="broken"):
        start().awaitTermination()
    assert spark.read.parquet(f"{index}/chunks").where("batch_id = 1").count() == 2
    assert set(statuses(spark, index)) == {"o.csv"}
    monkeypatch.undo()
    for _ in range(2):
        start().awaitTermination()
    assert statuses(spark, index) == {"o.csv": ("done", 1, None), "a.csv": ("done", 2, None), "b.csv": ("error", 0, "Этот документ уже добавлен"), "o2.csv": ("error", 0, "Этот документ уже добавлен — «o.csv»")}
    assert spark.read.parquet(f"{index}/chunks").count() == 3 and ingest.read_parents(spark, index).count() == 3


def test_a_batch_does_not_read_the_index(spark, tmp_path):
    """With the chunks and parents of earlier batches gone, what they held is still known."""
    arriving, index = tmp_path / "in", tmp_path / "index"
    arriving.mkdir()
    start = lambda: ingest_stream(spark, f"file:{arriving}", str(index), f"{tmp_path}/cp", once=True).awaitTermination()
    (arriving / "a.csv").write_text("k\nодин")
    start()
    for name in ("chunks", "parents"):
        (index / name).rename(tmp_path / f"moved-{name}")
    (arriving / "b.csv").write_text("k\nодин")
    (arriving / "c.csv").write_text("k\nдва")
    start()
    assert statuses(spark, str(index)) == {"a.csv": ("done", 1, None), "b.csv": ("error", 0, "Этот документ уже добавлен — «a.csv»"), "c.csv": ("done", 1, None)}
