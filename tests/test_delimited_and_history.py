"""Delimited files over byte ranges, and history as stream state."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from quernel.operators.dialogue import retain_turns
from quernel.sources.delimited import read_records
from quernel.streaming.history import history_stream, read_history


def written(rng, n, width):
    cell = lambda: "".join(rng.choices(["a", "щ", ",", '"', "\n", "\r\n", " ", "long text "], k=rng.choice([0, 1, 3, 12])))
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerows([[cell() for _ in range(rng.randrange(1, width))] for _ in range(n)])
    return out.getvalue()


@pytest.mark.parametrize("bytes_at_once", [150, 1000, 10_000_000])
def test_records_over_byte_ranges(spark, tmp_path, bytes_at_once):
    rng = random.Random(bytes_at_once)
    texts = {"a.csv": "﻿" + written(rng, 50, 4), "b.csv": written(rng, 15, 7), "c.csv": "", "d.csv": 'h\n"x\ny', "e.csv": "one\n\n\ntwo", "f.csv": '"' + "\n" * 300 + '",z\nlast,' + "x" * (200_000 if bytes_at_once > 1000 else 900)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    conf = {"spark.sql.files.maxPartitionBytes": str(bytes_at_once), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = {}
        for r in read_records(spark, str(tmp_path)).collect():
            got.setdefault(r["file_id"].rsplit("/", 1)[1], []).append((r["row_idx"], r["cells"]))
    finally:
        for k in conf:
            spark.conf.unset(k)
    csv.field_size_limit(10**9)
    for name, text in texts.items():
        expected = list(csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")))
        assert [c for _, c in sorted(got.get(name, []))] == expected, name
        assert sorted(i for i, _ in got.get(name, [])) == list(range(len(expected)))


@pytest.mark.parametrize("seed", [1, 2])
def test_history_in_any_order_of_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    schema = "conv_id long, turn_id long, question string, answer string, created_at timestamp"
    turns = [(c, t, f"q{t}", "о" * rng.randrange(60) if t % 5 else None, None) for c in range(4) for t in range(rng.choice([3, 40]))] + [(None, 1, "q", "a", None)]
    table = spark.createDataFrame(turns, schema).withColumn("created_at", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, turn_id)"))
    rows = table.collect()
    rng.shuffle(rows)
    arriving, cp = tmp_path / "turns", f"{tmp_path}/cp"
    for k in range(3):
        spark.createDataFrame(rows[k::3], table.schema).coalesce(1).write.mode("append").parquet(str(arriving))
        stream = spark.readStream.schema(table.schema).parquet(str(arriving))
        history_stream(stream, f"{tmp_path}/history", cp, once=True, max_turns=10, max_answer_chars=50).awaitTermination()
    plain = lambda df: sorted((tuple(r) for r in df.select(*table.columns).collect()), key=str)
    assert plain(read_history(spark, f"{tmp_path}/history")) == plain(retain_turns(table.where("conv_id is not null"), 10, 50))
