"""The stored inverted index shuffles little, and finds the same in several scans and sums."""

import random

from pyspark.sql import functions as F

from quernel.operators import lexical_index
from quernel.operators.lexical_index import LexicalIndex


def chunks_of(spark, rng, n):
    words = [f"w{int(rng.paretovariate(0.8)) % 400}" for _ in range(4000)]
    rows = [(rng.choice(["equipment", "user"]), f"h{d}", 0, f"h{d}_0", " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60])))) for d in range(n)]
    return spark.createDataFrame(rows, "origin string, content_hash string, chunk_index int, chunk_id string, text string")


def test_scans_and_sums_of_any_size_find_the_same(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    index = LexicalIndex(spark, f"{tmp_path}/index").build(chunks_of(spark, rng, 150), buckets=2, segment=16)
    questions = spark.createDataFrame([(f"q{k}", " ".join(f"w{rng.randrange(60)}" for _ in range(6))) for k in range(8)], "question_id string, question string")
    found = lambda: sorted(tuple(r) for r in index.topk(questions, k=3)[0].withColumn("score", F.round("score", 8)).collect())
    one = found()
    monkeypatch.setattr(lexical_index, "SCAN_QUESTIONS", 9)
    monkeypatch.setattr(lexical_index, "PARTS", 7)
    assert len(one) == 48 and found() == one


def test_a_search_shuffles_packed_postings(spark, tmp_path):
    """Neither blocks of a posting or two nor scores of every chunk are dealt out, one row each."""
    index = LexicalIndex(spark, f"{tmp_path}/index").build(chunks_of(spark, random.Random(8), 60), buckets=2, segment=16)
    questions = spark.createDataFrame([(1, "w1 w2 w3")], "question_id long, question string")
    plan = index.topk(questions, k=3)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "collect_list(words" in plan
    blocks = index.blocks().select("term", F.size("postings").alias("size"), "n", F.expr("postings.place = array_sort(postings.place)").alias("sorted")).collect()
    assert blocks and all(b["size"] == b["n"] > 0 and b["sorted"] and b["term"] for b in blocks)


def test_blocks_are_not_shuffled_for_bounds(spark, tmp_path):
    """What is asked goes to the blocks, whatever the planner may send by itself."""
    index = LexicalIndex(spark, f"{tmp_path}/index").build(chunks_of(spark, random.Random(9), 60), buckets=2, segment=16)
    wanted = index._wanted(spark.createDataFrame([(1, "w1 w2 w3")], "question_id long, question string"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.bounds(wanted)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
