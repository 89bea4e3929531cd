"""Containment of article keys, against its definition, and texts that no pattern may recurse on."""

import random
import re

from pyspark.sql import functions as F

from quernel.functions.text import article_candidates
from quernel.operators import articles
from quernel.operators.articles import anchored_keys, exact_articles
from quernel.plans.queries import ARTICLE


def test_keys_are_found_by_their_rarest_gram(spark):
    rng = random.Random(4)
    keys = {"".join(rng.choices("аб12", k=rng.randrange(4, 9))) for _ in range(150)}
    catalog = spark.createDataFrame([(k, k.upper()) for k in sorted(keys)], "article_key string, canonical string")
    texts = ["".join(rng.choices("аб12 ", k=rng.choice([0, 3, 4, 20, 200]))) for _ in range(120)] + [None, "АБ-12"]
    questions = spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")
    got = sorted((r["question_id"], r["article_key"]) for r in exact_articles(questions, catalog).collect())
    plain = lambda t: re.sub("[^0-9a-zа-я]", "", (t or "").lower())
    assert got == sorted((i, k) for i, t in enumerate(texts) for k in keys if k in plain(t))
    filed = anchored_keys(catalog).collect()
    assert {r["article_key"] for r in filed} == keys and len(filed) == len(keys) and all(r["gram"] in r["article_key"] for r in filed)
    assert exact_articles(questions, catalog.limit(0)).collect() == []


def test_long_runs_of_letters(spark):
    """A million letters and digits without a gap, as in base64, recurse nowhere."""
    run = "Ab1" + "x9Q" * 350_000
    texts = spark.createDataFrame([(1, run), (2, "ВА47-63 " + "1 " * 300_000), (3, "насос ВА 47-63.2 1 и")], "n int, text string")
    for pattern in (None, ARTICLE):
        found = article_candidates(F.col("text"), pattern) if pattern else article_candidates(F.col("text"))
        got = {r["n"]: r["f"] for r in texts.select("n", F.transform(found, F.length).alias("f")).collect()}
        assert got[1] == [len(run)]
    assert texts.where("n = 3").select(article_candidates(F.col("text")).alias("f")).first()["f"] == ["ВА 47-63.2 1"]


def test_the_likest_key_is_found_level_by_level(spark, monkeypatch):
    """As by comparing all pairs, while what has a very like key is compared with few others; pieces are never sent whole."""
    from difflib import SequenceMatcher

    rng = random.Random(11)
    keys = ["".join(rng.choices("0123456789", k=16)) for _ in range(60)] + ["".join(rng.choices("аб1", k=rng.randrange(4, 12))) for _ in range(60)]
    keys = sorted({*keys, *(k[:5] + "7" + k[6:] for k in keys[:20])})
    asked = sorted({*(k[:3] + "9" + k[3:] for k in keys), *(k[1:-1] + "8" for k in keys[::3]), *("".join(rng.choices("аб12", k=8)) for _ in range(40))})
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = {}
    for a in asked:
        near = [(-ratio(a, k), k) for k in keys if abs(len(a) - len(k)) <= 2 and ratio(a, k) > 0.86]
        if near:
            want[a] = min(near)[1]
    tables = spark.createDataFrame([(a,) for a in asked], "key string"), spark.createDataFrame([(k,) for k in keys], "article_key string")
    assert len(want) > 100 and {len(w) for w in want} > {9, 17}
    levels, alike_keys = [], articles.alike_keys
    monkeypatch.setattr(articles, "alike_keys", lambda asked, catalog, least: levels.append((least, asked.count())) or alike_keys(asked, catalog, least))
    assert {r["key"]: r["article_key"] for r in articles.likest_keys(*tables, 0.86).collect()} == want
    assert [x[0] for x in levels] == [0.95, 0.9, 0.86] and levels[0][1] == len(asked) > levels[1][1] > levels[2][1] > 0
    plan = alike_keys(*tables, 0.86)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
