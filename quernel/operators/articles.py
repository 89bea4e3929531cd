"""Article numbers: catalogue, exact and typo-tolerant matching, query expansion."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions import fixed
from quernel.functions.text import article_candidates, normalize_article
from quernel.sources.scratch import held
from quernel.sources.tables import spread

LEVELS = (0.95, 0.9)  # ratios above which keys are looked for first


def build_catalog(registry: DataFrame, pattern: str = "(?U)" + fixed.ARTICLE) -> DataFrame:
    """``article_key, canonical``: for each key the spelling with fewest spaces, then the shortest, then the first met."""
    fields = F.array(F.struct(F.lit(0).alias("field"), F.col("model").alias("text")), F.struct(F.lit(1).alias("field"), F.col("name").alias("text")))
    rows = registry.select("row_id", F.explode(fields).alias("f")).select("row_id", "f.field", F.posexplode(article_candidates(F.col("f.text"), pattern)).alias("pos", "raw"))
    spaces = F.length("raw") - F.length(F.replace("raw", F.lit(" ")))
    order = F.struct(spaces.alias("spaces"), F.length("raw").alias("n"), "row_id", "field", "pos")
    return rows.groupBy(normalize_article(F.col("raw")).alias("article_key")).agg(F.min_by("raw", order).alias("canonical"))


def _grams(c: Column, size: int = fixed.MIN_ARTICLE) -> Column:
    """Distinct stretches of ``size`` characters; none of a shorter text."""
    starts = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - size + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(size))))


def anchored_keys(catalog: DataFrame) -> DataFrame:
    """``gram, article_key, canonical``: every key under that of its grams which fewest keys have."""
    grams = catalog.select("article_key", "canonical", F.explode(_grams(F.col("article_key"))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = F.min_by("gram", F.struct("n", "gram")).alias("gram")
    return grams.join(often.hint("merge"), "gram").groupBy("article_key", "canonical").agg(rarest).select("gram", "article_key", "canonical")


def exact_articles(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """``question_id, article_key, canonical``: catalogue keys contained in the normalised question.

    Keys have ``MIN_ARTICLE`` letters at least.  A key is filed under its rarest gram,
    so that a question gives one row a letter at most, meets few keys and checks these.
    """
    text = questions.select("question_id", normalize_article(F.coalesce("question", F.lit(""))).alias("t"))
    probes = text.select("question_id", F.explode(_grams(F.col("t"))).alias("gram"))
    met = probes.join(anchored_keys(catalog).hint("merge"), "gram").drop("gram")
    return met.join(text, "question_id").where(F.contains("t", "article_key")).select("question_id", "article_key", "canonical").distinct()


def maximal_matches(found: DataFrame) -> DataFrame:
    """Without keys that another key of the same question contains; longest first in ``rank``."""
    keys = found.groupBy("question_id").agg(F.collect_list(F.struct("article_key", "canonical")).alias("all"))
    kept = F.filter("all", lambda k: ~F.exists("all", lambda o: (o["article_key"] != k["article_key"]) & F.contains(o["article_key"], k["article_key"])))
    order = F.array_sort(F.transform(kept, lambda k: F.struct((-F.length(k["article_key"])).alias("n"), k["article_key"].alias("article_key"), k["canonical"].alias("canonical"))))
    return keys.select("question_id", F.posexplode(order).alias("pos", "k")).select("question_id", (F.col("pos") + 1).alias("rank"), "k.article_key", "k.canonical")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all, by longest matching blocks."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def alike_keys(asked: DataFrame, catalog: DataFrame, least: float, apart: int = 2) -> DataFrame:
    """``key, article_key``: every pair that can have a ratio above ``least``, and some that cannot.

    Keys of n and m letters above the ratio leave fewer than ``(1 - least) * (n + m)``
    letters unmatched.  A catalogue key is cut into one piece more than that, so that
    one piece stands whole in the asked key, displaced by no more letters than are
    unmatched; pieces are joined by lengths, number and letters.  No pair is lost.
    Pieces are some hundred times the keys, so they are never sent to every task.
    Letters that both keys have bound the ratio before a pair is dealt out.
    """
    n, m = F.col("n"), F.col("m")
    loose = F.greatest(F.ceil(F.round((1 - least) * (n + m), 9)).cast("int") - 1, F.lit(0))

    def begin(i):
        return F.floor(i * m / (F.col("loose") + 1)).cast("int")

    around = lambda c: F.explode(F.sequence(F.greatest(F.length(c) - apart, F.lit(1)), F.length(c) + apart))
    numbered = lambda df: df.withColumn("loose", loose).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("loose"))))
    size = begin(F.col("i") + 1) - begin(F.col("i"))
    cut = numbered(catalog.select("article_key", F.length("article_key").alias("m"), around("article_key").alias("n")))
    cut = cut.select("article_key", "n", "m", "i", F.substring(F.col("article_key"), begin(F.col("i")) + 1, size).alias("piece"))
    probe = numbered(asked.select("key", F.length("key").alias("n"), around("key").alias("m")))
    probe = probe.select("key", "n", "m", "i", size.alias("size"), F.explode(F.sequence(begin(F.col("i")) - F.col("loose"), begin(F.col("i")) + F.col("loose"))).alias("at"))
    probe = probe.where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n"))).select("key", "n", "m", "i", F.substring(F.col("key"), F.col("at") + 1, F.col("size")).alias("piece")).distinct()
    shared = F.length("key") - F.length(F.call_function("translate", F.col("key"), F.col("article_key"), F.lit("")))
    met = probe.join(cut.hint("merge"), ["n", "m", "i", "piece"]).where(2 * shared > least * (n + m)).select("key", "article_key")
    spark = asked.sparkSession  # pairs are few bytes and much work, so their number of parts is fixed
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return met.repartition(parts, "key", "article_key").distinct()


def likest_keys(asked: DataFrame, catalog: DataFrame, least: float) -> DataFrame:
    """``key, article_key``: the catalogue key with the highest ratio above ``least`` to each asked one; of equals the first.

    A key that has one above a higher level has its likest there: only the others are
    compared at the next, where pieces are shorter and meet more keys.
    """
    catalog, found = spread(catalog), []
    for level in [*(x for x in LEVELS if x > least), least]:
        ratios = alike_keys(spread(asked), catalog, level).withColumn("ratio", sequence_ratio("key", "article_key"))
        best = ratios.groupBy("key").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "article_key")).alias("b")).where(F.col("b.r") < -level)  # a filter of the ratio itself would be pushed below distinct
        found.append(held(best.select("key", "b.article_key"), "likest"))
        asked = asked.join(found[-1], "key", "left_anti")
    return reduce(DataFrame.unionByName, found)


def fuzzy_articles(questions: DataFrame, catalog: DataFrame, exact: DataFrame, pattern: str = "(?U)" + fixed.ARTICLE, least: float = fixed.LIKE_ARTICLE) -> DataFrame:
    """``question_id, rank, canonical``: the likest catalogue entry of each candidate of questions without an exact one.

    Lengths differ by at most 2.  Only keys that share a piece are compared, and
    shared letters bound the ratio before it is computed.
    """
    open_questions = questions.join(exact.select("question_id").distinct(), "question_id", "left_anti")
    asked = open_questions.select("question_id", F.posexplode(article_candidates(F.col("question"), pattern)).alias("pos", "raw"))
    asked = held(asked.select("question_id", "pos", normalize_article(F.col("raw")).alias("key")), "asked")
    likest = likest_keys(held(asked.select("key").distinct(), "keys"), catalog.select("article_key"), least)
    best = asked.join(likest, "key").join(catalog, "article_key")
    first = best.groupBy("question_id", "canonical").agg(F.min("pos").alias("pos"))
    return first.select("question_id", F.row_number().over(Window.partitionBy("question_id").orderBy("pos", "canonical")).alias("rank"), "canonical")


def expand_query(questions: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds ``expanded``: the question and the canonical spellings it does not hold yet."""
    listed = articles.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "canonical"))), lambda x: x["canonical"]).alias("found"))
    joined = questions.join(listed, "question_id", "left")
    extra = F.filter(F.coalesce("found", F.array().cast("array<string>")), lambda a: ~F.contains(normalize_article(F.col("question")), normalize_article(a)))
    return joined.withColumn("expanded", F.when(F.size(extra) > 0, F.concat_ws(" ", "question", F.array_join(extra, " "))).otherwise(F.col("question"))).drop("found")
