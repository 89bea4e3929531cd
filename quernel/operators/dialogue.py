"""Conversation history, context, cautions, responses and answer checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions import fixed
from quernel.functions.text import fill, is_refusal, matches


def recent_turns(turns: DataFrame, limit: int = 3) -> DataFrame:
    """The last turns of each conversation; ``place`` counts from the oldest of them."""
    newest = turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn_id")))).where(F.col("back") <= limit)
    return newest.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn_id"))).drop("back")


def retain_turns(turns: DataFrame, max_turns: int = 200, max_answer_chars: int = 2000) -> DataFrame:
    """The newest turns of each conversation, with long answers cut."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn_id"))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= max_turns).drop("back").withColumn("answer", F.substring("answer", 1, max_answer_chars))


def assemble_context(questions: DataFrame, hits: DataFrame, facts: DataFrame, turns: DataFrame) -> DataFrame:
    """``question_id, context``: history, facts, numbered fragments and the question.

    ``hits(question_id, rank, source_label, text)``, ``facts(question_id, facts_text)``,
    ``turns(question_id, place, question, answer)``; at most the top hits and last turns.
    """
    said = fill(fixed.SAID, F.col("question"), F.substring("answer", 1, 400))
    history = turns.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", said.alias("s")))), lambda x: x["s"]), "\n").alias("history"))
    shown = fill(fixed.FRAGMENT, F.col("rank").cast("string"), F.col("source_label"), F.col("text"))
    found = hits.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", shown.alias("s")))), lambda x: x["s"]), "\n\n").alias("fragments"))
    known = facts.select("question_id", F.nullif("facts_text", F.lit("")).alias("facts_text"))
    joined = questions.join(history, "question_id", "left").join(known, "question_id", "left").join(found, "question_id", "left")
    blocks = [
        F.concat(F.lit(fixed.HISTORY), F.col("history")),
        F.concat(F.lit(fixed.FACTS), F.col("facts_text")),
        F.when(F.col("fragments").isNotNull(), F.concat(F.lit(fixed.FRAGMENTS), F.col("fragments"))).when(F.col("facts_text").isNull(), fixed.EMPTY_CONTEXT),
        F.concat(F.lit(fixed.QUESTION), F.col("question")),
    ]
    return joined.select("question_id", F.concat_ws(fixed.BETWEEN, *blocks).alias("context"))


def caution(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """``question_id, caution``: why an answer should be checked, or null.

    ``answers(question_id, answer, facts_text)``, ``docs(question_id, relevance)``.
    """
    seen = docs.groupBy("question_id").agg(F.count("*").alias("n"), F.max("relevance").alias("best"))
    joined = answers.join(seen, "question_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    has_facts = F.coalesce(F.col("facts_text") != "", F.lit(False))
    text = (
        F.when((has_facts & (F.col("n") == 0)) | is_refusal(F.col("answer")), F.lit(None).cast("string"))
        .when(F.col("n") == 0, fixed.NO_DOCS)
        .when(F.col("best") < 60, fixed.LOW_RELEVANCE)
        .when(F.col("n") <= 2, fixed.FEW_DOCS)
    )
    return joined.select("question_id", text.alias("caution"))


def response_json(answers: DataFrame, sources: DataFrame, docs: DataFrame, cautions: DataFrame, rows: DataFrame) -> DataFrame:
    """``question_id, response``: answer, sources, register rows, exact counts, found documents and caution as JSON.

    ``rows(question_id, rank, ...)`` are the matching register rows; each gives an
    object of its other columns, in order of rank.
    """
    fields = [c for c in rows.columns if c not in ("question_id", "rank")]
    matching = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("r")))).alias("ranked"))
    matching = matching.select("question_id", F.transform("ranked", lambda x: x["r"]).alias("registry_rows"))
    listed = docs.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title", "snippet", "relevance"))), lambda d: F.struct(d["title"].alias("title"), d["snippet"].alias("snippet"), d["relevance"].alias("relevance"))).alias("found_docs"))
    joined = answers
    for part in (sources, listed, cautions, matching):
        joined = joined.join(part, "question_id", "left")
    or_none = lambda c: F.coalesce(F.col(c), F.array().cast(joined.schema[c].dataType)).alias(c)
    whole = F.struct("answer", or_none("sources"), or_none("registry_rows"), F.nullif("facts_text", F.lit("")).alias("exact_counts"), or_none("found_docs"), "caution")
    return joined.select("question_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("response"))


def evaluate_answers(answers: DataFrame, cases: DataFrame, refusal: str = fixed.CHECK_REFUSAL, invented: str = fixed.INVENTED) -> DataFrame:
    """One row for each case: ``passed``, the ``problems`` found and the names of the checks ``failed``.

    ``cases(question_id, must_refuse, must_contain, must_not_contain, needs_exact_counts)``,
    ``answers(question_id, answer, exact_counts)``.
    """
    joined = cases.join(answers, "question_id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    refused = matches(F.col("answer"), refusal)
    low = F.lower("answer")
    missing = F.filter(F.coalesce("must_contain", F.array().cast("array<string>")), lambda f: ~F.contains(low, F.lower(f)))
    present = F.filter(F.coalesce("must_not_contain", F.array().cast("array<string>")), lambda f: F.contains(low, F.lower(f)))
    checks = {
        "refusal": (F.col("must_refuse") & ~refused, F.lit("no refusal")),
        "exact_counts": (F.col("needs_exact_counts") & (F.coalesce("exact_counts", F.lit("")) == ""), F.lit("no exact count")),
        "contains": (F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        "excludes": (F.size(present) > 0, F.concat(F.lit("present: "), F.array_join(present, ", "))),
        "invented": (~F.col("must_refuse") & matches(F.col("answer"), invented), F.lit("invented")),
    }
    problems = F.array_compact(F.array(*(F.when(failed, F.struct(F.lit(name).alias("check"), text.alias("text"))) for name, (failed, text) in checks.items())))
    found = joined.select("question_id", problems.alias("found"))
    return found.select("question_id", F.transform("found", lambda p: p["text"]).alias("problems"), F.transform("found", lambda p: p["check"]).alias("failed"), (F.size("found") == 0).alias("passed"))


def pass_rate(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("cases"), F.sum(F.col("passed").cast("long")).alias("passed"))


def check_failures(checked: DataFrame) -> DataFrame:
    """``check, failures``: how many cases each check fails."""
    return checked.select(F.explode("failed").alias("check")).groupBy("check").agg(F.count("*").alias("failures"))
