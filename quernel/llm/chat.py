"""Quotation linking in conversations, in DataFrame functions only.

Lines that start with ``>`` are quoted, one level for each sign.  Runs of lines
of one level are passages; a passage's sentences are normalised and hashed and
joined to the message of the conversation that first wrote them.  A message
answers the earlier one from which it quotes most at its lowest level.  What is
quoted is left out of the text, and messages are put in the order of threads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm._shared import materialize, unused

_SIGNS = r"^((?:[ \t]?>)++)"  # possessive: a group that may give back recurses for each sign
_RUN, _LEVEL = "\x01", "\x02"


def with_runs(messages: DataFrame) -> DataFrame:
    """Adds ``runs``, an array of ``(level, text)``: the runs of lines of one level, in order; 0 is the message's own.

    The control characters U+0001 and U+0002 are dropped from texts.  A text
    without a sign of quotation is one run and not cut into lines.
    """
    clean = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), _RUN + _LEVEL, ""), r"\r\n", "\n")
    clean_name, lines_name, levels_name = unused(messages, "clean", "lines", "levels")
    signed = messages.withColumn(clean_name, clean)
    lines = signed.withColumn(lines_name, F.when(F.contains(clean_name, F.lit(">")), F.split(clean_name, "\n")))
    level = lambda x: F.length(F.translate(F.regexp_extract(x, _SIGNS, 1), " \t", ""))
    lines = lines.withColumn(levels_name, F.transform(lines_name, level))

    def mark(x, i):
        inner = F.regexp_replace(x, _SIGNS + r"[ \t]?", "")
        same = (i > 0) & (F.element_at(levels_name, F.greatest(i, F.lit(1))) == F.element_at(levels_name, i + 1))
        return F.when(same, F.concat(F.lit("\n"), inner)).otherwise(F.concat(F.lit(_RUN), F.element_at(levels_name, i + 1).cast("string"), F.lit(_LEVEL), inner))

    marked = F.slice(F.split(F.array_join(F.transform(lines_name, mark), ""), _RUN), 2, 2**30)
    runs = F.transform(marked, lambda r: F.struct(F.substring_index(r, _LEVEL, 1).cast("int").alias("level"), F.substring_index(r, _LEVEL, -1).alias("text")))
    one = F.array(F.struct(F.lit(0).alias("level"), F.col(clean_name).alias("text")))
    return lines.withColumn("runs", F.coalesce(runs, one)).drop(clean_name, lines_name, levels_name)


def with_passages(messages: DataFrame) -> DataFrame:
    """Adds ``own`` (the text without quotes) and ``passages``, the quoted ones of ``with_runs``."""
    out = with_runs(messages)
    own = F.array_join(F.transform(F.filter("runs", lambda p: p["level"] == 0), lambda p: p["text"]), "\n")
    return out.withColumn("own", own).withColumn("passages", F.filter("runs", lambda p: p["level"] > 0)).drop("runs")


def sentences(text):
    """Normalised sentences: white space collapsed, lower-cased, empty ones dropped."""
    flat = F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))
    return F.filter(F.split(F.regexp_replace(flat, r"([.!?]) ", "$1\x01"), _RUN), lambda s: s != "")


def hashed_sentences(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, h``: the distinct sentences of every message by level, 0 for its own."""
    hashed = F.flatten(F.transform("runs", lambda p: F.transform(sentences(p["text"]), lambda s: F.struct(p["level"].alias("level"), F.xxhash64(s).alias("h")))))
    return with_runs(messages).select("conv_id", "turn", F.explode(F.array_distinct(hashed)).alias("s")).select("conv_id", "turn", "s.level", "s.h")


def link_quotes(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, origin, n``: earlier messages whose sentences a message quotes.

    A sentence belongs to the message that has it first in the conversation.  Texts
    are parsed once; their hashes are written and read for both sides of the join.
    """
    hashed = materialize(hashed_sentences(messages), "sentences")
    quoted = hashed.where("level > 0").distinct()
    written = hashed.where("level = 0").groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    met = quoted.join(written, ["conv_id", "h"]).where("origin < turn")
    return met.groupBy("conv_id", "turn", "level", "origin").agg(F.count("*").alias("n"))


def reply_threads(messages: DataFrame) -> DataFrame:
    """Every row of ``messages(conv_id, turn, role, text, ...)`` as a turn of a reply-ordered conversation.

    Returns ``conv_id, turn, role, text, reply_to, thread, n_quoted, n_linked,
    formatted``, sorted by ``conv_id, thread, turn``: a thread starts with its first
    message and every answer follows what it answers.  ``text`` is without quotes;
    ``reply_to`` is the turn answered by quotation, null if there is none; ``thread``
    is the turn at the root of the chain of answers; ``n_quoted`` counts quoted
    passages and ``n_linked`` the quoted sentences that were found.

    * A null text is empty; a null role is written as ``unknown`` in ``formatted``.
    * Messages with a null conversation or turn link with nothing; a null turn is
      its own, null, thread.
    * Rows that repeat a conversation and turn are parts of one message: they share
      its links and each gives a row.
    * Other columns are not read; an empty table gives no rows.
    """
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    links = materialize(link_quotes(messages), "quotes")
    best = F.max_by("origin", F.struct(-F.col("level"), "n", "origin"))
    answers = materialize(links.groupBy("conv_id", "turn").agg(best.alias("reply_to"), F.sum("n").alias("n_linked")), "answers")

    # Pointer jumping to the root of each chain; the number of rounds is the logarithm of its length.
    roots = answers.select("conv_id", "turn", F.col("reply_to").alias("thread"))
    while True:
        up = roots.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("up"))
        joined = roots.join(up, ["conv_id", "thread"], "left")
        if joined.where("up is not null").isEmpty():
            break
        roots = materialize(joined.select("conv_id", "turn", F.coalesce("up", "thread").alias("thread")), "threads")

    parsed = with_passages(messages).select("conv_id", "turn", "role", F.col("own").alias("text"), F.size("passages").cast("long").alias("n_quoted"))
    out = parsed.join(answers, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    out = out.withColumn("thread", F.coalesce("thread", "turn")).withColumn("n_linked", F.coalesce("n_linked", F.lit(0)))
    # The closing sort is the order of replies; it deals ranges, so that a long conversation is split.
    out = out.select("conv_id", "turn", "role", "text", "reply_to", "thread", "n_quoted", "n_linked").orderBy("conv_id", "thread", "turn")
    shown = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    return out.withColumn("formatted", shown)
