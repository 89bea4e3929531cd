"""Conversation history that grows turn by turn."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quernel.sources.store import table_or_empty
from quernel.streaming.ingest import ROCKSDB

TURNS = "turn_id long, question string, answer string, created_at timestamp"
KEPT = f"conv_id long, {TURNS}"
_NAMES = ["turn_id", "question", "answer", "created_at"]


def _order(turn: tuple) -> tuple:
    """The newest first; equal turns by their texts, so that the order of arrival says nothing."""
    return -turn[0], turn[1] is not None, turn[1] or "", turn[2] is not None, turn[2] or ""


class NewestTurns(StatefulProcessor):
    """The newest ``most`` turns of a conversation, answers cut, as list state; gives them out whenever turns arrive."""

    def __init__(self, most: int, answer_chars: int):
        self.most, self.answer_chars = most, answer_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._turns = handle.getListState("turns", TURNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(t) for t in self._turns.get()] if self._turns.exists() else []
        for part in rows:
            for turn_id, question, answer, created_at in zip(*(part[n] for n in _NAMES)):
                at = None if pd.isna(created_at) else pd.Timestamp(created_at).to_pydatetime()
                kept.append((int(turn_id), question, answer[: self.answer_chars] if answer is not None else None, at))
            kept = sorted(kept, key=_order)[: self.most]
        self._turns.put(kept)
        yield pd.DataFrame([(key[0], *t) for t in reversed(kept)], columns=["conv_id", *_NAMES])

    def close(self) -> None:
        pass


def newest_turns(turns: DataFrame, max_turns: int = 200, max_answer_chars: int = 2000) -> DataFrame:
    """A stream of ``turns(conv_id, turn_id, question, answer, created_at)`` as that of the turns kept in every conversation that got any."""
    plain = turns.where("conv_id is not null and turn_id is not null").select("conv_id", *_NAMES)
    return plain.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=NewestTurns(max_turns, max_answer_chars), outputStructType=KEPT, outputMode="append", timeMode="None")


def history_stream(turns: DataFrame, history_dir: str, checkpoint: str, once: bool = False, max_turns: int = 200, max_answer_chars: int = 2000):
    """Starts the stream that keeps the history below ``history_dir``; a batch writes the conversations it changed, a repeated one anew."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(kept: DataFrame, batch_id: int) -> None:
        placed = kept.withColumn("batch_id", F.lit(batch_id).cast("long"))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(history_dir)

    writer = newest_turns(turns, max_turns, max_answer_chars).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_history(spark: SparkSession, history_dir: str) -> DataFrame:
    """The turns that every conversation has now: those of its last batch."""
    stored = table_or_empty(spark, history_dir, f"{KEPT}, batch_id long")
    last = F.max("batch_id").over(Window.partitionBy("conv_id"))
    return stored.withColumn("last", last).where("batch_id = last").drop("batch_id", "last")
