"""Streaming extension: sentences that arrive are asked once, answers are appended by micro-batch.

What was asked before is kept as the state of the stream, by text, so a batch
costs what is new in it, however many answers there are; the state survives in
the checkpoint and grows with the distinct texts (for many of them choose the
RocksDB state store). The batch operators are used as they are; a batch that
runs again after a failure writes its own folder anew, so results are exactly
once.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import Extractor, Pace, ask_words


def _answered(asked: DataFrame) -> DataFrame:
    """Rows with an answer; the first error fails the batch, which then runs again."""
    wrong = F.raise_error(F.col("error"))
    return asked.withColumn("text", F.when(F.col("error").isNotNull(), wrong.cast("string")).otherwise(F.col("text"))).drop("error")


def answer_stream(sentences: DataFrame, text: str, extractor: Extractor, answers: str, checkpoint: str, pace: Pace = Pace(), known: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Keep the answers table at a path up to date with a stream of sentences; trigger as for writeStream.trigger.

    known: answers from elsewhere (text, words) that need not be asked again;
    they are read with every batch. The table has one folder for each batch of
    each checkpoint, so several streams may write to it.
    """
    run = f"{zlib.crc32(checkpoint.encode()):08x}"

    def batch(df: DataFrame, n: int) -> None:
        _answered(ask_words(df, "text", extractor, known, pace)).write.mode("overwrite").parquet(f"{answers.rstrip('/')}/run={run}/batch={n}")

    fresh = sentences.select(F.col(text).alias("text")).where("text is not null").dropDuplicates(["text"])
    return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
