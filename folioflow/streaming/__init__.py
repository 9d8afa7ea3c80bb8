"""Documents that keep arriving: chunked and exported in micro-batches, without state.

Chunks of a document depend on that document alone, so a stream needs neither watermark nor state: each micro-batch is
chunked like a table. Counts over time windows, with late rows allowed for, are there for monitoring.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from folioflow.config import SizeConfig
from folioflow.operators.chunking import chunk_documents


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string", files_at_once: int = 100) -> DataFrame:
    """Documents from Parquet files as they appear under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def chunk_stream(docs: DataFrame, config: SizeConfig = SizeConfig()) -> DataFrame:
    """Chunks of a stream of documents."""
    return chunk_documents(docs, config)


def write_stream(chunks: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append chunks as Parquet; the checkpoint makes files appear once."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def event_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by type in tumbling windows of ``ts``, rows up to ``late`` behind included."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return own.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by user in sessions: runs without a gap of that length, complete once the watermark has passed them."""
    own = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return own.agg(F.count(F.lit(1)).alias("n")).select("user_id", "w.start", "w.end", "n")


def first_seen(docs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Documents (ts, text, ...) whose text hasn't come before within the watermark: state is one hash a text."""
    return docs.withWatermark("ts", late).withColumn("text_key", F.xxhash64("text")).dropDuplicatesWithinWatermark(["text_key"])


def running_totals(events: DataFrame, forget: str = "1 day") -> DataFrame:
    """user_id, n and total of all events so far, each time some arrive; users without events for ``forget`` behind the watermark are forgotten.

    The state of a user is two numbers, whatever the number of events.
    """
    wait = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].fillna(0.0).sum())
        state.update((n, total))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + wait)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    own = events.select("user_id", "ts", "value").withWatermark("ts", "30 minutes").groupBy("user_id")
    return own.applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", "EventTimeTimeout")
