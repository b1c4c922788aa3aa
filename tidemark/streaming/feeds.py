"""Restartable feeds: candles, news, heartbeats and the decision tail.

Each function starts nothing by itself: it returns a configured
``DataStreamWriter`` so the caller picks trigger and lifetime.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions import text
from tidemark.plans import reports
from tidemark.sources import sinks

AHEAD = 60
BEHIND = 1200


def acceptance(ts: str = "ts", received: str = "received_at", ahead: int = AHEAD, behind: int = BEHIND):
    """future, late, malformed or null (accepted) for an arriving candle."""
    c = F.col
    age = c(received) - c(ts)
    return (F.when(c("close").isNull() | (c("close") <= 0) | (c("high") < c("low")) | (c("volume") < 0), "malformed")
            .when(age < -ahead, "future").when(age > behind, "late"))


def candle_upserts(feed: DataFrame, table: str, rejected: str, checkpoint: str, timeframe: int = 60) -> DataStreamWriter:
    """Upsert accepted candles, append the others with their reason.

    ``feed`` has ``received_at``; a candle delivered again replaces the stored
    one, so replaying a batch changes nothing. Rejected rows are keyed by batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("rejection", acceptance())
        good = marked.filter(F.col("rejection").isNull()).drop("rejection")
        sinks.upsert_bars(good, table, order="received_at", timeframe=timeframe)
        bad = marked.filter(F.col("rejection").isNotNull())
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def news_inserts(feed: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """Insert each headline once, however late it comes.

    Repeats inside a batch and of stored headlines are caught by the insert
    itself, so no state is held and nothing is late. ``feed``: ts, source, headline.
    """
    keyed = feed.withColumn("headline_hash", text.headline_key(F.col("source"), F.col("headline")))

    def write(batch: DataFrame, batch_id: int) -> None:
        sinks.insert_absent(batch, table, "headline_hash", ["ts"])

    return keyed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def heartbeats(feed: DataFrame, table: str, checkpoint: str, now, required: Mapping[str, int] = reports.REQUIRED_WORKERS) -> DataStreamWriter:
    """Keep the health table of the required workers; ``now`` gives the time of a batch."""
    latest = feed.groupBy("worker").agg(F.max("ts").alias("ts"))

    def write(batch: DataFrame, batch_id: int) -> None:
        reports.heartbeat_status(batch, int(now()), required).write.mode("overwrite").parquet(table)

    return latest.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)


def decision_tail(feed: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """Append decisions once each; the checkpoint remembers how far the tail has read."""
    return (feed.writeStream.outputMode("append").format("parquet").option("path", table)
            .option("checkpointLocation", checkpoint))
