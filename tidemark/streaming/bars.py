"""Event-time bars and regime windows on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.regimes import move_regime


def tumbling_bars(candles: DataFrame, minutes: int = 15, delay: str = "20 minutes") -> DataFrame:
    """Right-closed bars; rows behind the watermark are dropped.

    Windows are closed on the left, so the event time is moved back one second.
    """
    rows = candles.withColumn("event_time", F.timestamp_seconds(F.col("ts") - 1)).withWatermark("event_time", delay)
    w = F.window("event_time", f"{minutes} minutes")
    bars = rows.groupBy("asset", w.alias("w")).agg(
        F.max("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("observations"))
    return bars.select("asset", F.unix_timestamp("w.end").alias("bin_end"), "ts", "open", "high", "low", "close", "volume", "observations")


def sliding_regimes(candles: DataFrame, trend_pct: float, sideways_pct: float, window: str = "60 minutes", slide: str = "10 minutes",
                    delay: str = "20 minutes") -> DataFrame:
    """Regime windows on a stream. Half-open, unlike the batch form with closed ends."""
    rows = candles.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    # A window holds one entry per bar, which bounds the sorted array.
    stats = rows.groupBy("asset", F.window("event_time", window, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("candles"), F.min_by("close", "ts").alias("start_price"), F.max_by("close", "ts").alias("end_price"),
        F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("_rows"))
    close = F.transform("_rows", lambda r: r["close"])
    n = F.size("_rows")
    rets = F.zip_with(F.slice(close, 2, F.greatest(n - 1, F.lit(0))), F.slice(close, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: (b / a - 1) * 100)
    mean = F.aggregate(rets, F.lit(0.0), lambda a, x: a + x) / F.nullif(n - 1, F.lit(0))
    square = F.aggregate(rets, F.lit(0.0), lambda a, x: a + x * x) / F.nullif(n - 1, F.lit(0))
    move = F.round((F.col("end_price") / F.col("start_price") - 1) * 100, 4)
    return stats.select(
        "asset", F.unix_timestamp("w.start").alias("start_ts"), F.unix_timestamp("w.end").alias("end_ts"), "candles", "start_price", "end_price",
        move.alias("move_pct"), F.round(F.coalesce(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), F.lit(0.0)), 4).alias("volatility_pct"),
        move_regime(move, trend_pct, sideways_pct).alias("label"))
