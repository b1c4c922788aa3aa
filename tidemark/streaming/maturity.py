"""Decisions meeting later candles on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def maturity_join(decisions: DataFrame, candles: DataFrame, horizon_minutes: int, tolerance: int = 90, delay: str = "10 minutes") -> DataFrame:
    """Left outer interval join of decisions with candles in ``[t+h, t+h+tolerance]``.

    Both sides carry a watermark, so state is bounded; a decision whose interval
    has passed without a candle comes out with nulls (a data gap). Several
    candles may match: ``first_matches`` keeps the earliest.

    Both sides meet in stretches of time as long as the tolerance, so an asset is
    many keys: a decision stands in the stretch of its target, a candle in its
    own and the one before, and a pair meets in exactly one of them.
    """
    stretch = max(tolerance, 1)
    target = F.col("ts") + horizon_minutes * 60
    d = decisions.withColumn("target_ts", target).withColumn("target_time", F.timestamp_seconds("target_ts")).withWatermark("target_time", delay).withColumn("_stretch", F.floor(F.col("target_ts") / stretch))
    c = candles.select(F.col("asset").alias("c_asset"), F.col("ts").alias("future_ts"), F.col("close").alias("future_price"),
                       F.timestamp_seconds("ts").alias("candle_time")).withWatermark("candle_time", delay)
    own = F.floor(F.col("future_ts") / stretch)
    c = c.withColumn("_c_stretch", F.explode(F.array(own - 1, own)))
    near = (F.col("asset") == F.col("c_asset")) & (F.col("_stretch") == F.col("_c_stretch")) & (F.col("candle_time") >= F.col("target_time")) & (
        F.col("candle_time") <= F.col("target_time") + F.expr(f"INTERVAL {tolerance} SECONDS"))
    return d.join(c, near, "left_outer").drop("c_asset", "candle_time", "target_time", "_stretch", "_c_stretch")


def first_matches(joined: DataFrame, id_col: str = "decision_id") -> DataFrame:
    """One row per decision with maturity, from the written join output."""
    best = joined.groupBy(id_col).agg(F.min_by(F.struct("future_ts", "future_price"), "future_ts").alias("_m"))
    return best.select(id_col, F.when(F.col("_m").isNotNull(), "matured").otherwise("data_gap").alias("maturity"), "_m.*")
