"""Candle validity, grid and order checks, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import chunks as C

PRICES = ("open", "high", "low", "close")


def _bad_number(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def violations() -> Column:
    """Array of broken rules of a candle row (empty when valid)."""
    o, h, l, c, v = (F.col(x).cast("double") for x in (*PRICES, "volume"))
    numbers = [o, h, l, c, v]
    missing = F.col("ts").isNull()
    for x in numbers:
        missing = missing | _bad_number(x)
    rules = [
        (missing, "not_finite"),
        (F.least(o, h, l, c) <= 0, "non_positive_price"),
        (v < 0, "negative_volume"),
        (h < F.greatest(o, c, l), "high_below_range"),
        (l > F.least(o, c, h), "low_above_range"),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in rules]), lambda x: x.isNotNull())


def quarantine(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into valid rows and rows with a ``violations`` column."""
    marked = bars.withColumn("violations", violations())
    return (marked.filter(F.size("violations") == 0).drop("violations"),
            marked.filter(F.size("violations") > 0))


def require_valid(bars: DataFrame) -> DataFrame:
    """Strict mode: the job fails on the first broken candle."""
    broken = violations()
    guard = F.when(F.size(broken) == 0, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("invalid candle: "), F.concat_ws(",", broken))).cast("boolean"))
    return bars.filter(guard)


def dedupe(bars: DataFrame, order: str | None = None, keep: str = "last") -> DataFrame:
    """One candle per (asset, ts); ``order`` is the ingest sequence that decides."""
    key = [order] if order else [c for c in bars.columns if c not in ("asset", "ts")]
    return C.dedupe_last(bars, ["asset", "ts"], key, keep)


def order_checks(rows: DataFrame, step: int, *, width: int = 86400) -> DataFrame:
    """Rows breaking the order or grid inside their declared file window.

    ``rows``: file, window_start, window_end, seq (position in the file), asset, ts.
    """
    # The previous row of a file may sit in the previous chunk of positions.
    halo = C.with_halo(rows, "seq", width, back=1)
    prev = F.lag("ts").over(C.chunk_window(["file"], ["seq"]))
    checked = halo.withColumn("_prev", prev).filter(F.col(C.OWN)).drop(C.CHUNK, C.OWN)
    rules = [
        (F.pmod(F.col("ts"), F.lit(step)) != 0, "off_grid"),
        (~F.col("ts").between(F.col("window_start"), F.col("window_end")), "outside_window"),
        (F.col("ts") <= F.col("_prev"), "not_increasing"),
    ]
    found = F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in rules]), lambda x: x.isNotNull())
    return checked.withColumn("violations", found).filter(F.size("violations") > 0).drop("_prev")


def window_overlaps(files: DataFrame) -> DataFrame:
    """Files whose declared window starts before the previous one has ended.

    ``files`` holds one row per source file, far fewer than data rows.
    """
    w = Window.partitionBy("asset").orderBy("window_start", "window_end")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (files.withColumn("previous_end", F.max("window_end").over(before))
            .filter(F.col("window_start") <= F.col("previous_end")))


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once; empty means unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def require_unique(df: DataFrame, keys) -> DataFrame:
    """The input, failing the job when a key repeats (costs one grouped count)."""
    name = ",".join(keys)
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    guard = F.when(F.col("_n") == 1, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"duplicate key: {name}")).cast("boolean"))
    return packed.filter(guard).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def key_set_difference(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Keys present on one side only, with the side that has them."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, list(keys), "full_outer")
    return (both.filter(F.col("_l").isNull() | F.col("_r").isNull())
            .withColumn("side", F.when(F.col("_l").isNull(), "right").otherwise("left"))
            .drop("_l", "_r"))
