"""Time lookups: exact lag, as-of in both directions, trailing context.

The right side is packed into one row per (key, time chunk) holding the sorted
rows of that chunk, so a lookup is an equi join followed by an array filter. A
packed row is bounded by the chunk length (one bar per grid point), the left
side is never sorted, and a hot (key, chunk) on the left is split by AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import chunks as C


def exact_lag(df: DataFrame, offsets: Sequence[int], cols: Sequence[str], keys: Sequence[str] = ("asset",),
              ts: str = "ts") -> DataFrame:
    """Rows joined to the row exactly ``offset`` seconds away (null when absent).

    All offsets share one join: they are exploded first. The key carries the
    timestamp, so it spreads evenly whatever the size of one series.
    """
    left = df.withColumn("offset", F.explode(F.array(*[F.lit(int(o)) for o in offsets])))
    left = left.withColumn("_at", F.col(ts) + F.col("offset"))
    right = df.select(*keys, F.col(ts).alias("_at"), *[F.col(c).alias(f"at_{c}") for c in cols])
    return left.join(right, [*keys, "_at"], "left").drop("_at")


def pack(right: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], width: int, back: int = 0,
         ahead: int = 0) -> DataFrame:
    """One row per (key, chunk) with the sorted rows of the chunk and its halo."""
    rows = C.with_halo(right, ts, width, back, ahead)
    entry = F.struct(F.col(ts).alias("ts"), *[c for c in cols if c != ts])
    return rows.groupBy(*keys, C.CHUNK).agg(F.array_sort(F.collect_list(entry)).alias("_rows"))


def forward_asof(left: DataFrame, right: DataFrame, target: str, tolerance: int, cols: Sequence[str],
                 keys: Sequence[str] = ("asset",), width: int | None = None, out: str = "future") -> DataFrame:
    """First right row in ``[target, target + tolerance]`` as a struct column."""
    width = width or max(32 * tolerance, 1)
    packed = pack(right, keys, "ts", cols, width, ahead=tolerance + 1)
    t = F.col(target)
    joined = C.with_chunk(left, target, width).join(packed, [*keys, C.CHUNK], "left")
    near = F.filter("_rows", lambda r: r["ts"].between(t, t + F.lit(tolerance)))
    return joined.withColumn(out, F.get(near, F.lit(0))).drop("_rows", C.CHUNK)


def backward_asof(left: DataFrame, right: DataFrame, target: str, staleness: int, cols: Sequence[str],
                  keys: Sequence[str] = ("asset",), width: int | None = None, out: str = "past") -> DataFrame:
    """Last right row in ``[target - staleness, target]`` as a struct column."""
    width = width or max(32 * staleness, 1)
    packed = pack(right, keys, "ts", cols, width, back=staleness)
    t = F.col(target)
    joined = C.with_chunk(left, target, width).join(packed, [*keys, C.CHUNK], "left")
    near = F.filter("_rows", lambda r: r["ts"].between(t - F.lit(staleness), t))
    return joined.withColumn(out, F.try_element_at(near, F.lit(-1))).drop("_rows", C.CHUNK)


def maturity(left: DataFrame, right: DataFrame, target: str, tolerance: int,
             keys: Sequence[str] = ("asset",), width: int | None = None) -> DataFrame:
    """Forward lookup classed as matured, not_matured or data_gap.

    Adds ``maturity``, ``future_ts``, ``future_price``. The newest bar per key
    decides between the last two; that side is one row per key and carries no
    hint, so AQE broadcasts it from its measured size.
    """
    found = forward_asof(left, right, target, tolerance, ["close"], keys, width)
    newest = right.groupBy(*keys).agg(F.max("ts").alias("_newest"))
    joined = found.join(newest, list(keys), "left")
    state = (F.when(F.col("future").isNotNull(), "matured")
             .when(F.col("_newest").isNull() | (F.col("_newest") < F.col(target)), "not_matured")
             .otherwise("data_gap"))
    return (joined.withColumn("maturity", state)
            .withColumn("future_ts", F.col("future.ts"))
            .withColumn("future_price", F.col("future.close"))
            .drop("future", "_newest"))


def cap_per_instant(right: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], n: int) -> DataFrame:
    """At most ``n`` rows per timestamp, the last by ``order``.

    Exact for any lookup of the last ``n`` rows, and it bounds a packed chunk
    by ``n`` rows per second. The rank limit is applied before the shuffle too.
    """
    w = Window.partitionBy(*keys, ts).orderBy(*[F.desc(c) for c in order])
    return right.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")


def last_items(arr: Column, n) -> Column:
    """Last ``n`` elements in order; names ``arr`` once, so a costly one runs once."""
    return F.reverse(F.slice(F.reverse(arr), F.lit(1), n if isinstance(n, Column) else F.lit(n)))


def trailing_context(left: DataFrame, right: DataFrame, n: int, cols: Sequence[str], width: int,
                     keys: Sequence[str] = ("asset",), at: str = "ts", ts: str = "ts",
                     order: Sequence[str] = (), out: str = "tail") -> DataFrame:
    """The last ``n`` right rows at or before each left row, oldest first.

    Right rows get their position in the series: a rank inside their chunk plus
    the rows of all earlier chunks, a sum over the table of counts. They are
    packed by position, ``n`` to a block, next to the block before. A left row
    counts the rows up to its time the same way; the block of the last one holds
    all it asks for. So only counts are ordered along a series, a packed row has
    at most ``2 n`` entries, and no key or gap passes one task. ``order`` breaks
    ties between equal timestamps.
    """
    cols = [c for c in cols if c != ts]
    lead = [F.col(ts).alias("ts"), *order, *[c for c in cols if c not in order]]
    rows = C.with_chunk(cap_per_instant(right, keys, ts, order, n) if order else right, ts, width)
    times = rows.groupBy(*keys, C.CHUNK).agg(F.sort_array(F.collect_list(ts)).alias("_times"))
    asked = C.with_chunk(left.select(*keys, at), at, width)
    # Chunks that only the left side has take part with no rows of their own.
    counts = (times.select(*keys, C.CHUNK, F.size("_times").alias("_n"))
              .unionByName(asked.select(*keys, C.CHUNK).distinct().withColumn("_n", F.lit(0)))
              .groupBy(*keys, C.CHUNK).agg(F.sum("_n").alias("_n")))
    before = C.carry(counts, keys, {"_before": ("_n", "sum")})

    rank = F.row_number().over(C.chunk_window(keys, [ts, *order, *[c for c in cols if c not in order]])) - 1
    block = F.floor((F.col("_before") + F.col("_rank")) / n)
    placed = rows.withColumn("_rank", rank).join(before, [*keys, C.CHUNK])
    packed = (placed.withColumn("_block", F.explode(F.array(block, block + 1)))
              .groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct(*lead))).alias("_rows")))

    upto = F.coalesce(F.size(F.filter("_times", lambda t: t <= F.col(at))), F.lit(0))
    seen = (C.with_chunk(left, at, width).join(before, [*keys, C.CHUNK], "left").join(times, [*keys, C.CHUNK], "left")
            .withColumn("_upto", F.coalesce("_before", F.lit(0)) + upto).drop("_times", "_before", C.CHUNK)
            .withColumn("_block", F.floor((F.col("_upto") - 1) / n)))
    base = F.greatest(F.col("_block") - 1, F.lit(0)) * n
    first = F.greatest(F.col("_upto") - n, F.lit(0))
    tail = F.slice("_rows", (first - base + 1).cast("int"), (F.col("_upto") - first).cast("int"))
    kind = "array<" + packed.schema["_rows"].dataType.elementType.simpleString() + ">"
    joined = seen.join(packed, [*keys, "_block"], "left")
    return C.pin(joined, out, F.coalesce(tail, F.array().cast(kind))).drop("_rows", "_block", "_upto")


def at_last_bar(left: DataFrame, bars: DataFrame, width: int, keys: Sequence[str] = ("asset",), out: str = "bar_ts") -> DataFrame:
    """Timestamp of the newest bar at or before each left row (null when none)."""
    found = trailing_context(left, bars.select(*keys, "ts"), 1, [], width, keys, out="_one")
    return found.withColumn(out, F.get("_one", F.lit(0))["ts"]).drop("_one")


def as_of(bars: DataFrame, at: int, limit: int, keys: Sequence[str] = ("asset",), start: int | None = None) -> DataFrame:
    """Newest ``limit`` rows per key with ``ts <= at`` (single point in time)."""
    seen = bars.filter(F.col("ts") <= F.lit(at))
    if start is not None:
        seen = seen.filter(F.col("ts") >= F.lit(start))
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    return seen.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= limit).drop("_rk")


def range_members(df: DataFrame, ranges: Sequence[tuple[str, int, int]], ts: str = "ts") -> Column:
    """Name of the first closed range holding the timestamp (a handful of ranges)."""
    out = F.lit(None).cast("string")
    for name, start, end in reversed(list(ranges)):
        out = F.when(F.col(ts).between(F.lit(start), F.lit(end)), F.lit(name)).otherwise(out)
    return out


def overlap_pairs(left: DataFrame, right: DataFrame, width: int, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Pairs of closed intervals that overlap, joined by time bucket.

    Both sides: keys, ``id``, ``start_ts``, ``end_ts``. A pair is kept only in the
    bucket where the later of the two starts, so no pair comes out twice.
    """
    def spread(df, tag):
        cells = F.sequence(C.bucket(F.col("start_ts"), width), C.bucket(F.col("end_ts"), width))
        return df.select(*keys, F.explode(cells).alias(C.CHUNK), F.col("id").alias(f"{tag}_id"),
                         F.col("start_ts").alias(f"{tag}_start"), F.col("end_ts").alias(f"{tag}_end"))
    pairs = spread(left, "left").join(spread(right, "right"), [*keys, C.CHUNK])
    later = F.greatest("left_start", "right_start")
    return pairs.filter(
        (F.col("left_start") <= F.col("right_end")) & (F.col("right_start") <= F.col("left_end"))
        & (C.bucket(later, width) == F.col(C.CHUNK))).drop(C.CHUNK)
