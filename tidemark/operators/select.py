"""Order-dependent selection: spacing, spreading, ranking, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import chunks as C

FREE = -(2**62)


def _with(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on equal columns, null keys included."""
    other = right.withColumnsRenamed({n: f"_right_{n}" for n in on})
    test = F.lit(True)
    for n in on:
        test = test & F.col(n).eqNullSafe(F.col(f"_right_{n}"))
    return left.join(other, test).drop(*[f"_right_{n}" for n in on])


def greedy_spacing(signals: DataFrame, keys: Sequence[str], spacing: int, ts: str = "ts",
                   width: int | None = None, fan: int = 256) -> DataFrame:
    """Timestamps taken greedily: the first, then each at least ``spacing`` later.

    What a chunk takes depends on earlier chunks only through the time from
    which taking is allowed again, and that lies within the first ``spacing``
    seconds of the chunk. So a chunk is a small map from its possible first
    picks to the time it leaves behind, made in parallel. Maps of ``fan`` chunks
    are composed into one, again in parallel; only these (one a series for
    ``fan * width`` seconds) are followed in order. Then the times go back down:
    to each chunk, which replays its rows from its own. Rows never leave their
    chunk, and only maps move.
    """
    width = width or 64 * spacing
    if spacing <= 0 or width < spacing:
        raise ValueError("a chunk must be as long as the spacing, which must be positive")
    names, t, gap = list(keys), F.col(ts), F.lit(int(spacing))
    packed = (C.with_chunk(signals.select(*names, ts), ts, width).groupBy(*names, C.CHUNK)
              .agg(F.array_sort(F.collect_set(t)).alias("_ts")))
    limit = F.col(C.CHUNK) * F.lit(width) + gap
    later = F.filter("_ts", lambda x: x >= limit)
    entries = F.concat(F.filter("_ts", lambda x: x < limit), F.slice(later, 1, 1))
    leave = lambda e: F.aggregate("_ts", e, lambda allowed, x: F.when(x >= allowed, x + gap).otherwise(allowed))
    moves = lambda at, out: F.transform(at, lambda e: F.struct(e.alias("at"), out(e).alias("out")))
    maps = packed.select(*names, C.CHUNK, moves(entries, leave).alias("_moves"))

    # A chunk without a row to take passes the time on; a composed map ends with the move for that case.
    hit = lambda node, allowed: F.get(F.filter(node["moves"], lambda m: m["at"] >= allowed), F.lit(0))["out"]
    through_chunk = lambda allowed, node: F.coalesce(hit(node, allowed), allowed)
    through_many = lambda allowed, node: F.coalesce(hit(node, allowed), F.element_at(node["moves"], -1)["out"])
    in_order = lambda node: F.array_sort(F.collect_list(F.struct(F.col(node).alias("node"), F.col("_moves").alias("moves"))))

    def times(start, through):
        """Array of (node, time from which it may take) over ``_nodes`` in order."""
        empty = F.array().cast("array<struct<node:bigint,allowed:bigint>>")
        seed = F.struct(start.alias("allowed"), empty.alias("seen"))
        step = lambda s, n: F.struct(
            through(s["allowed"], n).alias("allowed"),
            F.array_append(s["seen"], F.struct(n["node"].alias("node"), s["allowed"].alias("allowed"))).alias("seen"))
        return F.inline(F.aggregate("_nodes", seed, step, lambda s: s["seen"]))

    many = (maps.withColumn("_many", C.bucket(F.col(C.CHUNK), fan)).groupBy(*names, "_many")
            .agg(in_order(C.CHUNK).alias("_nodes")))
    first = F.transform(F.get("_nodes", F.lit(0))["moves"], lambda m: m["at"])
    starts = F.array_append(first, F.array_max(first) + F.lit(1))
    composed = many.select(*names, "_many", moves(starts, lambda e: F.aggregate("_nodes", e, through_chunk)).alias("_moves"))
    top = (composed.groupBy(*names).agg(in_order("_many").alias("_nodes"))
           .select(*names, times(F.lit(FREE).cast("bigint"), through_many)).withColumnRenamed("node", "_many"))
    down = (_with(many, top, [*names, "_many"])
            .select(*names, times(F.col("allowed"), through_chunk)).withColumnRenamed("node", C.CHUNK))
    state = F.struct(F.col("allowed"), F.array().cast("array<bigint>").alias("taken"))
    replay = F.aggregate(
        "_ts", state,
        lambda s, x: F.when(x >= s["allowed"], F.struct(
            (x + gap).alias("allowed"), F.array_append(s["taken"], x).alias("taken"))).otherwise(s),
        lambda s: s["taken"])
    return _with(packed, down, [*names, C.CHUNK]).select(*names, F.explode(replay).alias(ts))


def spaced_timestamps(points: DataFrame, windows: DataFrame, cycles: int, spacing: int,
                      width: int = 86400) -> DataFrame:
    """Up to ``cycles`` timestamps per window, each at least ``spacing`` apart.

    ``windows``: asset, window_id, start_ts, end_ts. Points meet windows through
    time buckets.
    """
    cells = F.sequence(C.bucket(F.col("start_ts"), width), C.bucket(F.col("end_ts"), width))
    spread = windows.select("asset", "window_id", "start_ts", "end_ts", F.explode(cells).alias(C.CHUNK))
    inside = (C.with_chunk(points.select("asset", "ts"), "ts", width).join(spread, ["asset", C.CHUNK])
              .filter(F.col("ts").between(F.col("start_ts"), F.col("end_ts"))))
    taken = greedy_spacing(inside, ["asset", "window_id"], spacing)
    w = Window.partitionBy("asset", "window_id").orderBy("ts")
    return taken.withColumn("cycle", F.row_number().over(w)).filter(F.col("cycle") <= cycles)


def spread_evenly(df: DataFrame, keys: Sequence[str], order: str, count: Column | int, width: int = 86400,
                  tie: Sequence[str] = ()) -> DataFrame:
    """``count`` rows per key at evenly spread positions (all rows when fewer)."""
    ranked = C.global_rank(df, keys, order, width, "_rank", tie)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    k = count if isinstance(count, Column) else F.lit(int(count))
    # Position i of k lies at floor(i * (n-1)/(k-1)), the last one at n-1.
    step = (F.col("_size") - 1) / (F.col("_k") - 1).cast("double")
    at = F.when(F.col("_i") == F.col("_k") - 1, F.col("_size") - 1).otherwise(F.floor(F.col("_i") * step))
    some = sizes.withColumn("_k", F.least(k, F.col("_size")).cast("bigint")).filter("_k > 0")
    wanted = (some.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1)))
              .select(*keys, F.when(F.col("_k") == 1, F.lit(0)).otherwise(at).cast("bigint").alias("_at")).distinct())
    return (ranked.withColumn("_at", F.col("_rank") - 1).join(wanted, [*keys, "_at"]).drop("_at", "_rank"))


def stride_sample(df: DataFrame, keys: Sequence[str], order: str, maximum: int, width: int = 86400,
                  tie: Sequence[str] = ()) -> DataFrame:
    """Every k-th row in order, k the smallest step that leaves at most ``maximum``."""
    ranked = C.global_rank(df, keys, order, width, "_rank", tie)
    stride = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(maximum)), F.lit(1)).alias("_stride")
    joined = (ranked.join(df.groupBy(*keys).agg(stride), list(keys)) if keys
              else ranked.withColumn("_stride", df.agg(stride).scalar()))
    return joined.filter(F.pmod(F.col("_rank") - 1, F.col("_stride")) == 0).drop("_rank", "_stride")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark limits ranks before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def first_rows(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """The first ``n`` rows of all; each task keeps its own first, so no full sort is made."""
    return df.orderBy(*order).limit(n)


def next_id(df: DataFrame, id_col: str, out: str = "next_id") -> DataFrame:
    """One more than the greatest id, 1 for an empty table."""
    return df.agg((F.coalesce(F.max(id_col), F.lit(0)) + 1).alias(out))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return C.dedupe_last(df, keys, order)
