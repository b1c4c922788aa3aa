"""Cutting one long series into time chunks.

``Window.partitionBy(asset)`` puts a whole series on one task. The helpers here
key the work by ``(asset, time chunk)`` instead. Two patterns cover everything:

* halo: a row is copied into the neighbouring chunks that need it as context,
  so every bounded window is exact inside its chunk;
* carry: unbounded state (counts, running sums, last values) is reduced to one
  row per chunk, scanned over that small table, and joined back on the same
  ``(asset, chunk)`` key the rows are already hashed by.

The chunk table has (time span / chunk length) rows per asset, whatever the
number of rows inside the chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
OWN = "_own"


def bucket(value: Column, width: int) -> Column:
    """Integer bucket of a BIGINT column, right for negative values too."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("bigint")


def with_chunk(df: DataFrame, ts: str, width: int) -> DataFrame:
    return df.withColumn(CHUNK, bucket(F.col(ts), width))


def with_halo(df: DataFrame, ts: str, width: int, back: int, ahead: int = 0) -> DataFrame:
    """Copy each row into every chunk whose context window covers it.

    Chunk ``c`` sees ``[c*width - back, (c+1)*width + ahead)``; ``_own`` marks
    the one copy that belongs to the chunk.
    """
    t = F.col(ts)
    copies = F.sequence(bucket(t - F.lit(ahead), width), bucket(t + F.lit(back), width))
    return df.withColumn(CHUNK, F.explode(copies)).withColumn(OWN, bucket(t, width) == F.col(CHUNK))


def chunk_window(keys: Sequence[str], order: Sequence, *extra: str):
    return Window.partitionBy(*keys, CHUNK, *extra).orderBy(*order)


def carry(chunks: DataFrame, keys: Sequence[str], columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Exclusive prefix over a one-row-per-chunk table.

    ``columns`` maps output name to ``(input column, kind)`` with kind one of
    ``sum``, ``max``, ``min``, ``last`` (last non-null), ``product``.
    """
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    kinds = {
        "sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)),
        "max": lambda c: F.max(c).over(before),
        "min": lambda c: F.min(c).over(before),
        "last": lambda c: F.last(c, ignorenulls=True).over(before),
        "product": lambda c: F.coalesce(F.product(c).over(before), F.lit(1.0)),
    }
    out = [kinds[kind](F.col(source)).alias(name) for name, (source, kind) in columns.items()]
    return chunks.select(*keys, CHUNK, *out)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key: the newest (or oldest) by ``order``; combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    packed = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return packed.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int, out: str,
                tie: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sum in ``order``, one task per (key, chunk)."""
    rows = with_chunk(df, order, width)
    totals = rows.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_total"))
    before = carry(totals, keys, {"_before": ("_total", "sum")})
    w = chunk_window(keys, [order, *tie]).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return (local.join(before, [*keys, CHUNK], "left")
            .withColumn(out, F.col("_local") + F.coalesce("_before", F.lit(0)))
            .drop("_local", "_before", CHUNK))


def global_rank(df: DataFrame, keys: Sequence[str], order: str, width: int, out: str = "rank",
                tie: Sequence[str] = ()) -> DataFrame:
    """1-based position in ``order`` within ``keys`` without one big sort."""
    rows = with_chunk(df, order, width)
    counts = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    before = carry(counts, keys, {"_before": ("_n", "sum")})
    local = rows.withColumn("_local", F.row_number().over(chunk_window(keys, [order, *tie])))
    return (local.join(before, [*keys, CHUNK], "left")
            .withColumn(out, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint"))
            .drop("_local", "_before", CHUNK))


def segment_ids(df: DataFrame, keys: Sequence[str], ts: str, is_start, width: int, back: int,
                out: str = "segment_id", start_out: str | None = None) -> DataFrame:
    """Gaps-and-islands ids (from 0) with ``is_start(step)`` deciding a break.

    ``step`` is the distance to the previous row, null when there is none
    within ``back`` seconds; the first row of a key must come out as a start.
    """
    rows = with_halo(df, ts, width, back)
    w = chunk_window(keys, [ts])
    step = F.col(ts) - F.lag(ts).over(w)
    flagged = rows.withColumn("_start", is_start(step)).filter(F.col(OWN))
    totals = flagged.groupBy(*keys, CHUNK).agg(
        F.sum(F.col("_start").cast("bigint")).alias("_n"),
        F.max(F.when(F.col("_start"), F.col(ts))).alias("_last"),
    )
    before = carry(totals, keys, {"_before": ("_n", "sum"), "_open": ("_last", "last")})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    local = (flagged
             .withColumn("_local", F.sum(F.col("_start").cast("bigint")).over(run))
             .withColumn("_seen", F.max(F.when(F.col("_start"), F.col(ts))).over(run)))
    joined = local.join(before, [*keys, CHUNK], "left").withColumn(
        out, F.col("_local") + F.coalesce("_before", F.lit(0)) - F.lit(1))
    if start_out:
        joined = joined.withColumn(start_out, F.coalesce("_seen", "_open"))
    return joined.drop("_local", "_before", "_open", "_seen", "_start", CHUNK, OWN)


#: Accuracy of the sketch that brackets a rank: its error is one part in so many rows.
SKETCH = 10_000


def exact_order_values(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float],
                       rank: str = "linear") -> DataFrame:
    """Exact quantiles per key: a sketch brackets each rank, then counts find it.

    ``linear`` interpolates between the two neighbouring ranks; ``nearest``
    takes rank ``round((n-1)*q)`` with ties to even. A mergeable sketch gives two
    values that the wanted rank surely lies between, a few parts in ten thousand
    of the rows apart. Rows below are counted, and only distinct values between
    the two are ordered, so a group is spread over all tasks whether its values
    are wide or close together.
    """
    if not keys:
        return exact_order_values(df.withColumn("_all", F.lit(0)), ["_all"], value, fractions, rank).drop("_all")
    v = F.col(value)
    rows = df.filter(v.isNotNull()).select(*keys, v.alias("_v"))
    wide = 3.0 / SKETCH
    asked = [min(max(float(q) + s * wide, 0.0), 1.0) for q in fractions for s in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), F.percentile_approx("_v", asked, SKETCH).alias("_ends"))
    low = lambda i: F.get("_ends", F.lit(2 * i))
    high = lambda i: F.get("_ends", F.lit(2 * i + 1))
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    known = counts.join(sketch, list(keys))
    below = known.groupBy(*keys).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("_v") < low(i), F.col("_n"))), F.lit(0)) for i in range(len(fractions))]).alias("_below"))
    lanes = F.array(*[F.when(F.col("_v").between(low(i), high(i)), F.struct(F.lit(i).alias("_lane"), F.lit(float(q)).alias("fraction"))) for i, q in enumerate(fractions)])
    near = known.withColumn("_hit", F.explode(F.filter(lanes, lambda x: x.isNotNull()))).select(*keys, "_v", "_n", "_total", "_hit.*")
    near = near.join(below, list(keys))
    inside = Window.partitionBy(*keys, "fraction").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = near.withColumn("_low", F.get("_below", F.col("_lane")) + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    spot = (F.col("_total") - 1) * F.col("fraction")
    holds = lambda r: (r >= F.col("_low")) & (r < F.col("_low") + F.col("_n"))
    if rank == "nearest":
        return placed.filter(holds(F.bround(spot, 0))).groupBy(*keys, "fraction").agg(F.max("_v").alias("quantile"))
    picked = placed.filter(holds(F.floor(spot)) | holds(F.ceil(spot)))
    lo = F.max(F.when(holds(F.floor(spot)), F.col("_v")))
    hi = F.max(F.when(holds(F.ceil(spot)), F.col("_v")))
    share = F.max(spot - F.floor(spot))
    return picked.groupBy(*keys, "fraction").agg((lo + (hi - lo) * share).alias("quantile"))


def previous_row(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], width: int) -> DataFrame:
    """Add ``prev_<col>`` of the row before, however far back it lies."""
    rows = with_chunk(df, ts, width)
    entry = F.struct(*[F.col(c).alias(c) for c in cols])
    lasts = rows.groupBy(*keys, CHUNK).agg(F.max_by(entry, F.col(ts)).alias("_last"))
    before = carry(lasts, keys, {"_open": ("_last", "last")})
    near = rows.withColumn("_near", F.lag(entry).over(chunk_window(keys, [ts])))
    out = near.join(before, [*keys, CHUNK], "left").withColumn("_prev", F.coalesce("_near", "_open"))
    return out.withColumns({f"prev_{c}": F.col(f"_prev.{c}") for c in cols}).drop("_near", "_open", "_prev", CHUNK)


def last_seen(df: DataFrame, keys: Sequence[str], ts: str, value: Column, width: int, out: str) -> DataFrame:
    """Newest non-null ``value`` at or before each row, however far back."""
    rows = with_chunk(df, ts, width).withColumn("_value", value)
    lasts = rows.groupBy(*keys, CHUNK).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(ts))).alias("_last"))
    before = carry(lasts, keys, {"_open": ("_last", "last")})
    run = chunk_window(keys, [ts]).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_near", F.last("_value", ignorenulls=True).over(run))
    return (near.join(before, [*keys, CHUNK], "left").withColumn(out, F.coalesce("_near", "_open"))
            .drop("_near", "_open", "_value", CHUNK))


def at_offsets(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], offsets: Sequence[int],
               width: int) -> DataFrame:
    """Columns ``<col>@<offset>`` read at exactly ``ts + offset``; one shuffle, no join.

    Needs one row per (keys, ts). A range frame of a single instant inside the
    halo partition is an exact-time lookup.
    """
    back, ahead = max(0, -min(offsets)), max(0, max(offsets))
    rows = with_halo(df, ts, width, back, ahead + 1)
    base = Window.partitionBy(*keys, CHUNK).orderBy(ts)
    extra = {f"{c}@{o}": F.max(c).over(base.rangeBetween(o, o)) for c in cols for o in offsets}
    return rows.withColumns(extra).filter(F.col(OWN)).drop(CHUNK, OWN)


def rows_at_positions(df: DataFrame, keys: Sequence[str], ts: str, positions: Column, width: int) -> DataFrame:
    """Timestamps at 0-based positions of the ordered series.

    ``positions`` is an array column over the total ``n`` (column ``_n_total``).
    Only the chunks that hold a wanted position are ranked; finding them takes
    counts per chunk.
    """
    rows = with_chunk(df.select(*keys, ts), ts, width)
    counts = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(*keys, CHUNK, "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(whole).alias("_n_total"))
    # Positions of other chunks go before rows are made of them.
    mine = F.filter(positions, lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_n")))
    wanted = placed.withColumn("position", F.explode(mine))
    inside = rows.join(wanted.groupBy(*keys, CHUNK).agg(F.collect_set(
        F.struct(F.col("position"), (F.col("position") - F.col("_before")).alias("at"))).alias("_wanted")), [*keys, CHUNK])
    ranked = inside.withColumn("_at", F.row_number().over(chunk_window(keys, [ts])) - 1)
    return (ranked.select(*keys, ts, "_at", F.inline("_wanted")).filter(F.col("_at") == F.col("at"))
            .select(*keys, "position", ts))


def pin(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a costly column that later steps read several times.

    Plain projections are merged, and filters on them pushed down, which would
    evaluate a long fold once per use; a one-element explode is left alone.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))
