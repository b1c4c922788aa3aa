"""Sliding regime windows, non-overlapping selection and campaign plans."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import chunks as C
from tidemark.operators import select
from tidemark.plans.splits import fingerprint

REGIMES = ("UPTREND", "DOWNTREND", "SIDEWAYS")
EXPECTED = {"UPTREND": "BUY", "DOWNTREND": "SELL", "SIDEWAYS": "HOLD"}


def move_regime(move: Column, trend: float, sideways: float) -> Column:
    return (F.when(move >= trend, "UPTREND").when(move <= -trend, "DOWNTREND")
            .when(F.abs(move) <= sideways, "SIDEWAYS").otherwise("MIXED"))


def sliding_windows(bars: DataFrame, *, window: int, stride: int, bar: int, trend_pct: float, sideways_pct: float,
                    min_coverage_pct: float, width: int) -> DataFrame:
    """Windows ``[s, s + window]`` (both ends closed) from the first bar in steps of ``stride``.

    Each bar is copied to its ``window/stride`` windows and the copies are
    combined map-side. A return counts where the bar before lies inside too.
    """
    least = max(2, int(window / bar * (min_coverage_pct / 100.0)))
    halo = C.with_halo(bars.select("asset", "ts", "close"), "ts", width, window)
    w = C.chunk_window(["asset"], ["ts"])
    rows = (halo.withColumn("_pt", F.lag("ts").over(w)).withColumn("_pc", F.lag("close").over(w))
            .filter(F.col(C.OWN)).withColumn("_r", (F.col("close") / F.col("_pc") - 1) * 100))
    span = bars.groupBy("asset").agg(F.min("ts").alias("_a"), F.max("ts").alias("_z"))
    rows = rows.join(span, "asset")
    offset = F.col("ts") - F.col("_a")
    low = F.greatest(F.ceil((offset - window) / stride), F.lit(0)).cast("bigint")
    high = F.least(F.floor(offset / stride), F.floor((F.col("_z") - F.col("_a") - window) / stride)).cast("bigint")
    copies = rows.filter(low <= high).withColumn("_s", F.explode(F.sequence(low, high)))
    start = F.col("_a") + F.col("_s") * stride
    inner = F.when(F.col("_pt") >= start, F.col("_r"))
    stats = copies.groupBy("asset", start.alias("nominal_start")).agg(
        F.count(F.lit(1)).alias("candles"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.min_by("close", "ts").alias("start_price"), F.max_by("close", "ts").alias("end_price"),
        F.stddev_pop(inner).alias("_vol"))
    move = F.round(F.try_divide(F.col("end_price") - F.col("start_price"), F.col("start_price")) * 100, 4)
    return (stats.filter(F.col("candles") >= least).withColumn("move_pct", F.coalesce(move, F.lit(0.0)))
            .withColumn("volatility_pct", F.round(F.coalesce("_vol", F.lit(0.0)), 4))
            .withColumn("label", move_regime(F.col("move_pct"), trend_pct, sideways_pct)).drop("_vol"))


def _strength(regime: str) -> list:
    """Ranking of the candidates of a regime, strongest first."""
    move, vol = F.col("move_pct"), F.col("volatility_pct")
    return {
        "UPTREND": [-move, -vol], "DOWNTREND": [move, -vol], "SIDEWAYS": [F.abs(move), vol],
        "HIGH_VOLATILITY": [-vol, -F.abs(move)],
    }[regime]


def _by_regime(parts: int, table) -> list[Column]:
    """Sort columns that depend on the label of the row."""
    out = []
    for i in range(parts):
        column = F.lit(None).cast("double")
        for regime in REGIMES:
            column = F.when(F.col("label") == regime, table(regime)[i]).otherwise(column)
        out.append(column)
    return out


def regime_examples(windows: DataFrame, n: int) -> DataFrame:
    """Top ``n`` windows of each regime by its own ranking."""
    rows = windows.filter(F.col("label").isin(*REGIMES))
    return select.top_per_key(rows, ["asset", "label"], [*_by_regime(2, _strength), F.col("start_ts")], n)


def _spread_order(regime: str) -> list:
    move, vol = F.abs(F.col("move_pct")), F.col("volatility_pct")
    return [vol, move] if regime == "SIDEWAYS" else [move, vol]


def _places(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Adds ``_place`` (from 0) in ``order`` and the rows ``_n`` of each key, from counts of narrow ranges of the first column."""
    size = F.floor(F.log1p(F.abs(order[0]) * F.lit(1e6)) * F.lit(64.0))
    rows = df.withColumn(C.CHUNK, (F.signum(order[0]) * size).cast("bigint"))
    counts = rows.groupBy(*keys, C.CHUNK).agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*keys)
    before = counts.select(*keys, C.CHUNK, F.sum("_rows").over(whole).alias("_n"),
                           F.coalesce(F.sum("_rows").over(whole.orderBy(C.CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = rows.withColumn("_local", F.row_number().over(C.chunk_window(keys, order)))
    return local.join(before, [*keys, C.CHUNK]).withColumn("_place", F.col("_before") + F.col("_local") - 1).drop("_before", "_local", C.CHUNK)


def select_windows(windows: DataFrame, per_regime: int, *, window: int, stride: int, strategy: str = "extreme",
                   high_volatility: bool = False) -> DataFrame:
    """Greedy non-overlapping picks across regimes, one shared set of used windows.

    A pick blocks at most ``2*window/stride + 1`` candidates, so the k-th pick of
    a list is among its first ``(all picks) * blocked + k`` entries. Only these
    bounded list heads reach the per-asset fold, and the result is exact. Heads
    are cut before rows are shuffled; places in bands come from counts of value
    ranges, so no task ranks a whole regime.
    """
    if per_regime <= 0 or strategy not in ("extreme", "stratified"):
        raise ValueError("per_regime must be positive and the strategy known")
    head = 4 * per_regime * (2 * -(-window // stride) + 1) + per_regime
    lanes = windows.filter(F.col("label").isin(*REGIMES)).withColumn("regime", F.col("label"))
    sort = _by_regime(2, _strength if strategy == "extreme" else _spread_order)
    top = lambda df, keys, order: select.top_per_key(df, keys, order, head).withColumn("rank", F.col("rank") - 1).withColumn("lane", F.lit(per_regime))
    lists = [top(lanes, ["asset", "regime"], [*sort, F.col("start_ts")])]
    if strategy == "stratified":
        # Bands of equal share, each searched from its middle outwards.
        counted = _places(lanes, ["asset", "regime"], [*sort, F.col("start_ts")])
        k = F.lit(per_regime)
        band = F.floor(((F.col("_place") + 1) * k - 1) / F.col("_n")).cast("bigint")
        counted = counted.withColumn("lane", band.cast("int"))
        start = F.floor(F.col("lane") * F.col("_n") / k)
        middle = (F.floor((F.col("lane") + 1) * F.col("_n") / k) - start - 1) / 2
        away = F.col("_place") - start - middle
        # The nearest to the middle is first, of two equally near ones the earlier.
        bands = counted.withColumn("rank", F.when(away < 0, -2 * away - 1).otherwise(2 * away).cast("int")).filter(F.col("rank") < head)
        lists.append(bands.select(*lists[0].columns))
    if high_volatility:
        wild = windows.withColumn("regime", F.lit("HIGH_VOLATILITY"))
        lists.append(top(wild, ["asset"], [*_strength("HIGH_VOLATILITY"), F.col("start_ts")]).select(*lists[0].columns))
    candidates = lists[0]
    for extra in lists[1:]:
        candidates = candidates.unionByName(extra)
    order = {r: i for i, r in enumerate((*REGIMES, "HIGH_VOLATILITY"))}
    columns = ["asset", "regime", "label", "start_ts", "end_ts", "start_price", "end_price", "move_pct",
               "volatility_pct", "candles"]
    slim = candidates.select(*columns, "lane", "rank")
    schema = slim.select(*columns).schema.simpleString()[len("struct<"):-1] + ",pick:int"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_o=pdf["regime"].map(order)).sort_values(["_o", "lane", "rank"])
        used, chosen, counts, filled = [], [], {}, set()
        for row in pdf.itertuples(index=True):
            slot = (row.regime, row.lane)
            # A band yields one pick, the ranked list fills up to the quota.
            if counts.get(row.regime, 0) >= per_regime or slot in filled:
                continue
            if any(row.start_ts <= e and s <= row.end_ts for s, e in used):
                continue
            used.append((row.start_ts, row.end_ts))
            counts[row.regime] = counts.get(row.regime, 0) + 1
            if row.lane < per_regime:
                filled.add(slot)
            chosen.append((row.Index, counts[row.regime]))
        out = pdf.loc[[i for i, _ in chosen], columns].copy()
        out["pick"] = [p for _, p in chosen]
        return out

    return slim.groupBy("asset").applyInPandas(pick, schema)


def frozen_plan(picks: DataFrame, points: DataFrame, cycles: int, step: int, width: int = 86400) -> DataFrame:
    """Picked windows with ids, expected actions and decision timestamps."""
    lookup = F.create_map(*[F.lit(x) for pair in EXPECTED.items() for x in pair])
    named = picks.withColumn("window_id", F.format_string("%s-%02d", F.lower("regime"), F.col("pick")))
    named = named.withColumn("expected_action", F.try_element_at(lookup, F.col("regime")))
    spaced = select.spaced_timestamps(points, named, cycles, step, width)
    stamps = spaced.groupBy("asset", "window_id").agg(F.array_sort(F.collect_list("ts")).alias("cycle_timestamps"))
    return named.join(stamps, ["asset", "window_id"], "left").drop("pick")


def plan_fingerprint(plan: DataFrame, config: str) -> DataFrame:
    """Fingerprint of configuration and frozen windows per asset."""
    text = plan.withColumn("config", F.lit(config)).withColumn("stamps", F.array_join(F.col("cycle_timestamps").cast("array<string>"), ","))
    return fingerprint(text, ["asset"], ["config", "window_id", "regime", "start_ts", "end_ts", "stamps"])


def stratified_samples(bars: DataFrame, samples: int, *, spacing: int = 32, trend_pct: float = 1.0,
                       sideways_pct: float = 0.2, width: int = 30 * 86400) -> DataFrame:
    """Every ``spacing``-th bar classed by its move ``spacing`` bars later, spread per stratum.

    Up, down and sideways share the quota; mixed rows fill what is missing.
    """
    if samples <= 0:
        raise ValueError("samples must be positive")
    ranked = C.global_rank(bars.select("asset", "ts", "close"), ["asset"], "ts", width)
    picked = ranked.filter((F.col("rank") >= spacing) & (F.pmod(F.col("rank"), F.lit(spacing)) == 0))
    later = ranked.select("asset", (F.col("rank") - spacing).alias("rank"), F.col("ts").alias("future_ts"),
                          F.col("close").alias("future_close"))
    rows = picked.join(later, ["asset", "rank"])
    move = F.coalesce(F.try_divide(F.col("future_close") - F.col("close"), F.col("close")) * 100, F.lit(0.0))
    rows = rows.withColumn("future_move_pct", move).withColumn("regime", move_regime(F.col("future_move_pct"), trend_pct, sideways_pct))
    base = samples // 3
    quota = {r: base + (1 if i < samples - 3 * base else 0) for i, r in enumerate(REGIMES)}
    chosen = None
    for regime, k in quota.items():
        part = select.spread_evenly(rows.filter(F.col("regime") == regime), ["asset"], "ts", k, width)
        chosen = part if chosen is None else chosen.unionByName(part)
    have = chosen.groupBy("asset").agg(F.count(F.lit(1)).alias("_have"))
    mixed = rows.filter(F.col("regime") == "MIXED").join(have, "asset", "left")
    mixed = mixed.withColumn("_want", F.lit(samples) - F.coalesce("_have", F.lit(0)))
    ranked_mixed = C.global_rank(mixed, ["asset"], "ts", width, "_r")
    sizes = mixed.groupBy("asset").agg(F.count(F.lit(1)).alias("_size"))
    filler = ranked_mixed.join(sizes, "asset")
    at, size, k = F.col("_r") - 1, F.col("_size"), F.least("_want", "_size")
    # Place i of k lies at floor(i * (n-1)/(k-1)), the last one at n-1: only two i can fall on a row.
    step = (size - 1) / F.nullif(k - 1, F.lit(0)).cast("double")
    near = F.floor(F.try_divide(at, step)).cast("bigint")
    falls = lambda i: (i >= 0) & (i < k - 1) & (F.floor(i * step) == at)
    taken = F.when(k == 1, at == 0).otherwise((at == size - 1) | F.coalesce(falls(near) | falls(near + 1) | falls(near - 1), F.lit(False)))
    filler = filler.filter((k > 0) & taken)
    return chosen.unionByName(filler.select(*chosen.columns))
