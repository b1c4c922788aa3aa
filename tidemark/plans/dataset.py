"""Labelled datasets, sequences and barrier targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clock, signals
from tidemark.functions.text import strict_bool
from tidemark.operators import chunks as C
from tidemark.operators import features, quality
from tidemark.operators.features import DatasetSpec


def prepared(bars: DataFrame, order: str | None = None, strict: bool = True) -> DataFrame:
    """Validated candles, one per (asset, ts)."""
    valid = quality.require_valid(bars) if strict else quality.quarantine(bars)[0]
    return quality.dedupe(valid, order)


def _eligible(rows: DataFrame, spec: DatasetSpec) -> DataFrame:
    keep = (F.col("history_candles") >= spec.eligible.history) & (
        F.col(f"observed_coverage_{max(spec.windows.coverage)}") >= spec.eligible.coverage)
    return rows.filter(keep).dropna(subset=list(spec.windows.columns))


def build_dataset(bars: DataFrame, spec: DatasetSpec = DatasetSpec()) -> DataFrame:
    """Decision rows: full history, observed, covered, all features and a label."""
    rows = _eligible(features.featured_bars(bars, spec), spec)
    return rows.filter("is_observed").filter(F.col("label").isNotNull())


def build_sequence_dataset(bars: DataFrame, spec: DatasetSpec = DatasetSpec()) -> DataFrame:
    """Context rows for sequences: filled bars stay, marked; labels may be missing."""
    return _eligible(features.featured_bars(bars, spec), spec)


def labelled_horizon(dataset: DataFrame, horizon: int) -> DataFrame:
    label, ret = f"label_{horizon}m", f"future_return_{horizon}m_pct"
    rows = dataset.filter(F.col(label).isNotNull() & F.col(ret).isNotNull())
    seen = f"future_observed_{horizon}m"
    if seen not in dataset.columns:
        return rows
    return rows.filter(F.coalesce(strict_bool(F.col(seen)), F.lit(False)))


def export_columns(horizons: Sequence[int], spec: DatasetSpec) -> list[str]:
    # Names and order of the export format.
    names = ["asset", "ts", "open", "high", "low", "close", "volume", "segment_id", "is_observed",
             "history_candles", *spec.windows.columns]
    for h in horizons:
        names += [f"future_close_{h}m", f"future_observed_{h}m", f"future_return_{h}m_pct", f"label_{h}m"]
    return [*names, "label"]


def select_for_export(dataset: DataFrame, horizons: Sequence[int], spec: DatasetSpec = DatasetSpec()) -> DataFrame:
    return dataset.select(*export_columns(horizons, spec))


def compile_domains(bars: DataFrame, domains: Sequence[Mapping], spec: DatasetSpec = DatasetSpec()) -> DataFrame:
    """Datasets of several markets in one plan, each labelled with its own cost.

    ``domains``: mappings with domain_id, exchange, market_symbol, quote_asset,
    round_trip_cost_pct and the ``asset`` they read. The list comes from
    configuration, so it becomes a literal lookup.
    """
    ids = [d["domain_id"] for d in domains]
    if not ids or len(set(ids)) != len(ids):
        raise ValueError("market domain ids must be given and unique")
    for d in domains:
        names = (d["domain_id"], d["exchange"], d["market_symbol"], d["quote_asset"])
        if any(not n or not n.replace("_", "").replace("-", "").isalnum() for n in names):
            raise ValueError("domain identifiers must be alphanumeric names")
        if d["round_trip_cost_pct"] < 0:
            raise ValueError("a domain cost must not be negative")
    lookup = F.create_map(*[x for d in domains for x in (F.lit(d["asset"]), F.struct(
        *[F.lit(d[k]).alias(k) for k in ("domain_id", "exchange", "market_symbol", "quote_asset")],
        F.lit(float(d["round_trip_cost_pct"])).alias("round_trip_cost_pct")))])
    rows = features.featured_bars(bars.filter(F.col("asset").isin(*[d["asset"] for d in domains])), spec)
    rows = rows.withColumn("_d", lookup[F.col("asset")]).select("*", "_d.*").drop("_d")
    edge = F.col("round_trip_cost_pct") + F.lit(spec.labels.edge_pct)
    for h in spec.labels.minutes:
        rows = rows.withColumn(f"label_{h}m", signals.direction_label(
            F.col(f"future_return_{h}m_pct"), F.col(f"future_observed_{h}m"), edge, spec.labels.only_observed))
    rows = rows.withColumn("label", F.col(f"label_{spec.labels.main}m"))
    return _eligible(rows, spec).filter("is_observed").filter(F.col("label").isNotNull())


def price_age(rows: DataFrame, width: int, keys: Sequence[str] = ("asset",), out: str = "price_age_minutes") -> DataFrame:
    """Minutes since the last observed bar."""
    seen = C.last_seen(rows, keys, "ts", F.when(F.col("is_observed"), F.col("ts")), width, "_seen")
    return seen.withColumn(out, (F.col("ts") - F.col("_seen")) / F.lit(60.0)).drop("_seen")


def build_slow_dataset(local: DataFrame, world: DataFrame, feature_columns: Sequence[str], *,
                       cadence_minutes: int = 15, horizons: Sequence[int] = (240, 1440),
                       actionable_move_pct: float = 0.25, maximum_price_age_minutes: int = 15,
                       world_returns: Sequence[int] = (15, 60, 240), gap_return: tuple[str, int] = ("return_60m_pct", 60),
                       width: int = 30 * 86400) -> DataFrame:
    """Decision rows on a slow cadence with returns of a second market.

    ``world`` carries the asset name of the local market it belongs to. Lookups
    of both markets are range frames inside halo partitions; the only join is the
    one-to-one join of the two markets.
    """
    if cadence_minutes <= 0 or not horizons or actionable_move_pct <= 0 or maximum_price_age_minutes < 0:
        raise ValueError("cadence, horizons and edge must be positive")
    if any(h <= 0 or h % cadence_minutes for h in horizons):
        raise ValueError("horizons must be multiples of the cadence")
    aged = price_age(local, width)
    rows = C.at_offsets(aged, ["asset"], "ts", ["close", "price_age_minutes"], [h * 60 for h in horizons], width)
    for h in horizons:
        fresh = F.coalesce(F.col(f"`price_age_minutes@{h * 60}`") <= maximum_price_age_minutes, F.lit(False))
        move = F.when(fresh, (F.col(f"`close@{h * 60}`") / F.col("close") - 1) * 100)
        rows = (rows.withColumn(f"future_observed_{h}m", fresh).withColumn(f"future_return_{h}m_pct", move)
                .withColumn(f"label_{h}m", signals.direction_label(
                    F.col(f"future_return_{h}m_pct"), F.lit(True), actionable_move_pct)))
    past = C.at_offsets(world.select("asset", "ts", "close", "is_observed"), ["asset"], "ts",
                        ["close", "is_observed"], [-m * 60 for m in world_returns], width)
    world_columns = []
    for m in world_returns:
        both = F.col("is_observed") & F.col(f"`is_observed@{-m * 60}`")
        world_columns.append(F.when(both, (F.col("close") / F.col(f"`close@{-m * 60}`") - 1) * 100)
                             .alias(f"global_return_{m}m_pct"))
    world_rows = quality.require_unique(past.select("asset", "ts", *world_columns), ["asset", "ts"])
    sampled = rows.filter(F.pmod("ts", F.lit(cadence_minutes * 60)) == 0)
    joined = sampled.join(world_rows, ["asset", "ts"])
    joined = joined.withColumns(clock.calendar(F.col("ts")))
    name, minutes = gap_return
    joined = joined.withColumn(f"cross_market_return_gap_{minutes}m_pct",
                               F.col(name) - F.col(f"global_return_{minutes}m_pct"))
    joined = joined.withColumn("is_observed", F.col("price_age_minutes") <= maximum_price_age_minutes)
    wanted = [*feature_columns, "utc_time_sin", "utc_time_cos", "utc_weekday_sin", "utc_weekday_cos",
              *[f"global_return_{m}m_pct" for m in world_returns], f"cross_market_return_gap_{minutes}m_pct"]
    kept = joined.dropna(subset=wanted).drop("segment_id")
    step = cadence_minutes * 60
    segmented = C.segment_ids(kept, ["asset"], "ts", lambda d: d.isNull() | (d != step), width, step)
    future = [f"{p}_{h}m{s}" for h in horizons
              for p, s in (("future_observed", ""), ("future_return", "_pct"), ("label", ""))]
    return segmented.select("asset", "ts", "segment_id", "is_observed", "close", *wanted, *future)


def contiguous_segments(rows: DataFrame, tf: int, width: int, keys: Sequence[str] = ("asset",),
                        out: str = "segment_id") -> DataFrame:
    """New segment whenever the step is not exactly one bar."""
    rows = rows.drop(out)
    return C.segment_ids(rows, keys, "ts", lambda d: d.isNull() | (d != tf), width, tf, out)


def sequence_ends(rows: DataFrame, length: int, stride: int, tf: int, width: int,
                  keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Rows ending a gap-free run of ``length`` bars, every ``stride``-th of them."""
    if length <= 0 or stride <= 0:
        raise ValueError("sequence settings must be positive")
    halo = C.with_halo(rows, "ts", width, (length - 1) * tf)
    w = C.chunk_window(keys, ["ts"])
    full = F.lit(True) if length == 1 else F.lag("ts", length - 1).over(w) == F.col("ts") - (length - 1) * tf
    ends = halo.withColumn("_full", full).filter(F.col("_full") & F.col(C.OWN)).drop("_full", C.OWN, C.CHUNK)
    ranked = C.global_rank(ends, keys, "ts", width, "_rank")
    return ranked.filter(F.pmod(F.col("_rank") - 1, F.lit(stride)) == 0).drop("_rank")


def sequence_tensors(rows: DataFrame, feature_columns: Sequence[str], length: int, stride: int, tf: int,
                     width: int, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Ends with the last ``length`` feature vectors (float) as a nested array."""
    halo = C.with_halo(rows, "ts", width, (length - 1) * tf)
    vector = F.array(*[F.col(c).cast("float") for c in feature_columns])
    w = C.chunk_window(keys, ["ts"]).rowsBetween(-(length - 1), 0)
    full = halo.withColumn("sequence", F.collect_list(vector).over(w)).filter(F.col(C.OWN)).select(*keys, "ts", "sequence")
    ends = sequence_ends(rows, length, stride, tf, width, keys)
    return full.join(ends.select(*keys, "ts"), [*keys, "ts"], "left_semi")


def barrier_labels(rows: DataFrame, horizons: Sequence[int], barrier_pct: float | Sequence[float], tf: int,
                   width: int, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """First-touch labels per horizon (in bars): -1 invalid, 0 sell, 1 hold, 2 buy.

    Needs regular bars with ``is_observed``. The path must be contiguous and fully
    observed; both barriers touched by the same bar make the label invalid.
    """
    pcts = [float(barrier_pct)] * len(horizons) if isinstance(barrier_pct, (int, float)) else [float(x) for x in barrier_pct]
    if not horizons or min(horizons) <= 0 or len(pcts) != len(horizons) or min(pcts) <= 0:
        raise ValueError("horizons and barriers must be positive and match")
    longest = max(horizons)
    halo = C.with_halo(rows, "ts", width, 0, longest * tf + 1)
    w = C.chunk_window(keys, ["ts"])
    ahead = halo.withColumn("_path", F.collect_list(F.struct("high", "low")).over(w.rowsBetween(1, longest)))
    for h in horizons:
        ahead = ahead.withColumn(f"_ok{h}", F.coalesce(
            F.col("is_observed") & (F.lead("ts", h).over(w) == F.col("ts") + h * tf)
            & (F.sum(F.col("is_observed").cast("int")).over(w.rowsBetween(1, h)) == h), F.lit(False)))
    own = ahead.filter(F.col(C.OWN))
    entries = []
    for h, pct in zip(horizons, pcts):
        up, down = F.col("close") * (1 + pct / 100), F.col("close") * (1 - pct / 100)
        path = F.slice("_path", 1, h)
        first_up = F.array_position(F.transform(path, lambda b: b["high"] >= up), True)
        first_down = F.array_position(F.transform(path, lambda b: b["low"] <= down), True)
        label = (F.when(~F.col(f"_ok{h}"), -1)
                 .when((first_up == 0) & (first_down == 0), 1)
                 .when(first_up == first_down, -1)
                 .when((first_down == 0) | ((first_up > 0) & (first_up < first_down)), 2)
                 .otherwise(0))
        entries.append(F.struct(F.lit(h).alias("horizon"), label.cast("tinyint").alias("label")))
    return own.select(*keys, "ts", F.inline(F.array(*entries)))


def observed_targets(ends: DataFrame, horizons: Sequence[int], labels: Sequence[str]) -> DataFrame:
    """Sequence ends that are observed with finite targets and valid classes."""
    keep = F.col("is_observed")
    for h in horizons:
        r = F.col(f"future_return_{h}m_pct")
        keep = keep & r.isNotNull() & ~F.isnan(r)
    for c in labels:
        keep = keep & F.col(c).isin("BUY", "HOLD", "SELL")
    return ends.filter(keep)


def dataset_summary(dataset: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, first and last timestamp and label counts."""
    return dataset.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        *[F.count_if(F.col("label") == x).alias(f"label_{x.lower()}") for x in ("BUY", "HOLD", "SELL")])


def readiness(dataset: DataFrame, horizon: int, coverage: str, *, minimum_rows: int = 30_000,
              minimum_days: int = 30, minimum_per_label: int = 1_000, minimum_coverage: float = 0.80,
              days_width: int = 86400) -> DataFrame:
    """Gate rows (check, passed, actual, required) before fitting a model."""
    label = F.col(f"label_{horizon}m")
    # Days and segments are counted from distinct values, combined map-side.
    base = dataset.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(label == x).alias(x) for x in ("BUY", "HOLD", "SELL")],
        F.avg(coverage).alias("coverage"),
        F.countDistinct(F.floor(F.col("ts") / days_width)).alias("days"),
        F.countDistinct("asset", "segment_id").alias("segments"))
    least = F.least("BUY", "HOLD", "SELL")
    gates = [
        ("minimum_rows", F.col("rows"), minimum_rows), ("minimum_calendar_days", F.col("days"), minimum_days),
        ("minimum_rows_per_label", least, minimum_per_label),
        ("minimum_mean_coverage", F.coalesce("coverage", F.lit(0.0)), minimum_coverage),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), (v >= F.lit(r)).alias("passed"),
                              F.round(v.cast("double"), 6).alias("actual"), F.lit(float(r)).alias("required"))
                     for n, v, r in gates])
    return base.select("segments", F.inline(rows))
