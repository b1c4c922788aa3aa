"""Scores of predictions, probabilities, forecasts and trade lists."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import signals
from tidemark.operators import chunks as C
from tidemark.operators import select

LABELS = ("BUY", "HOLD", "SELL")


def share(top: Column, bottom: Column, empty=0.0) -> Column:
    """Quotient, or ``empty`` where the denominator is zero."""
    return F.coalesce(F.try_divide(top.cast("double"), F.nullif(bottom.cast("double"), F.lit(0.0))),
                      F.lit(empty).cast("double"))


def equity_curve(trades: DataFrame, keys: Sequence[str], ts: str = "ts", ret: str = "net_return_pct",
                 width: int = 30 * 86400, tie: Sequence[str] = ()) -> DataFrame:
    """Running equity, running peak and drawdown per row.

    Equity is the running product of ``1 + r/100``; the peak starts at the first
    equity value. Products and peaks of earlier chunks come from chunk tables.
    """
    order = [ts, *tie]
    rows = C.with_chunk(trades, ts, width).withColumn("_g", F.lit(1.0) + F.col(ret) / F.lit(100.0))
    run = C.chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    factors = rows.groupBy(*keys, C.CHUNK).agg(F.product("_g").alias("_p"))
    scale = C.carry(factors, keys, {"_scale": ("_p", "product")})
    grown = (rows.withColumn("_local", F.product("_g").over(run))
             .join(scale, [*keys, C.CHUNK])
             .withColumn("equity", F.col("_scale") * F.col("_local")))
    tops = grown.groupBy(*keys, C.CHUNK).agg(F.max("equity").alias("_top"))
    peaks = C.carry(tops, keys, {"_peak": ("_top", "max")})
    out = (grown.withColumn("_near", F.max("equity").over(run)).join(peaks, [*keys, C.CHUNK])
           .withColumn("peak", F.greatest("_near", "_peak")))
    return (out.withColumn("drawdown_pct", (F.try_divide(F.col("equity"), F.col("peak")) - 1) * 100)
            .drop("_g", "_local", "_scale", "_near", "_peak", C.CHUNK))


def trade_summary(trades: DataFrame, keys: Sequence[str], ts: str = "ts", ret: str = "net_return_pct",
                  width: int = 30 * 86400) -> DataFrame:
    curve = equity_curve(trades, keys, ts, ret, width)
    return curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg((F.col(ret) > 0).cast("double")).alias("win_rate_after_cost"),
        F.avg(ret).alias("average_trade_return_pct"),
        ((F.product(F.lit(1.0) + F.col(ret) / 100.0) - 1) * 100).alias("compounded_return_pct"),
        F.min("drawdown_pct").alias("maximum_drawdown_pct"))


def confusion(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    return df.groupBy(*keys, actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def classification(df: DataFrame, keys: Sequence[str], actual: str, predicted: str,
                   classes: Sequence[str] = LABELS) -> DataFrame:
    """Accuracy and macro precision, recall and F1 (0 for an empty class)."""
    cells = confusion(df, keys, actual, predicted)
    a, p, n = F.col(actual).cast("string"), F.col(predicted).cast("string"), F.col("n")
    aggs = [F.sum("n").alias("rows"), share(F.sum(F.when(a == p, n).otherwise(0)), F.sum("n")).alias("accuracy")]
    for i, c in enumerate(map(str, classes)):
        hit = F.sum(F.when((a == c) & (p == c), n).otherwise(0))
        aggs += [share(hit, F.sum(F.when(p == c, n).otherwise(0))).alias(f"_p{i}"),
                 share(hit, F.sum(F.when(a == c, n).otherwise(0))).alias(f"_r{i}")]
    k = len(classes)
    mean = lambda cols: sum(cols[1:], cols[0]) / F.lit(float(k))
    ps, rs = [F.col(f"_p{i}") for i in range(k)], [F.col(f"_r{i}") for i in range(k)]
    f1 = [share(2 * x * y, x + y) for x, y in zip(ps, rs)]
    whole = cells.groupBy(*keys).agg(*aggs)
    return whole.select(*keys, "rows", "accuracy", mean(ps).alias("macro_precision"),
                        mean(rs).alias("macro_recall"), mean(f1).alias("macro_f1"))


def probability_metrics(scores: DataFrame, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Metrics of three logits (sell, hold, buy) against ``actual`` in 0..2.

    Sums are taken per confidence bin first, so the second grouping sees at most
    ten rows per key.
    """
    c = F.col
    p = signals.softmax3(c("sell"), c("hold"), c("buy"))
    rows = (scores.withColumn("_p", p).withColumn("_pred", signals.argmax3(c("sell"), c("hold"), c("buy")))
            .withColumn("_conf", F.array_max("_p")).withColumn("_true", F.get("_p", c("actual"))))
    rows = rows.withColumn("_bin", F.ceil(c("_conf") * 10))
    brier = F.lit(0.0)
    for i in range(3):
        brier = brier + F.pow(c("_p")[i] - (c("actual") == i).cast("double"), 2)
    count = lambda cond: F.sum(cond.cast("bigint"))
    correct = c("_pred") == c("actual")
    aggs = [F.count(F.lit(1)).alias("n"), count(correct).alias("hit"), F.sum("_conf").alias("conf"),
            F.sum(-F.log(F.least(F.greatest(c("_true"), F.lit(1e-12)), F.lit(1.0)))).alias("nll"),
            F.sum(brier).alias("brier"), count(c("actual") == 1).alias("hold"),
            count(c("_pred") != 1).alias("acts"), count(c("actual") != 1).alias("moves")]
    for i in range(3):
        aggs += [count(correct & (c("actual") == i)).alias(f"tp{i}"), count(c("_pred") == i).alias(f"ch{i}"),
                 count(c("actual") == i).alias(f"tr{i}")]
    bins = rows.groupBy(*keys, "_bin").agg(*aggs)
    total = F.sum("n")
    sums = {x: F.sum(x) for x in ("hit", "nll", "brier", "hold", "acts", "moves",
                                  *[f"{k}{i}" for k in ("tp", "ch", "tr") for i in range(3)])}
    whole = bins.groupBy(*keys).agg(
        total.alias("n"), F.sum(F.abs(c("hit") - c("conf"))).alias("gap"),
        *[v.alias(k) for k, v in sums.items()])
    # A class nobody chose scores zero: the denominator is at least one.
    prec = [c(f"tp{i}") / F.greatest(c(f"ch{i}"), F.lit(1)) for i in range(3)]
    rec = [c(f"tp{i}") / F.greatest(c(f"tr{i}"), F.lit(1)) for i in range(3)]
    f1 = [share(2 * x * y, x + y) for x, y in zip(prec, rec)]
    per = lambda name: c(name) / c("n")
    names = ("sell", "hold", "buy")
    return whole.select(
        *keys, per("hit").alias("accuracy"), ((rec[0] + rec[1] + rec[2]) / 3).alias("balanced_accuracy"),
        ((f1[0] + f1[1] + f1[2]) / 3).alias("macro_f1"), per("hold").alias("always_hold_accuracy"),
        per("acts").alias("predicted_action_rate"), per("moves").alias("actual_action_rate"),
        *[x.alias(f"{n}_precision") for n, x in zip(names, prec)],
        *[x.alias(f"{n}_recall") for n, x in zip(names, rec)],
        per("nll").alias("negative_log_likelihood"), per("brier").alias("multiclass_brier"),
        per("gap").alias("expected_calibration_error"))


def quantile_metrics(df: DataFrame, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Forecast quality of ordered quantiles ``q`` (low, median, high) against ``ret``."""
    low, mid, high = (F.get("q", F.lit(i)) for i in range(3))
    y = F.col("ret")
    pinball = F.lit(0.0)
    for share_, q in zip((0.1, 0.5, 0.9), (low, mid, high)):
        e = y - q
        pinball = pinball + F.greatest((share_ - 1) * e, share_ * e) / 3.0
    crossing = (F.greatest(low - mid, F.lit(0.0)) + F.greatest(mid - high, F.lit(0.0))) / 2.0
    base = df.groupBy(*keys).agg(
        F.avg(F.abs(mid - y)).alias("mae_pct"), F.sqrt(F.avg(F.pow(mid - y, 2))).alias("rmse_pct"),
        F.avg(F.abs(y)).alias("zero_return_mae_pct"), F.sqrt(F.avg(F.pow(y, 2))).alias("zero_return_rmse_pct"),
        F.avg((F.signum(mid) == F.signum(y)).cast("double")).alias("median_direction_accuracy"),
        F.avg(y.between(low, high).cast("double")).alias("p10_p90_coverage"),
        F.avg(high - low).alias("mean_interval_width_pct"),
        (F.avg(pinball) + 0.10 * F.avg(crossing)).alias("quantile_loss"))
    zero = F.col("zero_return_mae_pct")
    return base.withColumn("mae_improvement_over_zero", share(zero - F.col("mae_pct"), zero))


def temperature_grid(low: float = 0.25, high: float = 4.0, steps: int = 121) -> list[float]:
    a, b = math.log10(low), math.log10(high)
    return [10 ** (a + (b - a) * i / (steps - 1)) for i in range(steps)]


def fit_temperatures(scores: DataFrame, keys: Sequence[str] = ("horizon",), grid: Sequence[float] | None = None) -> DataFrame:
    """Temperature of the smallest mean negative log likelihood, lowest first on ties.

    The grid is an array literal exploded next to each row, and the mean is
    combined map-side, so the shuffle carries one row per key and temperature.
    """
    temps = F.array(*[F.lit(float(t)) for t in (grid or temperature_grid())])
    c = F.col
    rows = scores.withColumn("temperature", F.explode(temps))
    x = [c(n) / c("temperature") for n in ("sell", "hold", "buy")]
    top = F.greatest(*x)
    true = F.when(c("actual") == 0, x[0]).when(c("actual") == 1, x[1]).otherwise(x[2])
    nll = F.log(sum((F.exp(v - top) for v in x[1:]), F.exp(x[0] - top))) - (true - top)
    means = rows.groupBy(*keys, "temperature").agg(F.avg(nll).alias("nll"))
    return means.groupBy(*keys).agg(
        F.min_by("temperature", F.struct("nll", "temperature")).alias("temperature"), F.min("nll").alias("nll"))


def apply_temperatures(scores: DataFrame, fitted: DataFrame, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    joined = scores.join(fitted.select(*keys, "temperature"), list(keys))
    for n in ("sell", "hold", "buy"):
        joined = joined.withColumn(n, F.col(n) / F.col("temperature"))
    return joined.drop("temperature")


def fit_robust_scaler(train: DataFrame, features: Sequence[str], order: str, maximum: int | None = None,
                      width: int = 86400, tie: Sequence[str] = ()) -> DataFrame:
    """Median and interquartile range per feature (1 where the range vanishes), of all rows unless the caller names a ``maximum``."""
    sample = train if maximum is None else select.stride_sample(train, [], order, maximum, width, tie)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = sample.select(F.inline(pairs))
    q = C.exact_order_values(long, ["feature"], "value", (0.25, 0.5, 0.75))
    at = lambda f: F.max(F.when(F.col("fraction") == f, F.col("quantile")))
    fitted = q.groupBy("feature").agg(at(0.5).alias("median"), (at(0.75) - at(0.25)).alias("iqr"))
    return fitted.select("feature", "median", F.when(F.col("iqr") > 1e-8, F.col("iqr")).otherwise(1.0).alias("scale"))


def apply_robust_scaler(rows: DataFrame, fitted: DataFrame, features: Sequence[str], clip: float = 10.0) -> DataFrame:
    """Scaled features clipped to +/-clip; the fit is one row per feature."""
    packed = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("median", "scale"))))
    joined = rows.withColumn("_fit", fitted.agg(packed.alias("fit")).scalar())
    for f in features:
        fit = F.col("_fit")[f]
        z = (F.col(f) - fit["median"]) / fit["scale"]
        joined = joined.withColumn(f, F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))
    return joined.drop("_fit")


def class_weights(df: DataFrame, keys: Sequence[str], label: str, power: float = 0.5, classes: int = 3) -> DataFrame:
    """``count^-power`` divided by its mean; every class must occur."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(*keys)
    raw = F.pow(F.col("rows").cast("double"), F.lit(-power))
    guard = F.when(F.count(F.lit(1)).over(w) == classes, raw / F.avg(raw).over(w)).otherwise(
        F.raise_error(F.lit("each class must occur in the training data")).cast("double"))
    return counts.withColumn("weight", guard)


def latency_profile(calls: DataFrame, keys: Sequence[str] = ("role",)) -> DataFrame:
    """Mean, nearest-rank p50/p95 and error count per role."""
    good = calls.filter(~F.col("error") & F.col("latency_ms").isNotNull())
    q = C.exact_order_values(good, keys, "latency_ms", (0.5, 0.95), rank="nearest")
    at = lambda f: F.max(F.when(F.col("fraction") == f, F.col("quantile")))
    ranks = q.groupBy(*keys).agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    base = calls.groupBy(*keys).agg(
        F.avg(F.when(~F.col("error"), F.col("latency_ms"))).alias("mean"),
        F.count_if(F.col("error")).alias("errors"))
    return base.join(ranks, list(keys), "left")
