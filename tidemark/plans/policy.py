"""Rule baselines and abstaining policies scored on non-overlapping trades."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import signals
from tidemark.operators import metrics, select
from tidemark.session import materialize

CONFIDENCES = (0.40, 0.45, 0.50, 0.55, 0.60)
MARGINS = (0.00, 0.05, 0.10, 0.15, 0.20)


def baseline_rows(rows: DataFrame, baselines: Mapping[str, Callable[[], Column]]) -> DataFrame:
    """One row per (row, baseline) with ``predicted`` limited to BUY/HOLD/SELL."""
    def checked(name, column):
        return F.when(column.isin(*metrics.LABELS), column).otherwise(
            F.raise_error(F.lit(f"baseline {name} emitted an unsupported action")).cast("string"))
    pairs = F.array(*[F.struct(F.lit(n).alias("baseline"), checked(n, make()).alias("predicted"))
                      for n, make in baselines.items()])
    return rows.select("*", F.inline(pairs))


def with_executions(rows: DataFrame, keys: Sequence[str], direction: str, spacing: int) -> DataFrame:
    """Mark rows whose non-zero direction is taken after the previous trade closed."""
    taken = select.greedy_spacing(rows.filter(F.col(direction) != 0), keys, spacing).withColumn("_taken", F.lit(True))
    joined = rows.join(taken, [*keys, "ts"], "left")
    return joined.withColumn("executed", F.coalesce("_taken", F.lit(False)) & (F.col(direction) != 0)).drop("_taken")


def _trade_stats(rows: DataFrame, keys: Sequence[str], first_row: bool) -> DataFrame:
    """Compounded return and drawdown of executed rows.

    ``first_row`` starts the equity at the first row of the frame, executed or
    not; rows without a trade leave equity unchanged and need no place in it.
    """
    trades = rows.filter("executed").select(*keys, "ts", "net_return_pct")
    curve = trades
    if first_row:
        opening = rows.groupBy(*keys).agg(F.min_by(F.struct("ts", "executed"), F.col("ts")).alias("_o"))
        opening = opening.filter(~F.col("_o.executed")).select(
            *keys, F.col("_o.ts").alias("ts"), F.lit(0.0).alias("net_return_pct"))
        curve = trades.unionByName(opening)
    summary = metrics.trade_summary(curve, keys)
    return summary.select(*keys, "compounded_return_pct", "maximum_drawdown_pct")


def evaluate_baselines(rows: DataFrame, baselines: Mapping[str, Callable[[], Column]], horizon_minutes: int,
                       round_trip_cost_pct: float, keys: Sequence[str] = ("asset", "part")) -> DataFrame:
    """Classification and trading metrics per (keys, baseline)."""
    label, ret = F.col(f"label_{horizon_minutes}m"), F.col(f"future_return_{horizon_minutes}m_pct")
    slim = rows.withColumn("actual", label.cast("string")).withColumn("_ret", ret)
    side = F.when(F.col("predicted") == "BUY", 1).when(F.col("predicted") == "SELL", -1).otherwise(0)
    long = baseline_rows(slim, baselines).select(
        *keys, "ts", "baseline", "actual", "predicted", "_ret").withColumn("direction", side)
    # Read several times below; the features behind it are computed once.
    long = materialize(long, "signals")
    by = [*keys, "baseline"]
    done = with_executions(long, by, "direction", horizon_minutes * 60)
    done = materialize(done.withColumn("net_return_pct", F.when(
        F.col("executed"), F.col("direction") * F.col("_ret") - round_trip_cost_pct).otherwise(0.0)), "executions")
    classed = metrics.classification(long, by, "actual", "predicted")
    hit = F.col("executed") & (F.col("actual") == F.col("predicted"))
    count = lambda c: F.count_if(c)
    acts = done.groupBy(*by).agg(
        count(F.col("direction") != 0).alias("signal_count"), count(F.col("executed")).alias("trade_count"),
        metrics.share(count(F.col("executed")), F.count(F.lit(1))).alias("trade_rate"),
        metrics.share(count(hit), count(F.col("executed"))).alias("trade_direction_accuracy"),
        metrics.share(count(F.col("executed") & (F.col("net_return_pct") > 0)), count(F.col("executed")))
        .alias("win_rate_after_cost"),
        F.coalesce(F.avg(F.when(F.col("executed"), F.col("net_return_pct"))), F.lit(0.0)).alias("average_trade_return_pct"))
    money = _trade_stats(done, by, first_row=True)
    return (classed.join(acts, by).join(money, by)
            .withColumn("overlap_skipped", F.col("signal_count") - F.col("trade_count")))


def _policy_metrics(done: DataFrame, by: Sequence[str]) -> DataFrame:
    count = lambda c: F.count_if(c)
    base = done.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), count(F.col("signal") != 0).alias("signals"),
        count(F.col("executed")).alias("trades"), F.avg((F.col("signal") == 0).cast("double")).alias("abstention_rate"),
        metrics.share(count(F.col("executed") & (F.col("net_return_pct") > 0)), count(F.col("executed")))
        .alias("win_rate_after_cost"),
        F.coalesce(F.avg(F.when(F.col("executed"), F.col("net_return_pct"))), F.lit(0.0)).alias("average_trade_return_pct"),
        metrics.share(count(F.col("executed") & (F.col("signal") + 1 == F.col("actual"))), count(F.col("executed")))
        .alias("direction_accuracy_on_trades"),
        F.avg((F.col("signal") + 1 == F.col("actual")).cast("double")).alias("action_accuracy"))
    money = _trade_stats(done, by, first_row=False)
    zero = F.lit(0.0)
    return (base.join(money, list(by), "left")
            .withColumn("compounded_return_pct", F.coalesce("compounded_return_pct", zero))
            .withColumn("maximum_drawdown_pct", F.coalesce("maximum_drawdown_pct", zero)))


def _trade(rows: DataFrame, by: Sequence[str], spacing: int, cost: float) -> DataFrame:
    done = with_executions(materialize(rows, "signals"), by, "signal", spacing)
    return materialize(done.withColumn("net_return_pct", F.when(
        F.col("executed"), F.col("signal") * F.col("ret") - cost).otherwise(0.0)), "executions")


def evaluate_policy(scores: DataFrame, configs: Sequence[tuple[float, float]], horizon_minutes: int, cost: float,
                    keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Policy metrics per (keys, confidence, margin); the grid is a literal array."""
    grid = F.array(*[F.struct(F.lit(float(a)).alias("confidence"), F.lit(float(b)).alias("margin")) for a, b in configs])
    p = signals.softmax3(F.col("sell"), F.col("hold"), F.col("buy"))
    rows = scores.withColumn("_p", p).select(*keys, "ts", "actual", "ret", "_p", F.inline(grid))
    rows = rows.withColumn("signal", signals.probability_signal(F.col("_p"), F.col("confidence"), F.col("margin"))).drop("_p")
    by = [*keys, "confidence", "margin"]
    return _policy_metrics(_trade(rows, by, horizon_minutes * 60, cost), by)


def fit_policy(scores: DataFrame, horizon_minutes: int, cost: float, *, keys: Sequence[str] = ("horizon",),
               confidences: Sequence[float] = CONFIDENCES, margins: Sequence[float] = MARGINS,
               minimum_trades: int = 10) -> DataFrame:
    """Best thresholds per key, or a disabled policy where none pays.

    Among viable settings the largest (score, average, win rate, fewest trades)
    wins, the earliest of the grid on full ties.
    """
    if minimum_trades <= 0:
        raise ValueError("minimum_trades must be positive")
    configs = [(a, b) for a in confidences for b in margins]
    scored = evaluate_policy(scores, configs, horizon_minutes, cost, keys)
    c = F.col
    scored = scored.withColumn("score", c("compounded_return_pct") + 0.5 * c("maximum_drawdown_pct"))
    eligible = c("trades") >= minimum_trades
    viable = eligible & (c("compounded_return_pct") > 0) & (c("average_trade_return_pct") > 0)
    order = F.struct(c("score"), c("average_trade_return_pct"), c("win_rate_after_cost"), -c("trades"),
                     -c("confidence"), -c("margin"))
    pick = F.struct("confidence", "margin", "score", "trades", "compounded_return_pct", "maximum_drawdown_pct")
    best = scored.groupBy(*keys).agg(
        F.count_if(eligible).alias("eligible_candidates"), F.count_if(viable).alias("viable_candidates"),
        F.max_by(pick, F.when(viable, order)).alias("_best"))
    on = c("viable_candidates") > 0
    take = lambda n, other: F.when(on, c(f"_best.{n}")).otherwise(F.lit(other)).alias(n)
    return best.select(
        *keys, on.alias("enabled"), take("confidence", 1.0), take("margin", 1.0), "eligible_candidates",
        "viable_candidates", take("trades", 0), take("compounded_return_pct", 0.0), take("maximum_drawdown_pct", 0.0))


def evaluate_interval_policy(scores: DataFrame, horizon_minutes: int, actionable: float, cost: float,
                             keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Metrics of the policy that trades only when the whole interval clears the move."""
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(2))
    rows = scores.select(*keys, "ts", "ret", signals.interval_signal(low, high, actionable).alias("signal"),
                         signals.direction_class(F.col("ret"), actionable).alias("actual"))
    return _policy_metrics(_trade(rows, keys, horizon_minutes * 60, cost), keys)
