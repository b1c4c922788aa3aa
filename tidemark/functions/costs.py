"""Trading costs and outcome classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEE_RATE = 0.003
MIN_SLIPPAGE = 0.0005
MAX_SLIPPAGE = 0.003
ATR_FACTOR = 0.10


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def round_trip_cost_pct(fee, slippage) -> Column:
    return F.lit(200.0) * (_col(fee) + _col(slippage))


def one_way_cost_pct(fee, slippage) -> Column:
    return F.lit(100.0) * (_col(fee) + _col(slippage))


def slippage_rate(atr: Column, price: Column, low: float = MIN_SLIPPAGE, high: float = MAX_SLIPPAGE,
                  factor: float = ATR_FACTOR) -> Column:
    """Volatility-scaled slippage clamped to [low, high]; no price means the floor."""
    scaled = F.try_divide(F.coalesce(atr, F.lit(0.0)), price) * F.lit(factor)
    bounded = F.least(F.lit(high), F.greatest(F.lit(low), scaled))
    return F.when(price > 0, bounded).otherwise(F.lit(low))


def base_price(action: Column, effective: Column, executed: Column) -> Column:
    """Price an outcome is measured from: the effective one for real executions."""
    filled = action.isin("BUY", "SELL") & effective.isNotNull() & (effective != 0)
    return F.when(filled, effective).otherwise(F.coalesce(executed, F.lit(0.0)))


def move_pct(future: Column, base: Column) -> Column:
    return F.try_divide(future - base, base) * F.lit(100.0)


def _trend(value: Column, threshold: Column, above: str, below: str, between: str) -> Column:
    return (F.when(value >= threshold, above).when(value <= -threshold, below)
            .otherwise(between))


def plain_outcome(action: Column, move: Column, threshold) -> Column:
    """Outcome class before costs."""
    t = _col(threshold)
    return (F.when(action == "BUY", _trend(move, t, "good", "bad", "neutral"))
            .when(action == "SELL", _trend(move, t, "bad", "good", "neutral"))
            .when(action == "HOLD", _trend(move, t, "missed_upside", "avoided_downside", "good"))
            .otherwise("not_applicable"))


def net_edge_pct(action: Column, move: Column, buy_cost: Column, sell_cost: Column) -> Column:
    """Directional edge after costs; SELL reduces a holding, it is no short."""
    return (F.when(action == "BUY", move - buy_cost)
            .when(action == "SELL", -move - sell_cost)
            .otherwise(F.lit(0.0)))


def action_cost_pct(action: Column, buy_cost: Column, sell_cost: Column) -> Column:
    return F.when(action == "BUY", buy_cost).when(action == "SELL", sell_cost).otherwise(F.lit(0.0))


def net_outcome(action: Column, move: Column, buy_cost: Column, sell_cost: Column, threshold) -> Column:
    """Outcome class after costs; HOLD is judged against the entry and exit hurdles."""
    t = _col(threshold)
    edge = net_edge_pct(action, move, buy_cost, sell_cost)
    hold = (F.when(move >= t + buy_cost, "missed_upside")
            .when(move <= -(t + sell_cost), "avoided_downside").otherwise("good"))
    return (F.when(action.isin("BUY", "SELL"), _trend(edge, t, "good", "bad", "neutral"))
            .when(action == "HOLD", hold).otherwise("not_applicable"))


def stale_score(action: Column, move: Column, threshold) -> Column:
    """Scoring of the as-of price benchmark: a null move has not matured."""
    t = _col(threshold)
    hold = (F.when(F.abs(move) < t, "GOOD").when(move > 0, "MISSED_UPSIDE")
            .otherwise("AVOIDED_DOWNSIDE"))
    return (F.when(move.isNull(), "NOT_MATURED")
            .when(action == "BUY", _trend(move, t, "GOOD", "BAD", "NEUTRAL"))
            .when(action == "SELL", _trend(move, t, "BAD", "GOOD", "NEUTRAL"))
            .otherwise(hold))


def conviction_band(value: Column) -> Column:
    return (F.when(value < 50, "0-49").when(value < 60, "50-59")
            .when(value < 70, "60-69").otherwise("70-80"))
