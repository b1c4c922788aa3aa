"""Labels, rule baselines and model-output signals as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def direction_label(move: Column, observed: Column, actionable: float | Column, require_observed: bool = True) -> Column:
    """BUY/SELL beyond the actionable move, HOLD inside, null when unknown."""
    edge = actionable if isinstance(actionable, Column) else F.lit(float(actionable))
    known = move.isNotNull() & (observed if require_observed else F.lit(True))
    return F.when(known, F.when(move <= -edge, "SELL").when(move >= edge, "BUY").otherwise("HOLD"))


def direction_class(move: Column, actionable: float) -> Column:
    """0 sell, 1 hold, 2 buy."""
    return (F.when(move >= F.lit(actionable), 2).when(move <= F.lit(-actionable), 0)
            .otherwise(1))


def _side(up: Column, down: Column) -> Column:
    return F.when(down, "SELL").when(up, "BUY").otherwise("HOLD")




def momentum(ret: Column, threshold: float = 0.30) -> Column:
    return _side(ret >= F.lit(threshold), ret <= F.lit(-threshold))


def trend_confirmation(spread: Column, macd: Column, band: float = 0.02) -> Column:
    return _side((spread > F.lit(band)) & (macd > 0), (spread < F.lit(-band)) & (macd < 0))


def rsi_reversion(rsi: Column, low: float = 30.0, high: float = 70.0) -> Column:
    return _side(rsi <= F.lit(low), rsi >= F.lit(high))


def softmax3(sell: Column, hold: Column, buy: Column) -> Column:
    """Array of three probabilities, shifted by the largest logit."""
    top = F.greatest(sell, hold, buy)
    raw = F.array(*[F.exp(x - top) for x in (sell, hold, buy)])
    total = raw[0] + raw[1] + raw[2]
    return F.transform(raw, lambda x: x / total)


def argmax3(a: Column, b: Column, c: Column) -> Column:
    """Index of the first largest of three."""
    return F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)


def probability_signal(p: Column, confidence: Column, margin: Column) -> Column:
    """+1/-1 when one side is confident and clear of the others, else 0."""
    sell, hold, buy = p[0], p[1], p[2]
    buys = (buy >= confidence) & (buy - F.greatest(sell, hold) >= margin)
    sells = (sell >= confidence) & (sell - F.greatest(buy, hold) >= margin)
    return F.when(sells, -1).when(buys, 1).otherwise(0)


def interval_signal(low: Column, high: Column, actionable: float) -> Column:
    """Trade only when the whole forecast interval lies beyond the move."""
    return (F.when(high < F.lit(-actionable), -1).when(low > F.lit(actionable), 1)
            .otherwise(0))
