"""Registered queries: validation, windows and the labelled dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import R, RS, query, rnd, rounded
from tidemark.catalog.fixtures import CFG, FEAT, REG, W, bars
from tidemark.operators import features

KEY = ["asset", "ts"]


def _feature_query(key: str, columns: list[str], plain: tuple[str, ...] = ()):
    sql = W(FEAT, f"SELECT {', '.join([*KEY, *plain])}{', ' + RS(columns) if columns else ''} FROM feat", True)

    @query(key, sql)
    def run(spark, sf):
        return rounded(features.featured_bars(bars(spark, sf), CFG), [*KEY, *plain], columns)


_feature_query("W01_returns", ["return_1m_pct", "return_5m_pct", "return_15m_pct"])
_feature_query("W02_realised_volatility", ["volatility_5m_pct", "volatility_15m_pct"])
_feature_query("W03_rsi_strict", ["rsi_14"])
_feature_query("W05_ema_spread", ["ema_9_21_spread_pct"])
_feature_query("W06_macd_histogram", ["macd_hist_pct"])
_feature_query("W08_atr_strict", ["atr_14_pct"])
_feature_query("W09_bollinger_z", ["bollinger_z_20"])
_feature_query("W11_volume_z", ["volume_z_20"])
_feature_query("W12_donchian_position", ["donchian_position_20"])
_feature_query("W13_drawdown_from_peak", ["drawdown_12_pct", "drawdown_48_pct"])
_feature_query("W14_observed_coverage", ["observed_coverage_12", "observed_coverage_24"])
_feature_query("W18_history_position", [], ("history_candles",))
_feature_query("F17_future_labels", ["future_return_240m_pct", "future_return_1440m_pct"], ("label_240m", "label_1440m"))


@query("W17_regularised_bars", W(REG, f"""SELECT asset, ts, segment_id, is_observed, history_candles,
    {RS(['open', 'high', 'low', 'close', 'volume'])} FROM reg"""))
def w17(spark, sf):
    return rounded(features.regularize(bars(spark, sf), CFG),
                   [*KEY, "segment_id", "is_observed", "history_candles"], ["open", "high", "low", "close", "volume"])
