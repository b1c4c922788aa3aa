"""Declared table schemas (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {
        "s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(),
        "b": T.BooleanType(), "i": T.IntegerType(),
    }
    fields = (part.split(":") for part in spec.split())
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


CANDLES = _struct("asset:s ts:l open:d high:d low:d close:d volume:d")

# Fixed header of the canonical candle file.
CANDLE_CSV = _struct(
    "timestamp:l datetime_utc:s open:d high:d low:d close:d volume:d symbol:s resolution:s source:s"
)

# Headerless twelve-column archive rows; the first five figures after the open
# time are the candle, the rest is carried by the vendor and dropped here.
ARCHIVE_CSV = _struct(
    "open_time:l open:d high:d low:d close:d volume:d close_time:l quote_volume:d "
    "trades:l taker_base:d taker_quote:d ignored:s"
)

NEWS = _struct("news_id:l ts:l source:s headline:s")
DOCUMENTS = _struct("doc_id:l source_type:s source:s title:s text:s published_at:l")

SNAPSHOT = T.StructType([
    T.StructField("technical", _struct(
        "current_price:d rsi_value:d rsi_status:s macd_histogram:d macd_status:s ema_status:s volatility_atr:d")),
    T.StructField("technical_context", T.StructType([
        T.StructField("current_price", T.DoubleType()),
        T.StructField("rsi", _struct("value:d status:s")),
        T.StructField("macd", _struct("histogram:d status:s")),
        T.StructField("ema_crossover", _struct("status:s")),
    ])),
    T.StructField("data_health", _struct(
        "kline_age_seconds:l news_age_seconds:l is_market_data_stale:b is_news_stale:b")),
    T.StructField("news_risk", T.StructType([
        T.StructField("has_negative_red_flag", T.BooleanType()),
        T.StructField("has_untrusted_instruction", T.BooleanType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("matched_terms", T.ArrayType(T.StringType())),
    ])),
    T.StructField("portfolio", _struct("current_exposure_percentage:d is_in_drawdown:b")),
    T.StructField("portfolio_context", _struct("current_exposure_percentage:d is_in_drawdown:b")),
])
