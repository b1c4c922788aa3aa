"""Invariances of the labelled dataset on generated candles."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, quality
from tidemark.operators.features import DatasetSpec, Eligibility, FeatureWindows, LabelRule, TimeGrid
from tidemark.plans import dataset

T0 = 1_800_000_000
CFG = DatasetSpec(labels=LabelRule(edge_pct=0.0, cost_pct=0.1))
COLS = ["asset", "ts", "open", "high", "low", "close", "volume"]


def candles(n=700, asset="A", slope=0.01):
    i = np.arange(n)
    close = 100 + slope * i + np.sin(i / 13) * 0.25
    opened = close - np.sin(i / 7) * 0.05
    return pd.DataFrame({"asset": asset, "ts": T0 + 60 * i, "open": opened, "high": np.maximum(opened, close) + 0.15,
                         "low": np.minimum(opened, close) - 0.15, "close": close, "volume": 10.0 + i % 17})[COLS]


def build(spark, pdf, cfg=CFG, fn=dataset.build_dataset):
    return fn(spark.createDataFrame(pdf), cfg).toPandas().sort_values(["asset", "ts"]).reset_index(drop=True)


def test_features_match_direct_computation(spark):
    pdf = candles()
    got = build(spark, pdf, replace(CFG, chunk_rows=150), dataset.build_sequence_dataset)
    c = pdf["close"]
    ema = lambda s, n: s.ewm(span=n, adjust=False).mean()
    macd = ema(c, 12) - ema(c, 26)
    delta = c.diff()
    up, down = delta.clip(lower=0).rolling(14).mean(), (-delta).clip(lower=0).rolling(14).mean()
    want = pd.DataFrame({
        "ts": pdf["ts"], "macd_hist_pct": (macd - ema(macd, 9)) / c * 100, "ema_9_21_spread_pct": (ema(c, 9) - ema(c, 21)) / c * 100,
        "volatility_60m_pct": (c.pct_change() * 100).rolling(60).std(ddof=0), "drawdown_240_pct": (c / c.rolling(240).max() - 1) * 100,
        "rsi_14": 100 - 100 / (1 + up / down)})
    both = got.merge(want, on="ts", suffixes=("", "_want"))
    assert len(both) == len(got) > 400
    for name in want.columns[1:]:
        np.testing.assert_allclose(both[name], both[f"{name}_want"], rtol=1e-6, atol=1e-8, err_msg=name)


def test_future_changes_leave_features_alone(spark):
    pdf = candles()
    cut = T0 + 60 * 500
    other = pdf.copy()
    for name in ("open", "high", "low", "close"):
        other.loc[other["ts"] > cut, name] *= 1.2
    a, b = (build(spark, p, fn=dataset.build_sequence_dataset) for p in (pdf, other))
    cols = ["ts", *CFG.windows.columns]
    pd.testing.assert_frame_equal(a[a.ts <= cut][cols], b[b.ts <= cut][cols])


def test_missing_future_candle_removes_the_row_and_fills_are_no_decisions(spark):
    pdf = candles()
    gone = T0 + 60 * 515
    got = build(spark, pdf[pdf.ts != gone])
    assert gone not in set(got.ts)
    assert gone - 15 * 60 not in set(got.ts)
    assert gone - 16 * 60 in set(got.ts)


def test_large_gap_restarts_history(spark):
    pdf = candles()
    pdf.loc[pdf.index >= 350, "ts"] += 86400
    got = build(spark, pdf)
    late = got[got.ts >= T0 + 86400]
    assert late.ts.min() == T0 + 60 * (350 + 239) + 86400
    assert set(late.segment_id) == {1}


def test_chunk_length_changes_nothing(spark):
    pdf = pd.concat([candles(), candles(asset="B", slope=-0.02)])
    pdf = pdf[(pdf.ts // 60) % 37 != 5]
    a, b = build(spark, pdf), build(spark, pdf, replace(CFG, chunk_rows=97))
    assert list(a.ts) == list(b.ts) and list(a.label) == list(b.label) and list(a.segment_id) == list(b.segment_id)
    np.testing.assert_allclose(a[list(CFG.windows.columns)], b[list(CFG.windows.columns)], rtol=1e-8, atol=1e-10)


def test_off_grid_and_broken_candles_fail(spark):
    pdf = candles(300)
    pdf.loc[100, "ts"] += 1
    with pytest.raises(Exception, match="not aligned"):
        features.regularize(spark.createDataFrame(pdf), CFG).count()
    bad = candles(30)
    bad.loc[3, "high"] = 1.0
    df = spark.createDataFrame(bad)
    with pytest.raises(Exception, match="high_below_range"):
        quality.require_valid(df).collect()
    good, broken = quality.quarantine(df)
    assert (good.count(), broken.count()) == (29, 1)


def test_barriers_mark_ambiguous_and_gaps_invalid(spark):
    rows = [("A", T0 + 60 * i, 100.0, 100.0, 100.0, 100.0, 1.0) for i in range(12)]
    pdf = pd.DataFrame(rows, columns=COLS)
    pdf.loc[3, "high"] = 101.0
    pdf.loc[7, ["high", "low"]] = [101.0, 99.0]
    df = spark.createDataFrame(pdf).withColumn("is_observed", F.col("ts") != T0 + 60 * 10)
    got = {r.ts: r.label for r in dataset.barrier_labels(df, [2], 0.5, 60, 240).collect()}
    labels = [got[T0 + 60 * i] for i in range(12)]
    assert labels == [1, 2, 2, 1, 1, -1, -1, 1, -1, -1, -1, -1]


def test_spec_rules():
    for wrong in ({"labels": LabelRule(minutes=())}, {"labels": LabelRule(main=7)}, {"eligible": Eligibility(history=10)},
                  {"grid": TimeGrid(step_seconds=0)}, {"eligible": Eligibility(coverage=0.0)}, {"labels": LabelRule(cost_pct=-1.0)},
                  {"grid": TimeGrid(fill_minutes=0)}, {"chunk_rows": 9000}):
        with pytest.raises(ValueError):
            DatasetSpec(**wrong)
    assert math.isclose(DatasetSpec().labels.move_pct, 0.2)


def test_slow_averages_reach_back_far_enough(spark):
    """The halo follows the longest span, so chunks change nothing for slow averages either."""
    pdf = candles(2600)
    slow = replace(CFG, windows=FeatureWindows(macd=(50, 120, 30), cross=(40, 100)), chunk_rows=400)
    got = build(spark, pdf, slow, dataset.build_sequence_dataset)
    ema = lambda s, n: s.ewm(span=n, adjust=False).mean()
    c = pdf["close"]
    macd = ema(c, 50) - ema(c, 120)
    want = pd.DataFrame({"ts": pdf["ts"], "macd": (macd - ema(macd, 30)) / c * 100, "cross": (ema(c, 40) - ema(c, 100)) / c * 100})
    both = got.merge(want, on="ts")
    assert len(both) == len(got) > 2000
    np.testing.assert_allclose(both["macd_hist_pct"], both["macd"], rtol=0, atol=1e-11)
    np.testing.assert_allclose(both["ema_40_100_spread_pct"], both["cross"], rtol=0, atol=1e-11)
