"""Scoring a table of model responses: caps, gate, costs, outcomes in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import costs, gate
from tidemark.plans import outcomes

NEWS_MODES = ("historical", "neutral-fresh", "technical-only")
NEUTRAL_HEADLINE = "Neutral historical evaluation context."


def score_responses(responses: DataFrame, bars: DataFrame, horizons: Sequence[int], threshold_pct: float,
                    config: gate.GateConfig = gate.GateConfig(), *, capped: bool = False,
                    fee_rate: float = costs.FEE_RATE, tolerance: int = 90) -> DataFrame:
    """Gate every response and measure both actions after costs."""
    rows = gate.cap_proposals(responses) if capped else responses
    gated = gate.evaluate_gate(rows, config)
    priced = gated.withColumn("slippage_rate", costs.slippage_rate(F.col("atr"), F.col("price")))
    return outcomes.campaign_outcomes(priced, bars, horizons, threshold_pct, fee_rate, tolerance)


def with_news_modes(snapshots: DataFrame, modes: Sequence[str] = NEWS_MODES) -> DataFrame:
    """Each snapshot under each news intervention.

    The synthetic modes clear the risk flags; one shows a fresh neutral headline,
    the other no news at all (stale by design).
    """
    if set(modes) - set(NEWS_MODES):
        raise ValueError("unknown news mode")
    rows = snapshots.withColumn("news_mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    kept, neutral = F.col("news_mode") == "historical", F.col("news_mode") == "neutral-fresh"
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "news_context_mode": F.when(kept, "OBSERVED").when(neutral, "SYNTHETIC_NEUTRAL")
        .otherwise("UNAVAILABLE_BY_TEST_DESIGN"),
        "red_flag": F.col("red_flag") & kept,
        "untrusted": F.col("untrusted") & kept,
        "risk_level": F.when(kept, F.col("risk_level")).when(neutral, "NORMAL").otherwise("UNAVAILABLE"),
        "matched_terms": F.when(kept, F.col("matched_terms")).otherwise(none),
        "latest_news_ts": F.when(kept, F.col("latest_news_ts")).when(neutral, F.col("ts")),
        "news_age": F.when(kept, F.col("news_age")).when(neutral, F.lit(0).cast("bigint")),
        "news_stale": F.when(kept, F.col("news_stale")).otherwise(~neutral),
        "headlines": F.when(kept, F.col("headlines")).when(neutral, F.array(F.lit(NEUTRAL_HEADLINE))).otherwise(none),
        "news_count": F.when(kept, F.col("news_count")).when(neutral, 1).otherwise(0),
    })
