"""Measuring decisions against later prices, in long form (decision, horizon)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import costs
from tidemark.operators import asof, metrics, select

STATUSES = ("good", "bad", "neutral", "missed_upside", "avoided_downside", "not_applicable")
MATURITIES = ("matured", "not_matured", "data_gap")


def with_horizons(decisions: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """One row per decision and horizon (minutes) with its target time."""
    long = decisions.withColumn("horizon_min", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    return long.withColumn("target_ts", F.col("ts") + F.col("horizon_min") * 60)


def decision_outcomes(decisions: DataFrame, bars: DataFrame, horizons: Sequence[int], threshold_pct: float = 0.20,
                      tolerance: int = 90, action: Column | None = None) -> DataFrame:
    """Outcome before costs per decision and horizon.

    ``status`` is the outcome class, or the maturity where there is no price.
    """
    base = decisions.withColumn("base_price", costs.base_price(
        F.col("risk_action"), F.col("effective_price"), F.col("execution_price")))
    found = asof.maturity(with_horizons(base, horizons), bars, "target_ts", tolerance)
    usable = F.col("base_price") > 0
    move = F.when(usable & (F.col("maturity") == "matured"), costs.move_pct(F.col("future_price"), F.col("base_price")))
    judged = F.col("risk_action") if action is None else action
    found = found.withColumn("maturity", F.when(usable, F.col("maturity")).otherwise("not_matured"))
    return found.withColumn("move_pct", move).withColumn("status", F.when(
        F.col("maturity") == "matured", costs.plain_outcome(judged, F.col("move_pct"), threshold_pct)).otherwise(F.col("maturity")))


def outcome_counts(outcomes: DataFrame, keys: Sequence[str] = ("horizon_min",)) -> DataFrame:
    """Maturity and status counts per key, every class present."""
    return outcomes.groupBy(*keys).agg(
        *[F.count_if(F.col("maturity") == m).alias(m) for m in MATURITIES],
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def campaign_outcomes(results: DataFrame, bars: DataFrame, horizons: Sequence[int], threshold_pct: float,
                      fee_rate: float = costs.FEE_RATE, tolerance: int = 90) -> DataFrame:
    """Outcomes after costs of the proposed and the gated action.

    ``results``: asset, ts, price, slippage_rate, proposed_action, risk_action,
    executed_size and whatever else should be carried along.
    """
    found = asof.maturity(with_horizons(results, horizons), bars, "target_ts", tolerance)
    usable = F.col("price") > 0
    buy = costs.round_trip_cost_pct(fee_rate, F.col("slippage_rate"))
    sell = costs.one_way_cost_pct(fee_rate, F.col("slippage_rate"))
    found = found.withColumn("maturity", F.when(usable, F.col("maturity")).otherwise("not_matured"))
    ripe = F.col("maturity") == "matured"
    move = F.when(ripe, costs.move_pct(F.col("future_price"), F.col("price")))
    found = found.withColumn("move_pct", move).withColumn("buy_cost_pct", buy).withColumn("sell_cost_pct", sell)
    args = lambda a: (F.col(a), F.col("move_pct"), F.col("buy_cost_pct"), F.col("sell_cost_pct"))
    edge = F.when(ripe, costs.net_edge_pct(*args("risk_action")))
    return found.withColumns({
        "llm_status": F.when(ripe, costs.net_outcome(*args("proposed_action"), threshold_pct)),
        "risk_status": F.when(ripe, costs.net_outcome(*args("risk_action"), threshold_pct)),
        "edge_pct": edge,
        "weighted_edge_pct": edge * F.coalesce(F.col("executed_size"), F.lit(0.0)) / 100,
    })


def horizon_summary(outcomes: DataFrame, keys: Sequence[str] = ("variant", "horizon_min")) -> DataFrame:
    """Maturity, status and directional figures per (variant, horizon)."""
    ripe = F.col("maturity") == "matured"
    directed = ripe & F.col("risk_action").isin("BUY", "SELL")
    status = lambda s: F.count_if(directed & (F.col("risk_status") == s))
    good, bad = status("good"), status("bad")
    return outcomes.groupBy(*keys).agg(
        *[F.count_if(F.col("maturity") == m).alias(m) for m in MATURITIES],
        *[F.count_if(ripe & (F.col("risk_status") == s)).alias(s) for s in STATUSES[:-1]],
        F.count_if(directed).alias("directional_samples"), good.alias("directional_good"), bad.alias("directional_bad"),
        status("neutral").alias("directional_neutral"),
        F.try_divide(F.count_if(directed).cast("double"), F.count_if(ripe).cast("double")).alias("directional_coverage"),
        F.try_divide(good.cast("double"), (good + bad).cast("double")).alias("directional_precision"),
        F.avg(F.when(directed, F.col("edge_pct"))).alias("average_edge_pct"),
        F.avg(F.when(directed, F.col("weighted_edge_pct"))).alias("average_weighted_edge_pct"))


def conviction_calibration(outcomes: DataFrame, keys: Sequence[str] = ("variant", "horizon_min")) -> DataFrame:
    """Outcome counts of proposals per conviction band, and good/(good+bad)."""
    ripe = outcomes.filter(F.col("maturity") == "matured").withColumn("band", costs.conviction_band(F.col("conviction")))
    n = lambda s: F.count_if(F.col("llm_status") == s)
    return ripe.groupBy(*keys, "band").agg(
        F.count(F.lit(1)).alias("samples"), *[n(s).alias(s) for s in STATUSES[:-1]],
        F.try_divide(n("good").cast("double"), (n("good") + n("bad")).cast("double")).alias("good_rate"))


def campaign_counts(results: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """Samples, errors, technical failures and action counts per variant."""
    ok = F.col("status") == "OK"
    sides = ("BUY", "SELL", "HOLD")
    return results.groupBy(*keys).agg(
        F.count_if(ok).alias("samples"), F.count_if(~ok).alias("errors"),
        F.count_if(ok & F.col("technical_failure")).alias("technical_failures"),
        *[F.count_if(ok & (F.col("proposed_action") == a)).alias(f"llm_{a.lower()}") for a in sides],
        *[F.count_if(ok & (F.col("risk_action") == a)).alias(f"risk_{a.lower()}") for a in sides])


def transitions(results: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    return results.groupBy(*keys, "proposed_action", "risk_action").agg(F.count(F.lit(1)).alias("n"))


def regime_alignment(results: DataFrame, keys: Sequence[str] = ("variant", "regime")) -> DataFrame:
    """Matches with the action a regime expects; null where it expects none."""
    same = lambda a: F.sum((F.col(a) == F.col("expected_action")).cast("bigint"))
    return results.groupBy(*keys).agg(
        F.max("expected_action").alias("expected_action"), F.count(F.lit(1)).alias("samples"),
        same("proposed_action").alias("llm_matches"), same("risk_action").alias("risk_matches"))


def evaluation_gate(counts: DataFrame, evaluated: DataFrame) -> DataFrame:
    """READY, PENDING (immature rows) or BLOCKED (gaps or nothing evaluated)."""
    total = evaluated.agg(F.count(F.lit(1)).alias("n")).scalar()
    sums = counts.agg(F.sum("data_gap").alias("data_gaps"), F.sum("not_matured").alias("not_matured"))
    sums = sums.withColumn("logs_evaluated", total)
    state = (F.when((F.col("logs_evaluated") <= 0) | F.col("data_gaps").isNull(), "BLOCKED")
             .when(F.col("data_gaps") > 0, "BLOCKED").when(F.col("not_matured") > 0, "PENDING").otherwise("READY"))
    return sums.withColumn("state", state)


def finalize_after(end: Column, horizons: Sequence[int], max_age: int = 1200, tolerance: int = 90) -> Column:
    """Time from which every horizon of a session must have matured."""
    return end + F.lit(max(horizons) * 60 + max_age + tolerance)


def entry_kind() -> Column:
    """approved (executed), blocked (proposed only) or ignored."""
    sides = ("BUY", "SELL")
    return (F.when(F.col("risk_action").isin(*sides), "approved")
            .when(F.col("proposed_action").isin(*sides), "blocked").otherwise("ignored"))


def entry_outcomes(decisions: DataFrame, bars: DataFrame, horizons: Sequence[int], threshold_pct: float = 0.20,
                   tolerance: int = 90) -> DataFrame:
    """Outcomes of entries; a blocked one is judged as HOLD."""
    entries = decisions.withColumn("kind", entry_kind()).filter(F.col("kind") != "ignored")
    judged = F.when(F.col("kind") == "approved", F.col("risk_action")).otherwise("HOLD")
    return decision_outcomes(entries, bars, horizons, threshold_pct, tolerance, judged)


def interesting(decisions: DataFrame, outcomes: DataFrame, limit: int = 12, id_col: str = "decision_id") -> DataFrame:
    """First ``limit`` decisions worth a human look, by id."""
    poor = outcomes.groupBy(id_col).agg(F.max(F.col("status").isin("bad", "missed_upside")).alias("_poor"))
    joined = decisions.join(poor, [id_col], "left")
    reason = F.coalesce(F.col("reason"), F.lit(""))
    keep = ((F.col("risk_action") == "BUY") | ~F.col("proposed_action").eqNullSafe(F.col("risk_action"))
            | F.coalesce("_poor", F.lit(False)) | reason.contains("Directional Gate") | reason.contains("Cooldown"))
    return joined.filter(keep).drop("_poor").orderBy(id_col).limit(limit)


def evaluations_wide(outcomes: DataFrame, fixed: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """One row per decision with status and move columns per horizon, for export."""
    cells = []
    for h in horizons:
        at = F.col("horizon_min") == h
        cells += [F.first(F.when(at, F.col("status")), ignorenulls=True).alias(f"{h}m Status"),
                  F.first(F.when(at, F.col("move_pct")), ignorenulls=True).alias(f"{h}m Move %")]
    return outcomes.groupBy(*fixed).agg(*cells)


def pending_plan(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned decisions that have no good result yet (resume)."""
    good = done.filter((F.col("status") == "OK") & ~F.coalesce(F.col("technical_failure"), F.lit(False)))
    return plan.join(good.select(*keys).distinct(), list(keys), "left_anti")


def paired_comparison(results: DataFrame, modes: Sequence[str], baseline: str,
                      pair: Sequence[str] = ("signature", "variant", "window_id", "ts")) -> DataFrame:
    """Candidate rows against the baseline of the same sampling group.

    ``match`` is paired, missing_candidate or missing_baseline; ``technical_equal``
    tells whether price and indicator state stayed the same.
    """
    other = [m for m in modes if m != baseline]
    state = F.sha2(F.to_json(F.struct("price", "rsi", "macd", "atr")), 256)
    rows = results.withColumn("_state", state)
    side = lambda df, tag: df.select(*pair, "mode", F.col("proposed_action").alias(f"{tag}_llm"),
                                     F.col("risk_action").alias(f"{tag}_risk"), F.col("_state").alias(f"{tag}_state"))
    base = rows.filter(F.col("mode") == baseline).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in other])))
    joined = side(rows.filter(F.col("mode").isin(*other)), "after").join(side(base, "before"), [*pair, "mode"], "full_outer")
    match = (F.when(F.col("after_state").isNull(), "missing_candidate")
             .when(F.col("before_state").isNull(), "missing_baseline").otherwise("paired"))
    return (joined.withColumn("match", match)
            .withColumn("technical_equal", F.col("after_state") == F.col("before_state"))
            .withColumn("changed", (F.col("after_llm") != F.col("before_llm")) | (F.col("after_risk") != F.col("before_risk")))
            .drop("after_state", "before_state"))


def paired_changes(pairs: DataFrame) -> DataFrame:
    """Counts of each change of (proposal, gated action) per mode."""
    return (pairs.filter((F.col("match") == "paired") & F.col("changed"))
            .groupBy("mode", "before_llm", "after_llm", "before_risk", "after_risk").agg(F.count(F.lit(1)).alias("n")))


def group_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("signature", "mode").agg(
        F.count_if(F.col("match") == "paired").alias("paired_points"),
        F.count_if(F.col("match") != "paired").alias("key_mismatches"),
        F.count_if(~F.col("technical_equal")).alias("technical_mismatches"),
        F.count_if(F.col("changed")).alias("changes"))


def multi_role_summary(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latency profile per role, and counts of every (field, value) pair."""
    profile = metrics.latency_profile(calls)
    return profile, calls.groupBy("role", "output").agg(F.count(F.lit(1)).alias("n"))


def top_reasons(df: DataFrame, keys: Sequence[str], n: int, within: Sequence[str] = ()) -> DataFrame:
    """Most frequent values, ties by value."""
    counts = df.groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("n"))
    if within:
        return select.top_per_key(counts, within, [F.desc("n"), *keys], n)
    return counts.orderBy(F.desc("n"), *keys).limit(n)
