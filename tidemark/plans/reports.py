"""Profiles, health, readiness and audit reports as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import text
from tidemark.operators import chunks as C

# Required feeds with their maximum heartbeat age in seconds.
REQUIRED_WORKERS = {"price_worker": 300, "news_worker": 3600}
FUTURE_HEARTBEAT = 30


def build_bars(rows: DataFrame, size: int = 900, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Right-closed bars from finer rows; ``ts`` is the newest source row of the bin."""
    end = (F.floor((F.col("ts") - 1) / size) * size + size).cast("bigint")
    return rows.groupBy(*keys, end.alias("bin_end")).agg(
        F.max("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("observations"))


def gap_histogram(bars: DataFrame, width: int, step: int = 60, edges: Sequence[tuple[str, int]] = (("1m", 1), ("2_5m", 5), ("6_15m", 15)),
                  beyond: str = "gt_15m", keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Counts of step sizes in whole bars between neighbouring rows."""
    linked = C.previous_row(bars.select(*keys, "ts"), keys, "ts", ["ts"], width)
    steps = F.floor((F.col("ts") - F.col("prev_ts")) / step)
    name = F.lit(beyond)
    for label, limit in reversed(list(edges)):
        name = F.when(steps <= limit, label).otherwise(name)
    return (linked.filter(F.col("prev_ts").isNotNull()).groupBy(*keys, name.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def execution_rows(logs: DataFrame) -> DataFrame:
    """Executions with slippage in percent and the immediate equity change."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return (logs.filter(F.col("action").isin("BUY", "SELL"))
            .withColumn("slippage_pct", F.round(zero("slippage_rate") * 100, 4))
            .withColumn("immediate_equity_delta", F.round(zero("equity_after") - zero("equity_before"), 4)))


def execution_summary(logs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    rows = logs.filter(F.col("action").isin("BUY", "SELL"))
    none = F.lit(0.0)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("executed_orders"), F.coalesce(F.sum("fee"), none).alias("total_fees"),
        F.coalesce(F.sum("realized_pnl"), none).alias("realized_pnl"),
        F.coalesce(F.avg("slippage_rate") * 100, none).alias("avg_slippage_pct"))


def profile(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def table_counts(tables: Mapping[str, DataFrame], expected: Sequence[str]) -> DataFrame:
    """Row count per expected table, null for a missing one."""
    out = None
    spark = next(iter(tables.values())).sparkSession
    for name in expected:
        if name in tables:
            part = tables[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        else:
            part = spark.range(1).select(F.lit(name).alias("table"), F.lit(None).cast("bigint").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


def performance(logs: DataFrame, keys: Sequence[str], price: str = "execution_price", initial: float = 10000.0) -> DataFrame:
    """Cycles, executions, blocked proposals, hours, trades per hour and result."""
    hours = F.greatest((F.max("ts") - F.min("ts")) / 3600.0, F.lit(0.01))
    executed = F.count_if(F.col("risk_action") != "HOLD")
    blocked = F.count_if((F.col("risk_action") == "HOLD") & (F.col("conviction") >= 70))
    last = F.max_by(price, F.struct("ts", "decision_id"))
    base = logs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cycles"), executed.alias("executed"), blocked.alias("blocked"), hours.alias("hours"),
        (executed / hours).alias("trades_per_hour"), (blocked / F.count(F.lit(1)) * 100).alias("blocked_pct"), last.alias("last_price"))
    return base


def snapshot_health(logs: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Cross table of the health and risk flags of readable snapshots."""
    s = F.from_json(F.col(snapshot), schemas.SNAPSHOT, {"mode": "PERMISSIVE"})
    rows = logs.withColumn("_s", s).filter(readable(F.col(snapshot)))
    flag = lambda path: F.coalesce(F.col(f"_s.{path}"), F.lit(False))
    return rows.groupBy(
        flag("data_health.is_market_data_stale").alias("market_stale"), flag("data_health.is_news_stale").alias("news_stale"),
        flag("news_risk.has_negative_red_flag").alias("red_flag"),
        F.coalesce("_s.news_risk.risk_level", F.lit("UNKNOWN")).alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))


def snapshot_terms(logs: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    s = F.from_json(F.col(snapshot), schemas.SNAPSHOT, {"mode": "PERMISSIVE"})
    return (logs.filter(readable(F.col(snapshot))).select(F.explode(s["news_risk"]["matched_terms"]).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def readable(snapshot: Column) -> Column:
    """The text is a JSON object."""
    return F.coalesce(F.json_object_keys(snapshot).isNotNull(), F.lit(False))


def scenario_matrix(results: DataFrame, name: str, scenarios: Mapping[str, tuple[str | None, Sequence[str] | None]],
                    proposed: str = "proposed_action", final: str = "risk_action") -> DataFrame:
    """Pass counts per scenario; a scenario without expectation always passes."""
    expected = F.create_map(*[x for k, (e, _) in scenarios.items() for x in (F.lit(k), F.lit(e))])
    allowed = F.create_map(*[x for k, (_, a) in scenarios.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in a or ()]))])
    want, may = F.try_element_at(expected, F.col(name)), F.try_element_at(allowed, F.col(name))
    quality = want.isNull() | (F.col(proposed) == want)
    safety = may.isNull() | F.array_contains(may, F.col(final))
    return results.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.count_if(quality).alias("quality_passed"),
                                     F.count_if(safety).alias("safety_passed"))


def heartbeat_status(beats: DataFrame, now: int, required: Mapping[str, int] = REQUIRED_WORKERS) -> DataFrame:
    """missing, future, stale or healthy for every required worker."""
    rows = F.array(*[F.struct(F.lit(k).alias("worker"), F.lit(v).alias("max_age")) for k, v in required.items()])
    wanted = beats.sparkSession.range(1).select(F.inline(rows))
    latest = beats.filter(F.col("worker").isin(*required)).groupBy("worker").agg(F.max("ts").alias("heartbeat"))
    age = F.lit(now) - F.col("heartbeat")
    state = (F.when(F.col("heartbeat").isNull(), "missing").when(age < -FUTURE_HEARTBEAT, "future")
             .when(age > F.col("max_age"), "stale").otherwise("healthy"))
    return wanted.join(latest, "worker", "left").withColumn("age", age).withColumn("status", state)


def verdict(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """BLOCKED, PASS_WITH_WARNINGS or PASS over rows (check, severity)."""
    n = lambda s: F.count_if(F.col("severity") == s)
    state = F.when(n("BLOCKER") > 0, "BLOCKED").when(n("WARNING") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    return checks.groupBy(*keys).agg(n("BLOCKER").alias("blockers"), n("WARNING").alias("warnings"), state.alias("verdict"))


def freshness_checks(latest: DataFrame, key: str, now: int, max_age: int, name: str) -> DataFrame:
    """Check rows for the newest timestamp per key: stale blocks, half the limit warns."""
    age = F.lit(now) - F.col("last_ts")
    severity = (F.when(F.col("last_ts").isNull() | (age > max_age), "BLOCKER").when(age > max_age // 2, "WARNING").otherwise("OK"))
    return latest.select(key, F.lit(name).alias("check"), severity.alias("severity"))


def capital_checks(portfolio: DataFrame, positions: DataFrame, key: str = "account") -> DataFrame:
    """Consistency of balances (key, cash, asset) and positions (key, quantity, avg_cost)."""
    c = F.col
    rows = portfolio.join(positions, key, "left")
    bad = lambda x: c(x).isNull() | F.isnan(x) | (c(x) < 0)
    close = F.abs(c("quantity") - c("asset")) <= F.greatest(F.lit(1e-9), F.lit(1e-6) * F.greatest(F.abs("quantity"), F.abs("asset")))
    severity = (F.when(bad("cash") | bad("asset"), "BLOCKER").when(c("quantity").isNull() & (c("asset") > 0), "BLOCKER")
                .when(c("quantity").isNotNull() & (bad("quantity") | bad("avg_cost") | ~close), "BLOCKER").otherwise("OK"))
    return rows.select(key, F.lit("capital").alias("check"), severity.alias("severity"))


def run_state(events: DataFrame, key: str = "run_id", order: str = "seq") -> DataFrame:
    """Current state per run from append-only events: newest non-null of every field."""
    fields = [c for c in events.columns if c not in (key, order)]
    return events.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields], F.count(F.lit(1)).alias("events"))


def run_audit(events: DataFrame, key: str = "run_id") -> DataFrame:
    """State per run with duration and fields of the execution JSON."""
    state = run_state(events, key)
    audit = F.from_json("execution_json", "fee DOUBLE, effective_price DOUBLE")
    return (state.withColumn("duration", F.col("completed_at") - F.col("started_at"))
            .withColumn("fee", audit["fee"]).withColumn("effective_price", audit["effective_price"]).drop("execution_json"))


def reason_buckets(logs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return logs.groupBy(*keys, text.reason_class(F.col("reason"), F.col("llm_reasoning")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


def audit_rows(logs: DataFrame, actions: Sequence[str] = ("BUY", "SELL"), first_id: int | None = None, start: int | None = None, end: int | None = None,
               id_col: str = "decision_id", action: str = "risk_action", snapshot: str = "snapshot") -> DataFrame:
    """Audited rows of the given actions that carry a snapshot, from an id on and inside a time range, where these are given."""
    rows = logs.filter(F.col(action).isin(*actions) & F.col(snapshot).isNotNull())
    if first_id is not None:
        rows = rows.filter(F.col(id_col) >= first_id)
    if start is not None:
        rows = rows.filter(F.col("ts") >= start)
    return rows if end is None else rows.filter(F.col("ts") <= end)
