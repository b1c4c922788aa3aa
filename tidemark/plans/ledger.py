"""Order logs: balances, replay with cost basis, equity, cooldown."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.operators import chunks as C
from tidemark.operators import select

TOLERANCE = 1e-9
REPLAY = ("account bigint, id bigint, action string, equity_before double, gross double, fee double, cash_delta double, "
          "asset_delta double, cash_after double, asset_after double, avg_cost double, realized_pnl double")


def running_balances(deltas: DataFrame, opening: float = 0.0, keys: Sequence[str] = ("account", "currency"),
                     order: str = "id", delta: str = "delta", width: int = 1_000_000,
                     tie: Sequence[str] = ()) -> DataFrame:
    """Balance after every recorded delta."""
    out = C.running_sum(deltas, keys, order, delta, width, "balance", tie)
    return out.withColumn("balance", F.col("balance") + F.lit(opening))


def order_maps(buys: np.ndarray, price: np.ndarray, share: np.ndarray, fee_rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Each order as two linear maps of (cash, holding): as sized, and as large as cash or holding allow.

    An order trades ``share`` of the equity cash + holding x price, so what it
    does to the two balances is linear in them; so is spending all cash or
    selling all of the holding. The second map holds where the first would
    leave a balance below zero.
    """
    n, keep = len(price), 1.0 - fee_rate
    sized, full = np.tile(np.eye(2), (n, 1, 1)), np.zeros((n, 2, 2))
    sign = np.where(buys, 1.0, -1.0)
    paid, got = np.where(buys, 1.0, keep), np.where(buys, keep, 1.0)
    equity = np.stack([np.ones(n), price], axis=1)
    sized[:, 0] -= (sign * share * paid)[:, None] * equity
    sized[:, 1] += (sign * share * got / price)[:, None] * equity
    full[:, 0, 0], full[:, 0, 1] = ~buys, np.where(buys, 0.0, keep * price)
    full[:, 1, 1], full[:, 1, 0] = buys, np.where(buys, keep / price, 0.0)
    return sized, full


def replay_orders(orders: DataFrame, initial_cash: float = 10000.0, initial_asset: float = 0.0,
                  fee_rate: float = 0.003) -> DataFrame:
    """Replay sized orders per account: clamps, fee, average cost, realised result.

    Every order is one of two linear maps of the balances; which one depends on
    the balances before it, so an account is followed in order. Fees, deltas and
    equity are then column arithmetic, and the cost basis a running sum. Rows
    stream through the task sorted by account and order, a batch at a time.
    ``orders``: account, id, action, price, size_pct; optional recorded deltas
    (cash_delta, asset_delta, fee) must be null.
    """
    if initial_cash < 0 or initial_asset < 0 or not 0 <= fee_rate < 1:
        raise ValueError("opening balances and fee rate are invalid")
    bad = (~F.col("action").isin("BUY", "SELL") | F.col("price").isNull() | (F.col("price") <= 0)
           | F.col("size_pct").isNull() | ~F.col("size_pct").between(0, 100))
    for name in ("cash_delta", "asset_delta", "fee"):
        if name in orders.columns:
            bad = bad | F.col(name).isNotNull()
    guard = F.when(~bad, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("order cannot be replayed: "), F.col("id").cast("string"))).cast("boolean"))
    rows = orders.filter(guard).select("account", "id", "action", "price", "size_pct")
    ordered = rows.repartition("account").sortWithinPartitions("account", "id")
    names = [part.split()[0] for part in REPLAY.split(", ")]

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, state, basis, earned = None, None, 0.0, 0.0
        for batch in batches:
            buys = (batch["action"] == "BUY").to_numpy()
            price, share = batch["price"].to_numpy(float), batch["size_pct"].to_numpy(float) / 100.0
            wanted, whole = order_maps(buys, price, share, fee_rate)
            before, after = np.empty((len(batch), 2)), np.empty((len(batch), 2))
            owners = batch["account"].to_numpy()
            fresh = np.empty(len(batch), bool)
            for k, owner in enumerate(owners):
                fresh[k] = owner != account
                if fresh[k]:
                    account, state = owner, np.array([initial_cash, initial_asset])
                before[k] = state
                step = wanted[k] @ state
                state = after[k] = whole[k] @ state if step[0 if buys[k] else 1] < 0 else step
            change = after - before
            gross = np.where(buys, -change[:, 0], -change[:, 1] * price)
            left = np.divide(after[:, 1], before[:, 1], out=np.zeros(len(batch)), where=before[:, 1] > 0)
            keeps, adds = np.where(buys, 1.0, left), np.where(buys, gross, 0.0)
            cost, pnl = np.empty(len(batch)), np.empty(len(batch))
            for k in range(len(batch)):
                if fresh[k]:
                    basis, earned = 0.0, 0.0
                kept = basis * keeps[k]
                earned += 0.0 if buys[k] else change[k, 0] - (basis - kept)
                basis = kept + adds[k] if after[k, 1] > 0 else 0.0
                cost[k], pnl[k] = basis / after[k, 1] if after[k, 1] > 0 else 0.0, earned
            yield pd.DataFrame(dict(zip(names, (owners, batch["id"], batch["action"], before[:, 0] + before[:, 1] * price, gross, gross * fee_rate,
                                                change[:, 0], change[:, 1], after[:, 0], after[:, 1], cost, pnl))))

    return ordered.mapInPandas(replay, REPLAY)


def closing_state(steps: DataFrame) -> DataFrame:
    return steps.groupBy("account").agg(
        *[F.max_by(c, "id").alias(c) for c in ("cash_after", "asset_after", "avg_cost", "realized_pnl")],
        F.count(F.lit(1)).alias("orders"))


def reconcile(closing: DataFrame, observed: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Replayed against observed balances (account, cash, asset)."""
    joined = closing.join(observed, "account", "full_outer")
    close = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance, F.lit(False))
    return joined.withColumn("state", F.when(F.col("cash").isNull() | F.col("asset").isNull(), "INCOMPLETE")
                             .when(F.col("cash_after").isNull(), "NO_ORDERS")
                             .when(close("cash_after", "cash") & close("asset_after", "asset"), "CLOSED").otherwise("MISMATCH"))


def daily_equity(snapshots: DataFrame, zone: str = clock.DEFAULT_ZONE, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Reference equity of the local day, daily drawdown and exposure per snapshot.

    ``snapshots``: keys, id, ts, cash, holding, mark_price. The reference of a day
    is grouped map-side and joined back.
    """
    rows = snapshots.withColumn("day_start", clock.local_day_start(F.col("ts"), zone)).withColumn(
        "equity", F.col("cash") + F.col("holding") * F.col("mark_price"))
    first = rows.groupBy(*keys, "day_start").agg(
        F.min_by(F.struct("equity", "ts"), F.struct("ts", "id")).alias("_first"))
    out = rows.join(first, [*keys, "day_start"])
    ref = F.col("_first.equity")
    return (out.withColumn("reference_equity", ref).withColumn("reference_ts", F.col("_first.ts"))
            .withColumn("daily_drawdown_pct", F.greatest(F.lit(0.0), F.try_divide(ref - F.col("equity"), ref) * 100))
            .withColumn("exposure_pct", F.try_divide(F.col("holding") * F.col("mark_price"), F.col("equity")) * 100)
            .drop("_first"))


def cooldown_replay(proposals: DataFrame, keys: Sequence[str], seconds: int, id_col: str) -> DataFrame:
    """Mark proposals that fall within the cooldown of an executed one.

    A proposal runs when the last run lies more than ``seconds`` back, which is
    greedy spacing per key; of several in one second the lowest id runs.
    """
    heads = proposals.groupBy(*keys, "ts").agg(F.min(id_col).alias("_head"))
    taken = select.greedy_spacing(heads, keys, seconds + 1).withColumn("_ran", F.lit(True))
    rows = proposals.join(heads, [*keys, "ts"]).join(taken, [*keys, "ts"], "left")
    return rows.withColumn("in_cooldown", F.col("_ran").isNull() | (F.col(id_col) != F.col("_head"))).drop("_ran", "_head")


def account_dashboard(balances: DataFrame, prices: DataFrame, equity: DataFrame, now: int) -> DataFrame:
    """Equity, exposure and daily drawdown per account.

    ``balances``: account, asset, cash, holding (latest); ``prices``: asset, ts,
    close; ``equity``: account snapshots with reference_equity of the day.
    """
    latest = select.latest_per_key(prices.select("asset", "ts", "close"), ["asset"], ["ts"])
    day = select.latest_per_key(equity.select("account", "ts", "reference_equity"), ["account"], ["ts"])
    rows = balances.join(latest.withColumnRenamed("ts", "price_ts"), "asset", "left").join(
        day.withColumnRenamed("ts", "snapshot_ts"), "account", "left")
    held = F.col("holding") * F.coalesce("close", F.lit(0.0))
    total = F.col("cash") + held
    drop = F.when((F.col("reference_equity") > 0) & (total > 0), F.greatest(
        F.lit(0.0), (F.col("reference_equity") - total) / F.col("reference_equity") * 100))
    return (rows.withColumn("equity", total).withColumn("exposure_pct", F.when(total != 0, held / total * 100).otherwise(0.0))
            .withColumn("daily_drawdown_pct", drop).withColumn("price_age", F.lit(now) - F.col("price_ts")))
