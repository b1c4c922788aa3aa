"""Per-account and per-day state on streams."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import clock

COOLDOWN_OUT = "account bigint, action string, decision_id bigint, ts bigint, in_cooldown boolean"
#: Executed times by (account, action), then the waiting rows.
COOLDOWN_STATE = ("done_accounts array<string>, done_actions array<string>, executed array<bigint>, "
                  "accounts array<string>, actions array<string>, times array<bigint>, ids array<bigint>")
#: Groups that the state of all accounts is dealt to.
SLOTS = 4096
EQUITY_OUT = "asset string, day_start bigint, id bigint, ts bigint, reference_equity double, daily_drawdown_pct double"


def _settled(buffered: pd.DataFrame, state: GroupState) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows that no later arrival can come before (older than the watermark, in order), and the rest.

    Rows behind the watermark never reach the state, so what is settled is final
    however the rows were dealt to batches.
    """
    done = buffered["ts"] * 1000 < state.getCurrentWatermarkMs()
    return buffered[done], buffered[~done]


def _wait(state: GroupState, *times_ms: int) -> None:
    """Calls the group again once the watermark has passed the first of these times."""
    state.setTimeoutTimestamp(max(min(times_ms), state.getCurrentWatermarkMs() + 1))


def cooldown(proposals: DataFrame, seconds: int = 900, delay: str = "10 minutes", slots: int = SLOTS) -> DataFrame:
    """Mark proposals within the cooldown of the last executed one per (account, action).

    Proposals wait until the watermark has passed them and are then judged in
    order of (ts, decision_id), so the answer does not depend on the batches they
    came in; one without a time is never judged. State is the last executed time
    and the waiting rows of each (account, action); it ends once the watermark has
    passed the cooldown. ``slots`` groups by hash hold the state, each of many
    accounts, since calling a group costs far more than judging a row.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *marks, accounts, actions, times, ids = state.get if state.exists else ([],) * 7
        executed = {(account, action): ts for account, action, ts in zip(*marks)}
        rows = [*zip(accounts, actions, times, ids)]
        for b in batches:
            rows += zip(b["account"], b["action"], b["ts"].tolist(), [None if i is None else int(i) for i in b["id"]])
        rows.sort(key=lambda r: (r[2], r[3] is None, r[3] or 0))
        passed = state.getCurrentWatermarkMs()
        done = bisect_left(rows, passed, key=lambda r: r[2] * 1000)
        blocked = []
        for account, action, ts, _ in rows[:done]:
            last = executed.get((account, action))
            blocked.append(last is not None and ts <= last + seconds)
            if not blocked[-1]:
                executed[account, action] = ts
        rest = rows[done:]
        waiting = {r[:2] for r in rest}
        kept = [(*k, ts) for k, ts in executed.items() if k in waiting or (ts + seconds) * 1000 >= passed]
        if kept or rest:
            columns = lambda table, n: [list(c) for c in zip(*table)] or [[] for _ in range(n)]
            state.update((*columns(kept, 3), *columns(rest, 4)))
            _wait(state, *[r[2] * 1000 for r in rest[:1]], *[(ts + seconds) * 1000 + 1 for _, _, ts in kept])
        elif state.exists:
            state.remove()
        if not done:
            return
        judged = pd.DataFrame(rows[:done], columns=["account", "action", "ts", "decision_id"], dtype=object)
        yield judged.astype({"ts": "int64"}).assign(decision_id=judged["decision_id"].astype("Int64"), in_cooldown=np.array(blocked, bool))

    # Ids and accounts travel as text: a null among whole numbers would make pandas round them.
    timed = proposals.filter(F.col("ts").isNotNull()).withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    slotted = timed.select(F.pmod(F.xxhash64("account", "action"), F.lit(slots)).alias("slot"), F.col("account").cast("string").alias("account"), "action", "ts",
                           F.col("decision_id").cast("string").alias("id"), "event_time")
    judged = slotted.groupBy("slot").applyInPandasWithState(step, COOLDOWN_OUT.replace("account bigint", "account string"), COOLDOWN_STATE, "append",
                                                           GroupStateTimeout.EventTimeTimeout)
    return judged.withColumn("account", F.col("account").cast("bigint"))


def daily_drawdown(snapshots: DataFrame, zone: str = clock.DEFAULT_ZONE, delay: str = "1 hour") -> DataFrame:
    """Drawdown against the first snapshot of the local day.

    ``snapshots``: asset, id, ts, equity. Rows wait until the watermark has
    passed them, so the first one of a day is known whenever it arrived. State
    is that row and the waiting ones, until the day and the delay are over.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reference, times, ids, values = state.get if state.exists else (None, [], [], [])
        waiting = pd.DataFrame({"ts": np.array(times, "int64"), "id": np.array(ids, "int64"), "equity": np.array(values, "float64")})
        rows, rest = _settled(pd.concat([waiting, *[b[["ts", "id", "equity"]] for b in batches]]).sort_values(["ts", "id"]), state)
        if reference is None and len(rows):
            reference = float(rows["equity"].iloc[0])
        over = (int(key[1]) + 2 * 86400) * 1000
        if len(rest) or over > state.getCurrentWatermarkMs():
            state.update((reference, rest["ts"].tolist(), rest["id"].tolist(), rest["equity"].tolist()))
            _wait(state, over, *(rest["ts"].head(1) * 1000).tolist())
        elif state.exists:
            state.remove()
        drop = ((reference - rows["equity"]) / reference * 100).clip(lower=0.0) if len(rows) else rows["equity"]
        yield pd.DataFrame({"asset": key[0], "day_start": key[1], "id": rows["id"], "ts": rows["ts"], "reference_equity": reference, "daily_drawdown_pct": drop})

    timed = (snapshots.withColumn("day_start", clock.local_day_start(F.col("ts"), zone)).withColumn("event_time", F.timestamp_seconds("ts"))
             .withWatermark("event_time", delay))
    return timed.groupBy("asset", "day_start").applyInPandasWithState(
        step, EQUITY_OUT, "reference double, times array<bigint>, ids array<bigint>, equities array<double>", "append", GroupStateTimeout.EventTimeTimeout)
