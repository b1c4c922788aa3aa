"""Streaming operators over staged files, compared with their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.plans import reports
from tidemark.streaming import bars, feeds, maturity, state

T0 = 1_800_000_000
CANDLE = "asset string, ts bigint, open double, high double, low double, close double, volume double, received_at bigint"


def candle(ts, close, received=None, asset="A"):
    return (asset, ts, close, close + 1, close - 1, close, 1.0, ts if received is None else received)


def stage(spark, folder, batches, schema):
    """One file per batch, read one file per trigger in name order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def sink(df, folder, mode="append"):
    return df.writeStream.outputMode(mode).format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp"))


def test_candle_feed_replaces_and_rejects(spark, tmp_path):
    feed = stage(spark, tmp_path / "in", [
        [candle(T0, 100.0), candle(T0 + 60, 101.0), candle(T0 + 600, 1.0, T0)],
        [candle(T0 + 60, 105.0, T0 + 90), candle(T0 + 120, -5.0), candle(T0 - 9000, 1.0, T0)],
    ], CANDLE)
    run(feeds.candle_upserts(feed, str(tmp_path / "t"), str(tmp_path / "bad"), str(tmp_path / "cp")))
    got = {r.ts: r.close for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {T0: 100.0, T0 + 60: 105.0}
    bad = {r.ts: r.rejection for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert bad == {T0 + 600: "future", T0 + 120: "malformed", T0 - 9000: "late"}


def test_news_feed_inserts_once(spark, tmp_path):
    schema = "ts bigint, source string, headline string"
    feed = stage(spark, tmp_path / "in", [[(T0, "s", "a"), (T0 + 5, "s", "a")], [(T0 + 9, "s", "a"), (T0 + 9, "x", "a")]], schema)
    run(feeds.news_inserts(feed, str(tmp_path / "t"), str(tmp_path / "cp")))
    again = stage(spark, tmp_path / "in2", [[(T0 + 99999, "s", "a"), (T0 + 99999, "s", "b")]], schema)
    run(feeds.news_inserts(again, str(tmp_path / "t"), str(tmp_path / "cp2")))
    got = sorted((r.source, r.headline) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    assert got == [("s", "a"), ("s", "b"), ("x", "a")]


def test_heartbeats_and_tail(spark, tmp_path):
    feed = stage(spark, tmp_path / "in", [[("price_worker", T0), ("price_worker", T0 + 10)]], "worker string, ts bigint")
    run(feeds.heartbeats(feed, str(tmp_path / "t"), str(tmp_path / "cp"), lambda: T0 + 100))
    assert {r.worker: r.status for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"price_worker": "healthy", "news_worker": "missing"}
    for _ in range(2):
        tail = spark.readStream.schema("worker string, ts bigint").json(str(tmp_path / "in"))
        run(feeds.decision_tail(tail, str(tmp_path / "tail"), str(tmp_path / "tailcp")))
    assert spark.read.parquet(str(tmp_path / "tail")).count() == 2


def test_tumbling_bars_match_batch_and_drop_late_rows(spark, tmp_path):
    rows = [candle(T0 + 60 * i, 100.0 + i % 7) for i in range(120)]
    late = candle(T0 + 60, 900.0)
    end = [candle(T0 + 60 * 600, 1.0)]
    feed = stage(spark, tmp_path / "in", [rows, end, [late], [candle(T0 + 60 * 601, 1.0)]], CANDLE)
    run(sink(bars.tumbling_bars(feed), tmp_path))
    got = spark.read.parquet(str(tmp_path / "out")).filter(F.col("ts") < T0 + 60 * 600)
    want = reports.build_bars(spark.createDataFrame(rows, CANDLE))
    cols = ["bin_end", "ts", "open", "high", "low", "close", "volume", "observations"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_sliding_regimes_label_moves(spark, tmp_path):
    rows = [candle(T0 + 60 * i, 100.0 * (1.001 ** i)) for i in range(180)]
    feed = stage(spark, tmp_path / "in", [rows, [candle(T0 + 60 * 900, 1.0)], [candle(T0 + 60 * 901, 1.0)]], CANDLE)
    run(sink(bars.sliding_regimes(feed, 1.0, 0.2), tmp_path))
    full = spark.read.parquet(str(tmp_path / "out")).filter("candles = 60").collect()
    assert len(full) >= 10
    assert {r.label for r in full} == {"UPTREND"}
    assert all(r.move_pct == pytest.approx((1.001 ** 59 - 1) * 100, abs=1e-3) for r in full)


def test_maturity_join_emits_matches_and_gaps(spark, tmp_path):
    ds = "decision_id bigint, asset string, ts bigint"
    d = stage(spark, tmp_path / "d", [[(1, "A", T0), (2, "A", T0 + 3000)], [(9, "A", T0 + 90000)], [(10, "A", T0 + 90001)]], ds)
    c = stage(spark, tmp_path / "c", [[candle(T0 + 310, 50.0), candle(T0 + 360, 51.0)], [candle(T0 + 90000, 1.0)], [candle(T0 + 90001, 1.0)]], CANDLE)
    run(sink(maturity.maturity_join(d, c, 5), tmp_path))
    got = {r.decision_id: (r.maturity, r.future_price) for r in maturity.first_matches(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got[1] == ("matured", 50.0)
    assert got[2] == ("data_gap", None)


def test_maturity_join_cuts_an_asset_into_stretches(spark, tmp_path):
    """One asset is many keys, and a pair on either side of a stretch's edge still meets once."""
    rng = random.Random(8)
    asked = [(i, "A", T0 + rng.randrange(40_000)) for i in range(400)]
    given = [candle(T0 + rng.randrange(45_000), float(i)) for i in range(300)]
    d = stage(spark, tmp_path / "d", [asked], "decision_id bigint, asset string, ts bigint")
    c = stage(spark, tmp_path / "c", [given], CANDLE)
    run(sink(maturity.maturity_join(d, c, 5, 97, "100 hours"), tmp_path))
    got = sorted((r.decision_id, r.future_ts, r.future_price) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((i, g[1], g[5]) for i, _, ts in asked for g in given if ts + 300 <= g[1] <= ts + 397)
    kept = spark.read.format("statestore").option("joinSide", "left").load(str(tmp_path / "cp"))
    assert kept.select("partition_id").distinct().count() > 1


def shuffled(rows, parts, seed, slack):
    """Batches in which a row comes up to ``slack`` seconds after its time, out of order."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[-1] + rng.randrange(slack))
    return [late[k * len(late) // parts:(k + 1) * len(late) // parts] for k in range(parts)]


def test_cooldown_state_in_any_order(spark, tmp_path):
    """Arrivals out of order over six batches give what one ordered pass gives; the earlier proposal runs though it comes later."""
    schema = "account bigint, action string, decision_id bigint, ts bigint"
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.choice(["BUY", "SELL"]), i, T0 + rng.randrange(20_000)) for i in range(300)]
    rows += [(9, "BUY", 1000, T0 + 1000), (9, "BUY", 1001, T0 + 500)]
    batches = [b + ([rows[-2]] if k == 0 else [rows[-1]] if k == 1 else []) for k, b in enumerate(shuffled(rows[:-2], 6, 5, 500))]
    end = [(99, "BUY", 9000, T0 + 90_000)]
    feed = stage(spark, tmp_path / "in", [*batches, end, [(99, "BUY", 9001, T0 + 90_001)]], schema)
    run(sink(state.cooldown(feed, 900, "10 hours"), tmp_path))
    got = {r.decision_id: r.in_cooldown for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.decision_id < 9000}
    want, last = {}, {}
    for account, action, i, ts in sorted(rows, key=lambda r: (r[3], r[2])):
        want[i] = (account, action) in last and ts <= last[(account, action)] + 900
        if not want[i]:
            last[(account, action)] = ts
    assert got == want and got[1001] is False and got[1000] is True


def test_cooldown_state_of_many_accounts(spark, tmp_path):
    """Accounts share groups of state, and keys without a value are keys of their own; whole numbers stay exact."""
    big = 2 ** 60 + 1
    rng = random.Random(9)
    rows = [(rng.choice([None, big, big + 1, *range(300)]), rng.choice(["BUY", None]), big + i, T0 + rng.randrange(9000)) for i in range(3000)]
    feed = stage(spark, tmp_path / "in", [rows, [(1, "BUY", 1, T0 + 90_000)], [(1, "BUY", 2, T0 + 90_001)]], "account bigint, action string, decision_id bigint, ts bigint")
    timed = sink(state.cooldown(feed, 900, slots=16), tmp_path).trigger(availableNow=True).start()
    assert timed.awaitTermination(120)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in timed.recentProgress) <= 16
    got = {r.decision_id: (r.account, r.action, r.in_cooldown) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.decision_id >= big}
    want, last = {}, {}
    for account, action, i, ts in sorted(rows, key=lambda r: (r[3], r[2])):
        blocked = (account, action) in last and ts <= last[account, action] + 900
        want[i] = (account, action, blocked)
        if not blocked:
            last[account, action] = ts
    assert got == want


def test_daily_drawdown_state_in_any_order(spark, tmp_path):
    schema = "asset string, id bigint, equity double, ts bigint"
    rng = random.Random(6)
    rows = [(rng.choice("AB"), i, 50.0 + rng.randrange(100), T0 + rng.randrange(3 * 86400)) for i in range(200)]
    feed = stage(spark, tmp_path / "in", [*shuffled(rows, 5, 7, 7200), [("Z", 9000, 1.0, T0 + 9 * 86400)], [("Z", 9001, 1.0, T0 + 9 * 86400 + 1)]], schema)
    run(sink(state.daily_drawdown(feed, delay="4 hours"), tmp_path))
    got = {r.id: (r.reference_equity, r.daily_drawdown_pct) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.id < 9000}
    days = {r.id: r.day for r in spark.createDataFrame(rows, schema).withColumn("day", clock.local_day_start(F.col("ts"), clock.DEFAULT_ZONE)).collect()}
    first, want = {}, {}
    for asset, i, equity, ts in sorted(rows, key=lambda r: (r[3], r[1])):
        ref = first.setdefault((asset, days[i]), equity)
        want[i] = (ref, pytest.approx(max(0.0, (ref - equity) / ref * 100)))
    assert got == want
