"""Registered queries: datasets, sequences, splits, policies and model metrics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.catalog.base import R, RS, query, rnd, rounded, table
from tidemark.catalog.fixtures import BARS, CFG, DECISIONS, FEAT, REG, SCORES, TF, W, bars, decisions, scores
from tidemark.functions import clock, signals
from tidemark.operators import asof, chunks, features, metrics, quality, select
from tidemark.plans import dataset as D
from tidemark.plans import policy, splits
from tidemark.registry import BASELINES, baseline_columns
from tidemark.session import materialize

WIDTH = 168 * 3600
FEATURES = list(CFG.windows.columns)
SHOWN = ["return_5m_pct", "rsi_14", "macd_hist_pct", "donchian_position_20", "drawdown_48_pct"]


def data(spark, sf):
    return D.build_dataset(bars(spark, sf), CFG)


@query("A12_label_distribution", W(FEAT, "SELECT asset, label, count(*) AS n FROM dataset GROUP BY 1, 2", True))
def a12(spark, sf):
    return data(spark, sf).groupBy("asset", "label").agg(F.count(F.lit(1)).alias("n"))


@query("M01_market_dataset", W(FEAT, f"""SELECT asset, ts, segment_id, history_candles, label, label_1440m,
    {RS([*SHOWN, 'future_return_240m_pct'])} FROM dataset""", True))
def m01(spark, sf):
    return rounded(data(spark, sf), ["asset", "ts", "segment_id", "history_candles", "label", "label_1440m"],
                   [*SHOWN, "future_return_240m_pct"])


CONTEXT = """FROM feat WHERE history_candles >= 24 AND observed_coverage_24 >= 0.8 AND return_15m_pct IS NOT NULL
    AND volatility_15m_pct IS NOT NULL AND drawdown_48_pct IS NOT NULL AND donchian_position_20 IS NOT NULL"""


@query("M02_sequence_dataset", W(FEAT, f"SELECT asset, ts, is_observed, label_240m AS label, {RS(SHOWN)} {CONTEXT}", True))
def m02(spark, sf):
    return rounded(D.build_sequence_dataset(bars(spark, sf), CFG), ["asset", "ts", "is_observed", "label"], SHOWN)


@query("M03_halo_chunked_build", W(FEAT, f"SELECT asset, ts, label, {RS(SHOWN)} FROM dataset", True))
def m03(spark, sf):
    # Another chunk length must not change a single row.
    return rounded(D.build_dataset(bars(spark, sf), replace(CFG, chunk_rows=61)), ["asset", "ts", "label"], SHOWN)


DOMAINS = [dict(domain_id=f"d-{a}", exchange="X", market_symbol=a, quote_asset="BRL", asset=a,
                round_trip_cost_pct=float(i * 3)) for i, a in enumerate(("click", "error", "purchase", "signup", "view"))]
DOMAIN_SQL = " ".join(f"WHEN '{d['asset']}' THEN {d['round_trip_cost_pct']}" for d in DOMAINS)


@query("M04_multi_domain", W(FEAT, f"""SELECT 'd-' || asset AS domain_id, label, count(*) AS n FROM (
    SELECT asset, CASE WHEN future_return_240m_pct <= -edge THEN 'SELL' WHEN future_return_240m_pct >= edge THEN 'BUY'
      ELSE 'HOLD' END AS label
    FROM (SELECT *, 1.0 + CASE asset {DOMAIN_SQL} END AS edge FROM dataset)) GROUP BY 1, 2""", True))
def m04(spark, sf):
    return D.compile_domains(bars(spark, sf), DOMAINS, CFG).groupBy("domain_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("P14_domain_tags", W(FEAT, """SELECT 'd-' || asset AS domain_id, 'X' AS exchange, asset AS market_symbol,
    'BRL' AS quote_asset, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM dataset GROUP BY asset""", True))
def p14(spark, sf):
    return (D.compile_domains(bars(spark, sf), DOMAINS, CFG)
            .groupBy("domain_id", "exchange", "market_symbol", "quote_asset")
            .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


SLOW_FEATURES = ["return_5m_pct", "rsi_14"]
NEXT = {"click": "error", "error": "purchase", "purchase": "signup", "signup": "view", "view": "click"}
NEXT_SQL = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NEXT.items())


def _slow(spark, sf):
    local = features.featured_bars(bars(spark, sf), CFG)
    names = F.create_map(*[F.lit(x) for pair in NEXT.items() for x in pair])
    world = features.regularize(bars(spark, sf), CFG).withColumn("asset", names[F.col("asset")])
    return D.build_slow_dataset(
        local, world, SLOW_FEATURES, cadence_minutes=240, horizons=(480, 1440), actionable_move_pct=5.0,
        maximum_price_age_minutes=60, world_returns=(60, 240, 480), gap_return=("return_5m_pct", 240), width=WIDTH)


SLOW = FEAT + f""", aged AS (
  SELECT *, (ts - last_value(CASE WHEN is_observed THEN ts END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts)) / 60.0 AS age
  FROM feat),
wg AS (SELECT CASE asset {NEXT_SQL} END AS asset, ts, close, is_observed FROM reg),
wr AS (
  SELECT w.asset, w.ts,
    CASE WHEN w.is_observed AND a.is_observed THEN (w.close / a.close - 1) * 100 END AS global_return_60m_pct,
    CASE WHEN w.is_observed AND b.is_observed THEN (w.close / b.close - 1) * 100 END AS global_return_240m_pct,
    CASE WHEN w.is_observed AND c.is_observed THEN (w.close / c.close - 1) * 100 END AS global_return_480m_pct
  FROM wg w LEFT JOIN wg a ON a.asset = w.asset AND a.ts = w.ts - 3600
            LEFT JOIN wg b ON b.asset = w.asset AND b.ts = w.ts - 14400
            LEFT JOIN wg c ON c.asset = w.asset AND c.ts = w.ts - 28800),
slow0 AS (
  SELECT l.asset, l.ts, l.close, l.age <= 60 AS is_observed, l.return_5m_pct, l.rsi_14,
    wr.global_return_60m_pct, wr.global_return_240m_pct, wr.global_return_480m_pct,
    l.return_5m_pct - wr.global_return_240m_pct AS cross_market_return_gap_240m_pct,
    sin(2 * pi() * (l.ts % 86400) / 86400.0) AS utc_time_sin,
    cos(2 * pi() * (((l.ts // 86400) + 3) % 7) / 7.0) AS utc_weekday_cos,
    coalesce(f.age <= 60, false) AS future_observed_480m,
    CASE WHEN f.age <= 60 THEN (f.close / l.close - 1) * 100 END AS future_return_480m_pct
  FROM aged l JOIN wr ON wr.asset = l.asset AND wr.ts = l.ts
  LEFT JOIN aged f ON f.asset = l.asset AND f.ts = l.ts + 28800
  WHERE l.ts % 14400 = 0),
slow AS (
  SELECT *, sum(CASE WHEN d IS NULL OR d <> 14400 THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY ts) - 1 AS segment_id,
    CASE WHEN future_return_480m_pct IS NULL THEN NULL WHEN future_return_480m_pct <= -5 THEN 'SELL'
         WHEN future_return_480m_pct >= 5 THEN 'BUY' ELSE 'HOLD' END AS label_480m
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY asset ORDER BY ts) AS d FROM slow0
        WHERE return_5m_pct IS NOT NULL AND rsi_14 IS NOT NULL AND global_return_60m_pct IS NOT NULL
          AND global_return_240m_pct IS NOT NULL AND global_return_480m_pct IS NOT NULL))"""
SLOW_OUT = ["close", "rsi_14", "utc_time_sin", "utc_weekday_cos", "global_return_60m_pct", "global_return_480m_pct",
            "cross_market_return_gap_240m_pct", "future_return_480m_pct"]


@query("M05_slow_two_market_dataset", W(SLOW, f"""SELECT asset, ts, CAST(segment_id AS BIGINT) AS segment_id, is_observed,
    future_observed_480m, label_480m, {RS(SLOW_OUT)} FROM slow""", True))
def m05(spark, sf):
    return rounded(_slow(spark, sf), ["asset", "ts", "segment_id", "is_observed", "future_observed_480m", "label_480m"], SLOW_OUT)


@query("J05_one_to_one_market_join", W(BARS, f"""SELECT a.asset, a.ts, {R('a.close', 'close')}, {R('b.close', 'world_close')}
    FROM bars a JOIN (SELECT CASE asset {NEXT_SQL} END AS asset, ts, close FROM bars) b USING (asset, ts)"""))
def j05(spark, sf):
    names = F.create_map(*[F.lit(x) for pair in NEXT.items() for x in pair])
    local = bars(spark, sf).select("asset", "ts", "close")
    world = local.select(names[F.col("asset")].alias("asset"), "ts", F.col("close").alias("world_close"))
    unique = quality.require_unique(world, ["asset", "ts"])
    return rounded(local.join(unique, ["asset", "ts"]), ["asset", "ts"], ["close", "world_close"])


@query("W19_price_age", W(REG, f"""SELECT asset, ts, {R('(ts - last_value(CASE WHEN is_observed THEN ts END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts)) / 60.0', 'price_age_minutes')}
    FROM reg"""))
def w19(spark, sf):
    aged = D.price_age(features.regularize(bars(spark, sf), CFG), WIDTH)
    return rounded(aged, ["asset", "ts"], ["price_age_minutes"])


@query("W15_gap_segments", W(REG, "SELECT asset, ts, CAST(segment_id AS BIGINT) AS segment_id FROM seg"))
def w15(spark, sf):
    b = bars(spark, sf).select("asset", "ts")
    return chunks.segment_ids(b, ["asset"], "ts", lambda d: d.isNull() | (d > 7200), WIDTH, 7200)


@query("W16_contiguity_segments", W(BARS, """SELECT asset, ts, CAST(sum(CASE WHEN d IS NULL OR d <> 3600 THEN 1 ELSE 0 END)
    OVER (PARTITION BY asset ORDER BY ts) - 1 AS BIGINT) AS segment_id
    FROM (SELECT asset, ts, ts - lag(ts) OVER (PARTITION BY asset ORDER BY ts) AS d FROM bars)"""))
def w16(spark, sf):
    return D.contiguous_segments(bars(spark, sf).select("asset", "ts"), TF, WIDTH)


ENDS = """ends AS (
  SELECT * FROM (SELECT asset, ts, row_number() OVER (PARTITION BY asset ORDER BY ts) AS rn
    FROM (SELECT asset, ts, lag(ts, 5) OVER (PARTITION BY asset ORDER BY ts) AS back FROM bars) WHERE back = ts - 18000)
  WHERE (rn - 1) % 4 = 0)"""


@query("W20_sequence_ends", W(f"{BARS}, {ENDS}", "SELECT asset, ts FROM ends"))
def w20(spark, sf):
    return D.sequence_ends(bars(spark, sf), 6, 4, TF, WIDTH).select("asset", "ts")


@query("W21_sequence_tensors", W(f"{BARS}, {ENDS}", f"""SELECT e.asset, e.ts, count(*) AS steps,
    {R('sum(CAST(b.close AS FLOAT))', 'close_sum', 2)}, {R('sum(b.volume)', 'volume_sum', 2)}
    FROM ends e JOIN bars b ON b.asset = e.asset AND b.ts BETWEEN e.ts - 18000 AND e.ts GROUP BY 1, 2"""))
def w21(spark, sf):
    t = D.sequence_tensors(bars(spark, sf), ["close", "volume"], 6, 4, TF, WIDTH)
    total = lambda i: F.aggregate("sequence", F.lit(0.0), lambda a, v: a + F.get(v, F.lit(i)).cast("double"))
    return t.select("asset", "ts", F.size("sequence").cast("bigint").alias("steps"),
                    rnd(total(0), 2).alias("close_sum"), rnd(total(1), 2).alias("volume_sum"))


@query("M14_sequence_targets", W(FEAT, """SELECT asset, ts FROM (
      SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS rn FROM (
        SELECT asset, ts, is_observed, label_240m, label_1440m,
               future_return_240m_pct, future_return_1440m_pct,
               lag(ts, 3) OVER (PARTITION BY asset ORDER BY ts) AS back """ + CONTEXT + """) WHERE back = ts - 10800)
    WHERE (rn - 1) % 2 = 0 AND is_observed AND label_240m IS NOT NULL AND label_1440m IS NOT NULL
      AND future_return_240m_pct IS NOT NULL AND future_return_1440m_pct IS NOT NULL""", True))
def m14(spark, sf):
    ends = D.sequence_ends(D.build_sequence_dataset(bars(spark, sf), CFG), 4, 2, TF, WIDTH)
    return D.observed_targets(ends, (240, 1440), ("label_240m", "label_1440m")).select("asset", "ts")


@query("M06_first_touch_barriers", W(REG, """SELECT a.asset, a.ts, h.horizon, CAST(CASE
      WHEN NOT a.is_observed OR count(b.ts) < h.horizon OR NOT coalesce(bool_and(b.is_observed), false) THEN -1
      WHEN min(CASE WHEN b.high >= a.close * (1 + h.pct / 100) THEN b.ts END) IS NULL
       AND min(CASE WHEN b.low <= a.close * (1 - h.pct / 100) THEN b.ts END) IS NULL THEN 1
      WHEN min(CASE WHEN b.high >= a.close * (1 + h.pct / 100) THEN b.ts END)
         = min(CASE WHEN b.low <= a.close * (1 - h.pct / 100) THEN b.ts END) THEN -1
      WHEN coalesce(min(CASE WHEN b.high >= a.close * (1 + h.pct / 100) THEN b.ts END), 99999999999)
         < coalesce(min(CASE WHEN b.low <= a.close * (1 - h.pct / 100) THEN b.ts END), 99999999999) THEN 2
      ELSE 0 END AS BIGINT) AS label
    FROM reg a CROSS JOIN (VALUES (4, 10.0), (24, 15.0)) h(horizon, pct)
    LEFT JOIN reg b ON b.asset = a.asset AND b.ts > a.ts AND b.ts <= a.ts + h.horizon * 3600
    GROUP BY a.asset, a.ts, a.is_observed, a.close, h.horizon, h.pct"""))
def m06(spark, sf):
    reg = features.regularize(bars(spark, sf), CFG)
    out = D.barrier_labels(reg, (4, 24), (10.0, 15.0), TF, WIDTH)
    return out.withColumn("label", F.col("label").cast("bigint"))


SPLIT = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS r, count(*) OVER (PARTITION BY asset) AS n FROM dataset),
cuts AS (
  SELECT asset, max(CASE WHEN r = CAST(floor(n * 0.6) AS BIGINT) THEN ts END) AS v_start,
         max(CASE WHEN r = CAST(floor(n * (0.6 + 0.2)) AS BIGINT) THEN ts END) AS t_start
  FROM ranked GROUP BY 1),
split AS (
  SELECT d.*, CASE WHEN d.ts >= t_start THEN 'test' WHEN d.ts >= v_start AND d.ts + 86400 < t_start THEN 'validation'
                   WHEN d.ts + 86400 < v_start THEN 'train' END AS part
  FROM dataset d JOIN cuts USING (asset))"""


def _split(spark, sf):
    return splits.chronological_split(data(spark, sf), WIDTH, purge_minutes=1440)


@query("M07_chronological_split", W(f"{FEAT}, {SPLIT}", "SELECT asset, ts, part FROM split WHERE part IS NOT NULL", True))
def m07(spark, sf):
    return _split(spark, sf).select("asset", "ts", "part")


@query("M08_sub_range_split", W(BARS, """SELECT b.asset, b.ts, CASE WHEN b.ts >= c.s THEN 'second' ELSE 'first' END AS part
    FROM bars b JOIN (SELECT asset, max(CASE WHEN r = CAST(floor(n * 0.7) AS BIGINT) THEN ts END) AS s FROM (
      SELECT asset, ts, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS r, count(*) OVER (PARTITION BY asset) AS n
      FROM bars) GROUP BY 1) c USING (asset)
    WHERE b.ts >= c.s OR b.ts + 7200 < c.s"""))
def m08a(spark, sf):
    return splits.sub_split(bars(spark, sf).select("asset", "ts"), WIDTH, first=0.7, purge_minutes=120)


@query("M08_walk_forward_folds", W(f"""{BARS}, pos AS (
      SELECT asset, ts, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS r, count(*) OVER (PARTITION BY asset) AS n FROM bars),
    fold AS (SELECT asset, unnest(generate_series(0, CAST(floor((n - 360) / 60.0) AS BIGINT))) AS fold FROM (SELECT DISTINCT asset, n FROM pos) WHERE n >= 360),
    part AS (
      SELECT f.asset, f.fold, p.part, a.ts AS start_ts, CASE WHEN p.part = 'test' THEN z.ts ELSE z.ts - 7201 END AS end_ts
      FROM fold f CROSS JOIN (VALUES ('train', 0, 200), ('selection', 200, 260), ('calibration', 260, 300), ('test', 300, 359)) p(part, s, e)
      JOIN pos a ON a.asset = f.asset AND a.r = CASE WHEN p.part = 'train' THEN 0 ELSE p.s + f.fold * 60 END
      JOIN pos z ON z.asset = f.asset AND z.r = p.e + f.fold * 60)""",
    """SELECT p.asset, p.fold, p.part, p.start_ts, p.end_ts, count(*) AS n
    FROM part p JOIN bars b ON b.asset = p.asset AND b.ts BETWEEN p.start_ts AND p.end_ts GROUP BY 1, 2, 3, 4, 5"""))
def m08b(spark, sf):
    b = bars(spark, sf).select("asset", "ts")
    folds = splits.walk_forward_folds(b, WIDTH, minimum_train=200, selection=60, calibration=40, test=60, purge_minutes=120)
    members = splits.fold_members(b, folds)
    n = members.groupBy("asset", "fold", "part").agg(F.count(F.lit(1)).alias("n"))
    return folds.join(n, ["asset", "fold", "part"])


MANIFEST = """span AS (SELECT asset, min(ts) AS a, max(ts) AS z FROM bars GROUP BY 1),
cut AS (
  SELECT asset, a, z, (a + CAST(floor((z - a) * 0.6) AS BIGINT)) // 3600 * 3600 AS c1,
         (a + CAST(floor((z - a) * (0.6 + 0.2)) AS BIGINT)) // 3600 * 3600 AS c2 FROM span),
ranges AS (
  SELECT asset, 'development' AS part, a AS start_ts, c1 - 86400 - 3600 AS end_ts, false AS sealed FROM cut UNION ALL
  SELECT asset, 'validation', c1 + 86400, c2 - 86400 - 3600, false FROM cut UNION ALL
  SELECT asset, 'holdout', c2 + 86400, z, true FROM cut),
inside AS (
  SELECT r.asset, r.part, b.ts, (b.ts - lag(b.ts) OVER (PARTITION BY r.asset, r.part ORDER BY b.ts)) // 3600 - 1 AS gap
  FROM ranges r JOIN bars b ON b.asset = r.asset AND b.ts BETWEEN r.start_ts AND r.end_ts),
stats AS (
  SELECT asset, part, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts,
         CAST(greatest(coalesce(max(gap), 0), 0) AS BIGINT) AS maximum_gap FROM inside GROUP BY 1, 2),
parts AS (
  SELECT r.*, s.rows, s.first_ts, s.last_ts, s.maximum_gap,
         CAST((r.end_ts - r.start_ts) // 3600 + 1 AS BIGINT) AS expected FROM ranges r JOIN stats s USING (asset, part))"""


@query("A02_partition_coverage", W(f"{BARS}, {MANIFEST}", f"""SELECT asset, part, sealed, start_ts, end_ts, rows, first_ts,
    last_ts, maximum_gap, expected, {R('rows / expected::DOUBLE', 'observed_coverage')} FROM parts"""))
def a02(spark, sf):
    b = bars(spark, sf)
    ranges = splits.manifest_ranges(b, step=TF)
    out = splits.partition_coverage(b, ranges, WIDTH, TF)
    return out.withColumn("observed_coverage", F.col("observed_coverage") + 0.0)


@query("J09_partition_membership", W(f"{BARS}, {MANIFEST}", "SELECT asset, part, count(*) AS n, sum(ts) AS ts_sum FROM inside GROUP BY 1, 2"))
def j09(spark, sf):
    b = bars(spark, sf)
    inside = splits.partition_rows(b, splits.manifest_ranges(b, step=TF))
    return inside.groupBy("asset", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("ts_sum"))


def _sources(b):
    day = F.floor(F.col("ts") / 86400).cast("string")
    return (b.groupBy("asset", day.alias("name")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .withColumn("sha256", F.sha2(F.concat_ws("|", "asset", "name", "rows"), 256)))


@query("M09_evaluation_manifest", W(f"""{BARS}, {MANIFEST},
    files AS (SELECT asset, CAST(ts // 86400 AS VARCHAR) AS name, count(*) AS rows, min(ts) AS f, max(ts) AS l FROM bars GROUP BY 1, 2),
    own AS (SELECT asset, sha256(string_agg(t, chr(10) ORDER BY t)) AS source_fingerprint FROM (
      SELECT asset, name || '|' || rows || '|' || f || '|' || l || '|' || sha256(asset || '|' || name || '|' || rows) AS t FROM files) GROUP BY 1),
    con AS (SELECT asset, sha256(string_agg(t, chr(10) ORDER BY t)) AS c FROM (
      SELECT asset, part || '|' || start_ts || '|' || end_ts || '|' || rows || '|' || first_ts || '|' || last_ts || '|' || maximum_gap || '|' || expected AS t
      FROM parts) GROUP BY 1)""",
    """SELECT asset, part, start_ts, end_ts, rows, source_fingerprint,
      substring(sha256('0.6|0.2|1440' || chr(10) || source_fingerprint || chr(10) || c), 1, 24) AS dataset_id
    FROM parts JOIN own USING (asset) JOIN con USING (asset)"""))
def m09(spark, sf):
    b = bars(spark, sf)
    m = splits.evaluation_manifest(b, _sources(b), WIDTH, step=TF)
    return m.select("asset", "part", "start_ts", "end_ts", "rows", "source_fingerprint", "dataset_id")


SIG = """sig AS (SELECT DISTINCT asset, ts FROM bars WHERE close > open)"""


def greedy_sql(sig: str, keys: list[str], spacing: int, name: str = "taken") -> str:
    k, tk = ", ".join(keys), ", ".join(f"t.{x}" for x in keys)
    return f"""{name}_n AS (SELECT *, min(ts) OVER (PARTITION BY {k} ORDER BY ts RANGE BETWEEN {spacing} FOLLOWING AND UNBOUNDED FOLLOWING) AS nts
  FROM (SELECT DISTINCT {k}, ts FROM {sig})),
{name} AS (
  SELECT {k}, min(ts) AS ts FROM {name}_n GROUP BY {k}
  UNION ALL
  SELECT {tk}, n.nts FROM {name} t JOIN {name}_n n USING ({k}, ts) WHERE n.nts IS NOT NULL)"""


@query("T06_greedy_spacing", W(f"{BARS}, {SIG}, {greedy_sql('sig', ['asset'], 18000)}", "SELECT asset, ts FROM taken", True))
def t06(spark, sf):
    sig = bars(spark, sf).filter("close > open")
    return select.greedy_spacing(sig, ["asset"], 18000)


@query("T06_greedy_spacing_dense", W(f"{BARS}, {greedy_sql('bars', ['asset'], 25200)}", "SELECT asset, ts FROM taken", True))
def t06_dense(spark, sf):
    return select.greedy_spacing(bars(spark, sf), ["asset"], 25200, width=2 * 25200)


@query("T07_spread_evenly", W(BARS, """SELECT asset, ts FROM (
      SELECT asset, ts, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS r, count(*) OVER (PARTITION BY asset) AS n FROM bars)
    WHERE r IN (SELECT unnest([CASE WHEN i = 39 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 39.0)) AS BIGINT) END]) FROM range(40) t(i))"""))
def t07(spark, sf):
    return select.spread_evenly(bars(spark, sf).select("asset", "ts"), ["asset"], "ts", 40, WIDTH)


@query("T09_cadence_sample", W(BARS, f"SELECT asset, ts, {R('close')} FROM bars WHERE ts % 14400 = 0"))
def t09(spark, sf):
    return rounded(bars(spark, sf).filter(F.pmod("ts", F.lit(14400)) == 0), ["asset", "ts"], ["close"])


@query("P08_eligible_rows", W(FEAT, "SELECT asset, count(*) AS n, min(ts) AS first_ts FROM dataset GROUP BY 1", True))
def p08(spark, sf):
    return data(spark, sf).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query("P09_labelled_horizon", W(FEAT, "SELECT asset, ts, label_1440m FROM dataset WHERE label_1440m IS NOT NULL AND future_observed_1440m", True))
def p09(spark, sf):
    # Flags read back from text must work as well.
    text = data(spark, sf).withColumn("future_observed_1440m", F.initcap(F.col("future_observed_1440m").cast("string")))
    return D.labelled_horizon(text, 1440).select("asset", "ts", "label_1440m")


@query("S16_export_columns", W(FEAT, f"""SELECT asset, ts, segment_id, is_observed, history_candles, future_observed_240m,
    label_240m, label, {RS(['open', 'high', 'low', 'close', 'volume', *FEATURES, 'future_close_240m', 'future_return_240m_pct'])}
    FROM dataset""", True))
def s16(spark, sf):
    out = D.select_for_export(data(spark, sf), [240], CFG)
    plain = ["asset", "ts", "segment_id", "is_observed", "history_candles", "future_observed_240m", "label_240m", "label"]
    return rounded(out, plain, [c for c in out.columns if c not in plain])


@query("A14_training_readiness", W(FEAT, """, s AS (SELECT count(*) AS n, count(DISTINCT ts // 86400) AS days,
      least(count(*) FILTER (label_240m = 'BUY'), count(*) FILTER (label_240m = 'HOLD'), count(*) FILTER (label_240m = 'SELL')) AS least,
      avg(observed_coverage_24) AS cov, count(DISTINCT (asset, segment_id)) AS segments FROM dataset)
    SELECT segments, 'minimum_rows' AS "check", n >= 1000 AS passed, CAST(n AS DOUBLE) AS actual, 1000.0::DOUBLE AS required FROM s UNION ALL
    SELECT segments, 'minimum_calendar_days', days >= 60, CAST(days AS DOUBLE), 60.0 FROM s UNION ALL
    SELECT segments, 'minimum_rows_per_label', least >= 50, CAST(least AS DOUBLE), 50.0 FROM s UNION ALL
    SELECT segments, 'minimum_mean_coverage', cov >= 0.8, round(cov, 6) + 0.0, 0.8 FROM s""".lstrip(), True).replace("\n, s AS", ", s AS"))
def a14(spark, sf):
    return D.readiness(data(spark, sf), 240, "observed_coverage_24", minimum_rows=1000, minimum_days=60, minimum_per_label=50)


@query("F18_rule_baselines", W(FEAT, """SELECT baseline, predicted, count(*) AS n FROM (
    SELECT unnest([{'baseline': 'always_hold', 'predicted': 'HOLD'},
      {'baseline': 'momentum', 'predicted': CASE WHEN return_15m_pct <= -0.3 THEN 'SELL' WHEN return_15m_pct >= 0.3 THEN 'BUY' ELSE 'HOLD' END},
      {'baseline': 'rsi_mean_reversion', 'predicted': CASE WHEN rsi_14 >= 70 THEN 'SELL' WHEN rsi_14 <= 30 THEN 'BUY' ELSE 'HOLD' END},
      {'baseline': 'trend_confirmation', 'predicted': CASE WHEN ema_9_21_spread_pct < -0.02 AND macd_hist_pct < 0 THEN 'SELL'
         WHEN ema_9_21_spread_pct > 0.02 AND macd_hist_pct > 0 THEN 'BUY' ELSE 'HOLD' END}], recursive := true) FROM dataset)
    GROUP BY 1, 2""", True))
def f18(spark, sf):
    rows = policy.baseline_rows(data(spark, sf), baseline_columns("return_15m_pct"))
    return rows.groupBy("baseline", "predicted").agg(F.count(F.lit(1)).alias("n"))


PRED = """pred AS (
  SELECT asset, part, ts, label_240m AS actual, future_return_240m_pct AS ret, baseline,
    CASE WHEN baseline = 'always_hold' THEN 'HOLD'
      WHEN baseline = 'momentum' THEN CASE WHEN return_15m_pct <= -0.3 THEN 'SELL' WHEN return_15m_pct >= 0.3 THEN 'BUY' ELSE 'HOLD' END
      WHEN baseline = 'rsi_mean_reversion' THEN CASE WHEN rsi_14 >= 70 THEN 'SELL' WHEN rsi_14 <= 30 THEN 'BUY' ELSE 'HOLD' END
      ELSE CASE WHEN ema_9_21_spread_pct < -0.02 AND macd_hist_pct < 0 THEN 'SELL'
                WHEN ema_9_21_spread_pct > 0.02 AND macd_hist_pct > 0 THEN 'BUY' ELSE 'HOLD' END END AS predicted
  FROM split CROSS JOIN (VALUES ('always_hold'), ('momentum'), ('rsi_mean_reversion'), ('trend_confirmation')) b(baseline)
  WHERE part IS NOT NULL),
sg AS (SELECT * FROM pred WHERE predicted <> 'HOLD'),
""" + greedy_sql("sg", ["asset", "part", "baseline"], 14400) + """,
run AS (
  SELECT p.*, t.ts IS NOT NULL AND predicted <> 'HOLD' AS ex,
    CASE WHEN t.ts IS NOT NULL AND predicted <> 'HOLD' THEN CASE predicted WHEN 'BUY' THEN 1 ELSE -1 END * ret - 4 ELSE 0 END AS net
  FROM pred p LEFT JOIN taken t USING (asset, part, baseline, ts)),
eq AS (SELECT *, product(1 + net / 100) OVER (PARTITION BY asset, part, baseline ORDER BY ts) AS e FROM run),
dd AS (SELECT *, (e / max(e) OVER (PARTITION BY asset, part, baseline ORDER BY ts) - 1) * 100 AS d FROM eq),
base AS (
  SELECT asset, part, baseline, count(*) AS rows, avg(CAST(actual = predicted AS INT)) AS accuracy,
    count(*) FILTER (predicted <> 'HOLD') AS signal_count, count(*) FILTER (ex) AS trade_count,
    avg(CAST(ex AS INT)) AS trade_rate,
    coalesce(avg(CAST(actual = predicted AS INT)) FILTER (ex), 0) AS trade_direction_accuracy,
    coalesce(avg(CAST(net > 0 AS INT)) FILTER (ex), 0) AS win_rate_after_cost,
    coalesce(avg(net) FILTER (ex), 0) AS average_trade_return_pct,
    (product(1 + net / 100) - 1) * 100 AS compounded_return_pct, min(d) AS maximum_drawdown_pct
  FROM dd GROUP BY 1, 2, 3),
pr AS (
  SELECT p.asset, p.part, p.baseline, l.l,
    coalesce(count(*) FILTER (actual = l AND predicted = l) / nullif(count(*) FILTER (predicted = l), 0)::DOUBLE, 0) AS p,
    coalesce(count(*) FILTER (actual = l AND predicted = l) / nullif(count(*) FILTER (actual = l), 0)::DOUBLE, 0) AS r
  FROM pred p CROSS JOIN (VALUES ('BUY'), ('HOLD'), ('SELL')) l(l) GROUP BY 1, 2, 3, 4),
mac AS (SELECT asset, part, baseline, avg(p) AS macro_precision, avg(r) AS macro_recall,
  avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS macro_f1 FROM pr GROUP BY 1, 2, 3)"""
M11_OUT = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "trade_rate", "trade_direction_accuracy",
           "win_rate_after_cost", "average_trade_return_pct", "compounded_return_pct", "maximum_drawdown_pct"]


@query("M11_baseline_evaluation", W(f"{FEAT}, {SPLIT}, {PRED}", f"""SELECT asset, part, baseline, rows, signal_count, trade_count,
    signal_count - trade_count AS overlap_skipped, {RS(M11_OUT)} FROM base JOIN mac USING (asset, part, baseline)""", True))
def m11(spark, sf):
    split = splits.chronological_split(materialize(data(spark, sf), "dataset"), WIDTH, purge_minutes=1440)
    out = policy.evaluate_baselines(split, baseline_columns("return_15m_pct"), 240, 4.0)
    return rounded(out, ["asset", "part", "baseline", "rows", "signal_count", "trade_count", "overlap_skipped"], M11_OUT)


@query("D01_registered_baseline", W(FEAT, """SELECT asset, predicted, count(*) AS n FROM (
    SELECT asset, CASE WHEN bollinger_z_20 < -1 THEN 'BUY' WHEN bollinger_z_20 > 1 THEN 'SELL' ELSE 'HOLD' END AS predicted FROM dataset)
    GROUP BY 1, 2""", True))
def d01(spark, sf):
    z = F.col("bollinger_z_20")
    BASELINES.register("band_reversion", lambda: F.when(z < -1, "BUY").when(z > 1, "SELL").otherwise("HOLD"), replace=True)
    rows = policy.baseline_rows(data(spark, sf), {"band_reversion": BASELINES["band_reversion"]})
    return rows.groupBy("asset", "predicted").agg(F.count(F.lit(1)).alias("n"))


CURVE = """tr AS (SELECT asset, ts, (close / open - 1) * 100 AS r FROM bars),
cv AS (SELECT *, product(1 + r / 100) OVER (PARTITION BY asset ORDER BY ts) AS equity FROM tr),
pk AS (SELECT *, max(equity) OVER (PARTITION BY asset ORDER BY ts) AS peak FROM cv)"""


@query("W32_equity_drawdown", W(f"{BARS}, {CURVE}", f"""SELECT asset, ts, {R('equity')}, {R('peak')}, {R('(equity / peak - 1) * 100', 'drawdown_pct')} FROM pk"""))
def w32(spark, sf):
    trades = bars(spark, sf).select("asset", "ts", ((F.col("close") / F.col("open") - 1) * 100).alias("net_return_pct"))
    return rounded(metrics.equity_curve(trades, ["asset"], width=WIDTH), ["asset", "ts"], ["equity", "peak", "drawdown_pct"])


PROB = SCORES + """, ex AS (SELECT *, greatest(sell, hold, buy) AS top FROM scores),
pr0 AS (SELECT *, exp(sell - top) AS x0, exp(hold - top) AS x1, exp(buy - top) AS x2 FROM ex),
pr AS (SELECT *, x0 / (x0 + x1 + x2) AS p0, x1 / (x0 + x1 + x2) AS p1, x2 / (x0 + x1 + x2) AS p2,
  CASE WHEN sell >= hold AND sell >= buy THEN 0 WHEN hold >= buy THEN 1 ELSE 2 END AS pred FROM pr0),
pc AS (SELECT *, greatest(p0, p1, p2) AS conf, CASE actual WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS pt FROM pr)"""


def _side(i, n):
    hit = f"count(*) FILTER (pred = {i} AND actual = {i})"
    return (f"{hit} / greatest(count(*) FILTER (pred = {i}), 1)::DOUBLE AS {n}_precision, "
            f"{hit} / greatest(count(*) FILTER (actual = {i}), 1)::DOUBLE AS {n}_recall")


A16_OUT = ["accuracy", "balanced_accuracy", "macro_f1", "always_hold_accuracy", "predicted_action_rate", "actual_action_rate",
           "sell_precision", "sell_recall", "hold_precision", "hold_recall", "buy_precision", "buy_recall",
           "negative_log_likelihood", "multiclass_brier", "expected_calibration_error"]


@query("A16_probability_metrics", W(PROB + f""", agg AS (
      SELECT horizon, avg(CAST(pred = actual AS INT)) AS accuracy, avg(CAST(actual = 1 AS INT)) AS always_hold_accuracy,
        avg(CAST(pred <> 1 AS INT)) AS predicted_action_rate, avg(CAST(actual <> 1 AS INT)) AS actual_action_rate,
        {_side(0, 'sell')}, {_side(1, 'hold')}, {_side(2, 'buy')},
        avg(-ln(least(greatest(pt, 1e-12), 1))) AS negative_log_likelihood,
        avg((p0 - CAST(actual = 0 AS INT)) ** 2 + (p1 - CAST(actual = 1 AS INT)) ** 2 + (p2 - CAST(actual = 2 AS INT)) ** 2) AS multiclass_brier
      FROM pc GROUP BY 1),
    bins AS (SELECT horizon, ceil(conf * 10) AS b, count(*) AS n, abs(avg(CAST(pred = actual AS INT)) - avg(conf)) AS gap FROM pc GROUP BY 1, 2),
    ece AS (SELECT horizon, sum(n * gap) / sum(n) AS expected_calibration_error FROM bins GROUP BY 1),
    fin AS (SELECT *, (sell_recall + hold_recall + buy_recall) / 3 AS balanced_accuracy,
      (coalesce(2 * sell_precision * sell_recall / nullif(sell_precision + sell_recall, 0), 0)
       + coalesce(2 * hold_precision * hold_recall / nullif(hold_precision + hold_recall, 0), 0)
       + coalesce(2 * buy_precision * buy_recall / nullif(buy_precision + buy_recall, 0), 0)) / 3 AS macro_f1
      FROM agg JOIN ece USING (horizon))""", f"SELECT horizon, {RS(A16_OUT)} FROM fin"))
def a16(spark, sf):
    return rounded(metrics.probability_metrics(scores(spark, sf)), ["horizon"], A16_OUT)


@query("A15_classification", W("""j AS (SELECT CASE WHEN quality = 1 THEN 'BUY' ELSE 'SELL' END AS actual,
      CASE WHEN n_chars > 1500 THEN 'BUY' WHEN n_chars > 700 THEN 'HOLD' ELSE 'SELL' END AS predicted
      FROM labels JOIN documents USING (doc_id)),
    pr AS (SELECT l, coalesce(count(*) FILTER (actual = l AND predicted = l) / nullif(count(*) FILTER (predicted = l), 0)::DOUBLE, 0) AS p,
      coalesce(count(*) FILTER (actual = l AND predicted = l) / nullif(count(*) FILTER (actual = l), 0)::DOUBLE, 0) AS r
      FROM j CROSS JOIN (VALUES ('BUY'), ('HOLD'), ('SELL')) l(l) GROUP BY 1)""",
    f"""SELECT (SELECT count(*) FROM j) AS rows, {R('(SELECT avg(CAST(actual = predicted AS INT)) FROM j)', 'accuracy')},
    {R('avg(p)', 'macro_precision')}, {R('avg(r)', 'macro_recall')},
    {R('avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END)', 'macro_f1')} FROM pr"""))
def a15(spark, sf):
    n = F.col("n_chars")
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(
        F.when(F.col("quality") == 1, "BUY").otherwise("SELL").alias("actual"),
        F.when(n > 1500, "BUY").when(n > 700, "HOLD").otherwise("SELL").alias("predicted"))
    return rounded(metrics.classification(rows, [], "actual", "predicted"), ["rows"],
                   ["accuracy", "macro_precision", "macro_recall", "macro_f1"])


A17_OUT = ["mae_pct", "rmse_pct", "zero_return_mae_pct", "zero_return_rmse_pct", "mae_improvement_over_zero",
           "median_direction_accuracy", "p10_p90_coverage", "mean_interval_width_pct", "quantile_loss"]


@query("A17_quantile_metrics", W(SCORES + """, x AS (SELECT horizon, ret AS y, q[1] AS a, q[2] AS b, q[3] AS c FROM scores),
    m AS (SELECT horizon, avg(abs(b - y)) AS mae_pct, sqrt(avg((b - y) ** 2)) AS rmse_pct, avg(abs(y)) AS zero_return_mae_pct,
      sqrt(avg(y ** 2)) AS zero_return_rmse_pct, avg(CAST(sign(b) = sign(y) AS INT)) AS median_direction_accuracy,
      avg(CAST(y BETWEEN a AND c AS INT)) AS p10_p90_coverage, avg(c - a) AS mean_interval_width_pct,
      avg((greatest(-0.9 * (y - a), 0.1 * (y - a)) + greatest(-0.5 * (y - b), 0.5 * (y - b)) + greatest(-0.1 * (y - c), 0.9 * (y - c))) / 3)
        + 0.1 * avg((greatest(a - b, 0) + greatest(b - c, 0)) / 2) AS quantile_loss FROM x GROUP BY 1)""",
    f"SELECT horizon, {RS([c for c in A17_OUT if c != 'mae_improvement_over_zero'])}, {R('(zero_return_mae_pct - mae_pct) / zero_return_mae_pct', 'mae_improvement_over_zero')} FROM m"))
def a17(spark, sf):
    return rounded(metrics.quantile_metrics(scores(spark, sf)), ["horizon"], A17_OUT)


@query("A18_temperature_grid", W(SCORES + """, g AS (SELECT 10 ** (log10(0.25) + (log10(4.0) - log10(0.25)) * i / 120.0) AS t FROM range(121) r(i)),
    n AS (SELECT horizon, t, avg(ln(exp(sell / t - top) + exp(hold / t - top) + exp(buy / t - top))
        - (CASE actual WHEN 0 THEN sell WHEN 1 THEN hold ELSE buy END / t - top)) AS nll
      FROM (SELECT *, greatest(sell / t, hold / t, buy / t) AS top FROM scores, g) GROUP BY 1, 2)""",
    f"SELECT horizon, {R('arg_min(t, (nll, t))', 'temperature')}, {R('min(nll)', 'nll')} FROM n GROUP BY 1"))
def a18(spark, sf):
    return rounded(metrics.fit_temperatures(scores(spark, sf)), ["horizon"], ["temperature", "nll"])


@query("A18_temperature_applied", W(SCORES, f"SELECT horizon, {R('avg(sell / 2)', 'sell')}, {R('avg(buy / 2)', 'buy')} FROM scores GROUP BY 1"))
def a18b(spark, sf):
    fitted = metrics.fit_temperatures(scores(spark, sf), grid=[2.0])
    out = metrics.apply_temperatures(scores(spark, sf), fitted).groupBy("horizon").agg(F.avg("sell").alias("sell"), F.avg("buy").alias("buy"))
    return rounded(out, ["horizon"], ["sell", "buy"])


SCALED = [f"x{i}" for i in range(7, 13)]
EMB = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(7, 13))


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(7, 13)])


@query("A19_robust_scaler", W(f"""e AS (SELECT vec_id, {EMB} FROM embeddings),
    l AS (UNPIVOT (SELECT {', '.join(SCALED)} FROM e) ON {', '.join(SCALED)} INTO NAME feature VALUE v),
    f AS (SELECT feature, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM l GROUP BY 1)""",
    f"SELECT feature, {R('median')}, {R('CASE WHEN iqr > 1e-8 THEN iqr ELSE 1 END', 'scale')} FROM f"))
def a19(spark, sf):
    return rounded(metrics.fit_robust_scaler(_emb(spark, sf), SCALED, "vec_id", width=100), ["feature"], ["median", "scale"])


@query("A19_robust_scaler_applied", W(f"e AS (SELECT vec_id, {EMB} FROM embeddings), f AS (SELECT "
    + ", ".join(f"median(x{i}) AS m{i}, greatest(quantile_cont(x{i}, 0.75) - quantile_cont(x{i}, 0.25), 1e-8) AS s{i}" for i in (7, 8)) + " FROM e)",
    f"""SELECT vec_id, {R('greatest(-1.5, least(1.5, (x7 - m7) / s7))', 'x7')}, {R('greatest(-1.5, least(1.5, (x8 - m8) / s8))', 'x8')} FROM e, f"""))
def a19b(spark, sf):
    rows = _emb(spark, sf).select("vec_id", "x7", "x8")
    fitted = metrics.fit_robust_scaler(rows, ["x7", "x8"], "vec_id", width=100)
    return rounded(metrics.apply_robust_scaler(rows, fitted, ["x7", "x8"], clip=1.5), ["vec_id"], ["x7", "x8"])


@query("A20_class_weights", W(SCORES + ", c AS (SELECT horizon, actual, count(*) AS n FROM scores GROUP BY 1, 2)",
    f"SELECT horizon, actual, n AS rows, {R('n ** -0.5 / avg(n ** -0.5) OVER (PARTITION BY horizon)', 'weight')} FROM c"))
def a20(spark, sf):
    return rounded(metrics.class_weights(scores(spark, sf), ["horizon"], "actual"), ["horizon", "actual", "rows"], ["weight"])


@query("A11_latency_profile", W(DECISIONS + """, c AS (SELECT proposed_action AS role, decision_id % 50 = 0 AS error, value AS latency_ms FROM decisions),
    l AS (SELECT role, list_sort(list(latency_ms)) AS v FROM c WHERE NOT error GROUP BY 1)""",
    f"""SELECT role, (SELECT count(*) FROM c WHERE error AND c.role = l.role) AS errors, {R('list_avg(v)', 'mean')},
    {R('v[CAST(round_even((len(v) - 1) * 0.5, 0) AS BIGINT) + 1]', 'p50')}, {R('v[CAST(round_even((len(v) - 1) * 0.95, 0) AS BIGINT) + 1]', 'p95')} FROM l"""))
def a11(spark, sf):
    calls = decisions(spark, sf).select(F.col("proposed_action").alias("role"), (F.col("decision_id") % 50 == 0).alias("error"),
                                        F.col("value").alias("latency_ms"))
    return rounded(metrics.latency_profile(calls), ["role", "errors"], ["mean", "p50", "p95"])


@query("F19_model_signals", W(PROB, """SELECT horizon, CAST(CASE
      WHEN p0 >= 0.45 AND p0 - greatest(p2, p1) >= 0.1 THEN -1 WHEN p2 >= 0.45 AND p2 - greatest(p0, p1) >= 0.1 THEN 1 ELSE 0 END AS BIGINT) AS probability,
    CAST(CASE WHEN q[3] < -0.5 THEN -1 WHEN q[1] > 0.5 THEN 1 ELSE 0 END AS BIGINT) AS interval, count(*) AS n FROM pc GROUP BY 1, 2, 3"""))
def f19(spark, sf):
    p = signals.softmax3(F.col("sell"), F.col("hold"), F.col("buy"))
    rows = scores(spark, sf).withColumn("_p", p).select(
        "horizon", signals.probability_signal(F.col("_p"), F.lit(0.45), F.lit(0.1)).cast("bigint").alias("probability"),
        signals.interval_signal(F.get("q", F.lit(0)), F.get("q", F.lit(2)), 0.5).cast("bigint").alias("interval"))
    return rows.groupBy("horizon", "probability", "interval").agg(F.count(F.lit(1)).alias("n"))


def _policy_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""sg AS (SELECT * FROM sp WHERE signal <> 0), {greedy_sql('sg', keys, 3600)},
run AS (SELECT p.*, t.ts IS NOT NULL AND signal <> 0 AS ex, CASE WHEN t.ts IS NOT NULL AND signal <> 0 THEN signal * ret - 0.2 END AS net
  FROM sp p LEFT JOIN taken t USING ({k}, ts)),
eq AS (SELECT *, product(1 + net / 100) OVER (PARTITION BY {k} ORDER BY ts) AS e FROM run WHERE ex),
dd AS (SELECT *, (e / max(e) OVER (PARTITION BY {k} ORDER BY ts) - 1) * 100 AS d FROM eq),
mon AS (SELECT {k}, (product(1 + net / 100) - 1) * 100 AS comp, min(d) AS mdd FROM dd GROUP BY {k}),
pm AS (SELECT r.*, coalesce(comp, 0) AS compounded_return_pct, coalesce(mdd, 0) AS maximum_drawdown_pct FROM (
  SELECT {k}, count(*) AS rows, count(*) FILTER (signal <> 0) AS signals, count(*) FILTER (ex) AS trades,
    avg(CAST(signal = 0 AS INT)) AS abstention_rate, coalesce(avg(CAST(net > 0 AS INT)) FILTER (ex), 0) AS win_rate_after_cost,
    coalesce(avg(net) FILTER (ex), 0) AS average_trade_return_pct,
    coalesce(avg(CAST(signal + 1 = actual AS INT)) FILTER (ex), 0) AS direction_accuracy_on_trades,
    avg(CAST(signal + 1 = actual AS INT)) AS action_accuracy
  FROM run GROUP BY {k}) r LEFT JOIN mon USING ({k}))"""


GRID = PROB + """, gr AS (SELECT c.c AS confidence, m.m AS margin FROM (VALUES (0.40::DOUBLE), (0.45), (0.50), (0.55), (0.60)) c(c),
  (VALUES (0.00::DOUBLE), (0.05), (0.10), (0.15), (0.20)) m(m)),
sp AS (SELECT horizon, confidence, margin, ts, actual, ret,
  CASE WHEN p0 >= confidence AND p0 - greatest(p2, p1) >= margin THEN -1
       WHEN p2 >= confidence AND p2 - greatest(p0, p1) >= margin THEN 1 ELSE 0 END AS signal FROM pc, gr), """ + _policy_sql(["horizon", "confidence", "margin"])
POLICY_OUT = ["abstention_rate", "win_rate_after_cost", "average_trade_return_pct", "direction_accuracy_on_trades",
              "action_accuracy", "compounded_return_pct", "maximum_drawdown_pct"]


@query("M12_policy_metrics", W(GRID, f"SELECT horizon, {RS(['confidence', 'margin', *POLICY_OUT])}, rows, signals, trades FROM pm", True))
def m12(spark, sf):
    grid = [(a, b) for a in policy.CONFIDENCES for b in policy.MARGINS]
    out = policy.evaluate_policy(scores(spark, sf), grid, 60, 0.2)
    return rounded(out, ["horizon", "rows", "signals", "trades"], ["confidence", "margin", *POLICY_OUT])


@query("M12_policy_fit", W(GRID + """, el AS (SELECT *, compounded_return_pct + 0.5 * maximum_drawdown_pct AS score, trades >= 10 AS e,
      trades >= 10 AND compounded_return_pct > 0 AND average_trade_return_pct > 0 AS v FROM pm),
    bc AS (SELECT horizon, count(*) FILTER (e) AS eligible_candidates, count(*) FILTER (v) AS viable_candidates FROM el GROUP BY 1),
    bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY score DESC, average_trade_return_pct DESC,
      win_rate_after_cost DESC, trades, confidence, margin) AS rn FROM el WHERE v) WHERE rn = 1)""",
    f"""SELECT horizon, viable_candidates > 0 AS enabled, eligible_candidates, viable_candidates, coalesce(trades, 0) AS trades,
    {R('coalesce(confidence, 1)', 'confidence')}, {R('coalesce(margin, 1)', 'margin')},
    {R('coalesce(compounded_return_pct, 0)', 'compounded_return_pct')}, {R('coalesce(maximum_drawdown_pct, 0)', 'maximum_drawdown_pct')}
    FROM bc LEFT JOIN bb USING (horizon)""", True))
def m12b(spark, sf):
    out = policy.fit_policy(scores(spark, sf), 60, 0.2)
    return rounded(out, ["horizon", "enabled", "eligible_candidates", "viable_candidates", "trades"],
                   ["confidence", "margin", "compounded_return_pct", "maximum_drawdown_pct"])


@query("M13_interval_policy", W(SCORES + """, sp AS (SELECT horizon, ts, ret,
      CASE WHEN q[3] < -0.3 THEN -1 WHEN q[1] > 0.3 THEN 1 ELSE 0 END AS signal,
      CASE WHEN ret >= 0.3 THEN 2 WHEN ret <= -0.3 THEN 0 ELSE 1 END AS actual FROM scores), """ + _policy_sql(["horizon"]),
    f"SELECT horizon, rows, signals, trades, {RS(POLICY_OUT)} FROM pm", True))
def m13(spark, sf):
    out = policy.evaluate_interval_policy(scores(spark, sf), 60, 0.3, 0.2)
    return rounded(out, ["horizon", "rows", "signals", "trades"], POLICY_OUT)


@query("W31_calendar_features", W(BARS, f"""SELECT asset, ts, {R('sin(2 * pi() * (ts % 86400) / 86400.0)', 'utc_time_sin')},
    {R('cos(2 * pi() * (ts % 86400) / 86400.0)', 'utc_time_cos')}, {R('sin(2 * pi() * ((ts // 86400 + 3) % 7) / 7.0)', 'utc_weekday_sin')},
    {R('cos(2 * pi() * ((ts // 86400 + 3) % 7) / 7.0)', 'utc_weekday_cos')} FROM bars"""))
def w31(spark, sf):
    c = clock.calendar(F.col("ts"))
    return rounded(bars(spark, sf).withColumns(c), ["asset", "ts"], list(c))


@query("J01_exact_lag_join", W(BARS, f"""SELECT b.asset, b.ts, o."offset", {R('n.close', 'at_close')}
    FROM bars b CROSS JOIN (VALUES (-14400), (3600), (86400)) o("offset") LEFT JOIN bars n ON n.asset = b.asset AND n.ts = b.ts + o."offset" """))
def j01(spark, sf):
    out = asof.exact_lag(bars(spark, sf).select("asset", "ts", "close"), [-14400, 3600, 86400], ["close"])
    return rounded(out, ["asset", "ts", "offset"], ["at_close"])


@query("J01_exact_lag_frames", W(BARS, f"""SELECT b.asset, b.ts, {R('p.close', 'past')}, {R('n.close', 'future')} FROM bars b
    LEFT JOIN bars p ON p.asset = b.asset AND p.ts = b.ts - 14400 LEFT JOIN bars n ON n.asset = b.asset AND n.ts = b.ts + 86400"""))
def j01b(spark, sf):
    out = chunks.at_offsets(bars(spark, sf).select("asset", "ts", "close"), ["asset"], "ts", ["close"], [-14400, 86400], WIDTH)
    return out.select("asset", "ts", rnd(F.col("`close@-14400`")).alias("past"), rnd(F.col("`close@86400`")).alias("future"))
