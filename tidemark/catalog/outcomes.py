"""Registered queries: as-of lookups, outcomes, campaigns, regimes and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import R, RS, query, rnd, rounded, table
from tidemark.catalog.datasets import WIDTH, greedy_sql
from tidemark.catalog.fixtures import BARS, DECISIONS, NEWS, TF, W, bars, decisions, news
from tidemark.functions import costs, gate
from tidemark.operators import asof, quality, select
from tidemark.plans import outcomes as O
from tidemark.plans import regimes

HORIZONS = (60, 240)
TOL = 1800

AS = """dh AS (SELECT d.*, h.h AS horizon_min, d.ts + h.h * 60 AS target FROM decisions d, (VALUES (60), (240)) h(h)),
latest AS (SELECT asset, max(ts) AS newest FROM bars GROUP BY 1),
found AS (
  SELECT dh.*, CASE WHEN b.ts <= target + 1800 THEN b.ts END AS future_ts, CASE WHEN b.ts <= target + 1800 THEN b.close END AS future_price, newest
  FROM dh ASOF LEFT JOIN bars b ON dh.asset = b.asset AND dh.target <= b.ts LEFT JOIN latest ON latest.asset = dh.asset),
mat AS (SELECT *, CASE WHEN future_ts IS NOT NULL THEN 'matured' WHEN newest IS NULL OR newest < target THEN 'not_matured' ELSE 'data_gap' END AS maturity FROM found),
oc AS (SELECT *, CASE WHEN risk_action IN ('BUY', 'SELL') AND effective_price IS NOT NULL THEN effective_price ELSE execution_price END AS base FROM mat),
om AS (SELECT *, CASE WHEN maturity = 'matured' THEN (future_price - base) / base * 100 END AS move_pct FROM oc),
ev AS (SELECT *, CASE WHEN maturity <> 'matured' THEN maturity ELSE CASE risk_action
  WHEN 'BUY' THEN CASE WHEN move_pct >= 2 THEN 'good' WHEN move_pct <= -2 THEN 'bad' ELSE 'neutral' END
  WHEN 'SELL' THEN CASE WHEN move_pct >= 2 THEN 'bad' WHEN move_pct <= -2 THEN 'good' ELSE 'neutral' END
  ELSE CASE WHEN move_pct >= 2 THEN 'missed_upside' WHEN move_pct <= -2 THEN 'avoided_downside' ELSE 'good' END END END AS status FROM om)"""
BASE = f"{BARS}, {DECISIONS}, {AS}"


def _outcomes(spark, sf):
    return O.decision_outcomes(decisions(spark, sf), bars(spark, sf), HORIZONS, 2.0, TOL)


@query("J03_forward_asof_maturity", W(BASE, f"SELECT decision_id, horizon_min, maturity, future_ts, {R('future_price')} FROM mat"))
def j03(spark, sf):
    d = O.with_horizons(decisions(spark, sf), HORIZONS)
    out = asof.maturity(d, bars(spark, sf), "target_ts", TOL)
    return rounded(out, ["decision_id", "horizon_min", "maturity", "future_ts"], ["future_price"])


@query("J04_backward_asof_staleness", W(f"{BARS}, {DECISIONS}", f"""SELECT decision_id, CASE WHEN b.ts >= d.target - 7200 THEN b.ts END AS past_ts,
    {R('CASE WHEN b.ts >= d.target - 7200 THEN b.close END', 'past_price')},
    CASE WHEN b.ts IS NULL OR b.ts < d.target - 7200 THEN 'NOT_MATURED' ELSE CASE proposed_action
      WHEN 'BUY' THEN CASE WHEN m >= 2 THEN 'GOOD' WHEN m <= -2 THEN 'BAD' ELSE 'NEUTRAL' END
      WHEN 'SELL' THEN CASE WHEN m >= 2 THEN 'BAD' WHEN m <= -2 THEN 'GOOD' ELSE 'NEUTRAL' END
      ELSE CASE WHEN abs(m) < 2 THEN 'GOOD' WHEN m > 0 THEN 'MISSED_UPSIDE' ELSE 'AVOIDED_DOWNSIDE' END END END AS score
    FROM (SELECT *, (close / execution_price - 1) * 100 AS m FROM (SELECT *, ts + 14400 AS target FROM decisions) x
      ASOF LEFT JOIN (SELECT asset AS ba, ts AS bts, close FROM bars) y ON x.asset = y.ba AND x.target >= y.bts) d
    LEFT JOIN bars b ON b.asset = d.ba AND b.ts = d.bts"""))
def j04(spark, sf):
    d = decisions(spark, sf).withColumn("target", F.col("ts") + 14400)
    out = asof.backward_asof(d, bars(spark, sf), "target", 7200, ["close"])
    move = (F.col("past.close") / F.col("execution_price") - 1) * 100
    return out.select("decision_id", F.col("past.ts").alias("past_ts"), rnd(F.col("past.close")).alias("past_price"),
                      costs.stale_score(F.col("proposed_action"), move, 2.0).alias("score"))


@query("J02_trailing_bars", W(f"""{BARS}, {DECISIONS}, br AS (SELECT asset, ts, row_number() OVER w AS r, first_value(ts) OVER v AS first_ts, sum(close) OVER v AS total
      FROM bars WINDOW w AS (PARTITION BY asset ORDER BY ts), v AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))""",
    f"""SELECT decision_id, coalesce(least(r, 50), 0) AS n, first_ts, b.ts AS last_ts, {R('coalesce(total, 0)', 'close_sum', 4)}
    FROM decisions d ASOF LEFT JOIN br b ON b.asset = d.asset AND d.ts >= b.ts"""))
def j02(spark, sf):
    out = asof.trailing_context(decisions(spark, sf), bars(spark, sf), 50, ["close"], WIDTH // 4)
    total = F.aggregate("tail", F.lit(0.0), lambda a, x: a + x["close"])
    return out.select("decision_id", F.size("tail").cast("bigint").alias("n"), F.get("tail", F.lit(0))["ts"].alias("first_ts"),
                      F.try_element_at("tail", F.lit(-1))["ts"].alias("last_ts"), rnd(total, 4).alias("close_sum"))


@query("P04_as_of_scan", W(BARS, f"""SELECT asset, ts, {R('close')} FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS rn
    FROM bars WHERE ts <= 1705000000) WHERE rn <= 30"""))
def p04(spark, sf):
    return rounded(asof.as_of(bars(spark, sf), 1705000000, 30), ["asset", "ts"], ["close"])


@query("P05_recent_news", W(f"{DECISIONS}, {NEWS}", """SELECT decision_id, count(news_id) AS n, max(news_id) AS newest, min(ts) AS oldest_ts
    FROM (SELECT d.decision_id, n.news_id, n.ts, row_number() OVER (PARTITION BY d.decision_id ORDER BY n.ts DESC, n.news_id DESC) AS rn
      FROM decisions d LEFT JOIN news n ON n.ts BETWEEN d.ts - 86400 AND d.ts + 300) WHERE rn <= 5 GROUP BY 1"""))
def p05(spark, sf):
    from tidemark.plans.snapshot import recent_news
    out = recent_news(decisions(spark, sf), news(spark, sf).select("news_id", "ts"))
    items = F.col("news")
    return out.select("decision_id", F.size(items).cast("bigint").alias("n"), F.array_max(F.transform(items, lambda x: x["news_id"])).alias("newest"),
                      F.array_min(F.transform(items, lambda x: x["ts"])).alias("oldest_ts"))


@query("M15_decision_outcomes", W(BASE, f"SELECT decision_id, horizon_min, maturity, status, {R('move_pct', digits=4)} FROM ev"))
def m15(spark, sf):
    return rounded(_outcomes(spark, sf), ["decision_id", "horizon_min", "maturity", "status"], ["move_pct"], 4)


COUNTS = ", ".join([*[f"count(*) FILTER (maturity = '{m}') AS {m}" for m in O.MATURITIES],
                    *[f"count(*) FILTER (status = '{s}') AS {s}" for s in O.STATUSES]])


@query("F15_outcome_counts", W(BASE, f"SELECT horizon_min, {COUNTS} FROM ev GROUP BY 1"))
def f15(spark, sf):
    return O.outcome_counts(_outcomes(spark, sf))


@query("A26_evaluation_gate", W(BASE, """SELECT g.*, CASE WHEN logs_evaluated <= 0 OR data_gaps > 0 THEN 'BLOCKED' WHEN not_matured > 0 THEN 'PENDING' ELSE 'READY' END AS state
    FROM (SELECT CAST(count(*) FILTER (maturity = 'data_gap') AS BIGINT) AS data_gaps, count(*) FILTER (maturity = 'not_matured') AS not_matured,
      (SELECT count(*) FROM decisions) AS logs_evaluated FROM ev) g"""))
def a26(spark, sf):
    return O.evaluation_gate(O.outcome_counts(_outcomes(spark, sf)), decisions(spark, sf))


@query("M31_finalize_after", W(DECISIONS, """SELECT account, max(ts) AS session_end, max(ts) + 1440 * 60 + 1200 + 90 AS finalize_after,
    max(ts) + 1440 * 60 + 1290 <= 1706659200 AS mature FROM decisions GROUP BY 1"""))
def m31(spark, sf):
    s = decisions(spark, sf).groupBy("account").agg(F.max("ts").alias("session_end"))
    s = s.withColumn("finalize_after", O.finalize_after(F.col("session_end"), (60, 1440)))
    return s.withColumn("mature", F.col("finalize_after") <= 1706659200)


ENTRY = """en AS (SELECT *, CASE WHEN risk_action IN ('BUY', 'SELL') THEN 'approved' WHEN proposed_action IN ('BUY', 'SELL') THEN 'blocked' ELSE 'ignored' END AS kind FROM om),
es AS (SELECT *, CASE WHEN maturity <> 'matured' THEN maturity ELSE CASE CASE WHEN kind = 'approved' THEN risk_action ELSE 'HOLD' END
  WHEN 'BUY' THEN CASE WHEN move_pct >= 2 THEN 'good' WHEN move_pct <= -2 THEN 'bad' ELSE 'neutral' END
  WHEN 'SELL' THEN CASE WHEN move_pct >= 2 THEN 'bad' WHEN move_pct <= -2 THEN 'good' ELSE 'neutral' END
  ELSE CASE WHEN move_pct >= 2 THEN 'missed_upside' WHEN move_pct <= -2 THEN 'avoided_downside' ELSE 'good' END END END AS status FROM en WHERE kind <> 'ignored')"""


@query("M16_entry_analysis", W(f"{BASE}, {ENTRY}", f"SELECT kind, horizon_min, status, count(*) AS n, {R('avg(move_pct)', 'mean_move_pct', 4)} FROM es GROUP BY 1, 2, 3"))
def m16(spark, sf):
    e = O.entry_outcomes(decisions(spark, sf), bars(spark, sf), HORIZONS, 2.0, TOL)
    out = e.groupBy("kind", "horizon_min", "status").agg(F.count(F.lit(1)).alias("n"), F.avg("move_pct").alias("mean_move_pct"))
    return rounded(out, ["kind", "horizon_min", "status", "n"], ["mean_move_pct"], 4)


@query("S15_evaluations_wide", W(BASE, f"""SELECT decision_id, proposed_action, max(status) FILTER (horizon_min = 60) AS "60m Status",
    {R('max(move_pct) FILTER (horizon_min = 60)', '"60m Move %"', 4)}, max(status) FILTER (horizon_min = 240) AS "240m Status",
    {R('max(move_pct) FILTER (horizon_min = 240)', '"240m Move %"', 4)} FROM ev GROUP BY 1, 2"""))
def s15(spark, sf):
    wide = O.evaluations_wide(_outcomes(spark, sf), ["decision_id", "proposed_action"], HORIZONS)
    return wide.select(*[rnd(F.col(f"`{c}`"), 4).alias(c) if c.endswith("%") else F.col(f"`{c}`") for c in wide.columns])


REASONED = "CASE WHEN conviction < 70 THEN 'Conviccao bruta' WHEN decision_id % 4 = 0 THEN 'Directional Gate: x' ELSE 'Aprovado' END"


@query("P17_interesting_examples", W(BASE, f"""SELECT decision_id, proposed_action, risk_action FROM (
      SELECT d.*, {REASONED} AS reason, (SELECT bool_or(e.status IN ('bad', 'missed_upside')) FROM ev e WHERE e.decision_id = d.decision_id) AS poor FROM decisions d)
    WHERE risk_action = 'BUY' OR proposed_action <> risk_action OR poor OR reason LIKE '%Directional Gate%' ORDER BY decision_id LIMIT 12"""))
def p17(spark, sf):
    d = decisions(spark, sf).withColumn("reason", F.expr(REASONED))
    return O.interesting(d, _outcomes(spark, sf)).select("decision_id", "proposed_action", "risk_action")


RESULTS = """res AS (SELECT decision_id, asset, ts, variant, proposed_action, risk_action, conviction, executed_size, execution_price AS price,
  CASE decision_id % 4 WHEN 0 THEN 'UPTREND' WHEN 1 THEN 'DOWNTREND' WHEN 2 THEN 'SIDEWAYS' ELSE 'HIGH_VOLATILITY' END AS regime,
  CASE decision_id % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' WHEN 2 THEN 'HOLD' END AS expected_action,
  CASE WHEN decision_id % 20 = 0 THEN 'ERROR' ELSE 'OK' END AS status, decision_id % 11 = 0 AS technical_failure,
  least(0.003, greatest(0.0005, value / execution_price * 0.1)) AS slippage_rate, value AS atr FROM decisions)"""


def results(spark, sf):
    d = decisions(spark, sf)
    m = F.col("decision_id") % 4
    return d.select(
        "decision_id", "asset", "ts", "variant", "proposed_action", "risk_action", "conviction", "executed_size",
        F.col("execution_price").alias("price"),
        F.when(m == 0, "UPTREND").when(m == 1, "DOWNTREND").when(m == 2, "SIDEWAYS").otherwise("HIGH_VOLATILITY").alias("regime"),
        F.when(m == 0, "BUY").when(m == 1, "SELL").when(m == 2, "HOLD").alias("expected_action"),
        F.when(F.col("decision_id") % 20 == 0, "ERROR").otherwise("OK").alias("status"),
        (F.col("decision_id") % 11 == 0).alias("technical_failure"),
        costs.slippage_rate(F.col("value"), F.col("execution_price")).alias("slippage_rate"), F.col("value").alias("atr"))


CAMP = f"""{BARS}, {DECISIONS}, {RESULTS},
dh AS (SELECT r.*, h.h AS horizon_min, r.ts + h.h * 60 AS target FROM res r, (VALUES (60), (240)) h(h) WHERE status = 'OK'),
latest AS (SELECT asset, max(ts) AS newest FROM bars GROUP BY 1),
found AS (SELECT dh.*, CASE WHEN b.ts <= target + 1800 THEN b.close END AS future_price, newest
  FROM dh ASOF LEFT JOIN bars b ON dh.asset = b.asset AND dh.target <= b.ts LEFT JOIN latest ON latest.asset = dh.asset),
cm AS (SELECT *, CASE WHEN future_price IS NOT NULL THEN 'matured' WHEN newest IS NULL OR newest < target THEN 'not_matured' ELSE 'data_gap' END AS maturity,
  (future_price - price) / price * 100 AS m, 200 * (0.003 + slippage_rate) AS bc, 100 * (0.003 + slippage_rate) AS sc FROM found),
ce AS (SELECT *, CASE risk_action WHEN 'BUY' THEN m - bc WHEN 'SELL' THEN -m - sc ELSE 0 END AS edge,
  CASE proposed_action WHEN 'BUY' THEN m - bc WHEN 'SELL' THEN -m - sc ELSE 0 END AS ledge FROM cm),
co AS (SELECT *, edge * executed_size / 100 AS wedge,
  CASE WHEN maturity = 'matured' THEN CASE WHEN risk_action IN ('BUY', 'SELL') THEN CASE WHEN edge >= 1 THEN 'good' WHEN edge <= -1 THEN 'bad' ELSE 'neutral' END
    ELSE CASE WHEN m >= 1 + bc THEN 'missed_upside' WHEN m <= -(1 + sc) THEN 'avoided_downside' ELSE 'good' END END END AS rs,
  CASE WHEN maturity = 'matured' THEN CASE WHEN proposed_action IN ('BUY', 'SELL') THEN CASE WHEN ledge >= 1 THEN 'good' WHEN ledge <= -1 THEN 'bad' ELSE 'neutral' END
    ELSE CASE WHEN m >= 1 + bc THEN 'missed_upside' WHEN m <= -(1 + sc) THEN 'avoided_downside' ELSE 'good' END END END AS ls FROM ce)"""


def _campaign(spark, sf):
    ok = results(spark, sf).filter("status = 'OK'")
    return O.campaign_outcomes(ok, bars(spark, sf), HORIZONS, 1.0, tolerance=TOL)


@query("F16_net_outcomes", W(CAMP, f"""SELECT decision_id, horizon_min, rs AS risk_status, ls AS llm_status,
    {R("CASE WHEN maturity = 'matured' THEN edge END", 'edge_pct')}, {R("CASE WHEN maturity = 'matured' THEN wedge END", 'weighted_edge_pct')} FROM co"""))
def f16(spark, sf):
    return rounded(_campaign(spark, sf), ["decision_id", "horizon_min", "risk_status", "llm_status"], ["edge_pct", "weighted_edge_pct"])


D = "maturity = 'matured' AND risk_action IN ('BUY', 'SELL')"
A07_SQL = f"""SELECT variant, horizon_min, {', '.join(f"count(*) FILTER (maturity = '{m}') AS {m}" for m in O.MATURITIES)},
    {', '.join(f"count(*) FILTER (maturity = 'matured' AND rs = '{s}') AS {s}" for s in O.STATUSES[:-1])},
    count(*) FILTER ({D}) AS directional_samples, count(*) FILTER ({D} AND rs = 'good') AS directional_good,
    count(*) FILTER ({D} AND rs = 'bad') AS directional_bad, count(*) FILTER ({D} AND rs = 'neutral') AS directional_neutral,
    {R(f"count(*) FILTER ({D}) / count(*) FILTER (maturity = 'matured')::DOUBLE", 'directional_coverage', 4)},
    {R(f"count(*) FILTER ({D} AND rs = 'good') / count(*) FILTER ({D} AND rs IN ('good', 'bad'))::DOUBLE", 'directional_precision', 4)},
    {R(f"avg(edge) FILTER ({D})", 'average_edge_pct', 4)}, {R(f"avg(wedge) FILTER ({D})", 'average_weighted_edge_pct', 4)}"""
A07_PLAIN = ["matured", "not_matured", "data_gap", *O.STATUSES[:-1], "directional_samples", "directional_good", "directional_bad", "directional_neutral"]
A07_DOUBLE = ["directional_coverage", "directional_precision", "average_edge_pct", "average_weighted_edge_pct"]


@query("A07_horizon_summary", W(CAMP, A07_SQL + " FROM co GROUP BY 1, 2"))
def a07(spark, sf):
    return rounded(O.horizon_summary(_campaign(spark, sf)), ["variant", "horizon_min", *A07_PLAIN], A07_DOUBLE, 4)


@query("A06_campaign_counts", W(f"{DECISIONS}, {RESULTS}", """SELECT variant, count(*) FILTER (status = 'OK') AS samples, count(*) FILTER (status <> 'OK') AS errors,
    count(*) FILTER (status = 'OK' AND technical_failure) AS technical_failures,
    """ + ", ".join(f"count(*) FILTER (status = 'OK' AND {c} = '{a}') AS {n}_{a.lower()}" for n, c in (("llm", "proposed_action"), ("risk", "risk_action")) for a in ("BUY", "SELL", "HOLD"))
    + " FROM res GROUP BY 1"))
def a06(spark, sf):
    return O.campaign_counts(results(spark, sf))


@query("A09_regime_alignment", W(f"{DECISIONS}, {RESULTS}", """SELECT variant, regime, max(expected_action) AS expected_action, count(*) AS samples,
    CAST(sum(CAST(proposed_action = expected_action AS INT)) AS BIGINT) AS llm_matches, CAST(sum(CAST(risk_action = expected_action AS INT)) AS BIGINT) AS risk_matches
    FROM res WHERE status = 'OK' GROUP BY 1, 2"""))
def a09(spark, sf):
    return O.regime_alignment(results(spark, sf).filter("status = 'OK'"))


@query("A10_conviction_calibration", W(CAMP, f"""SELECT variant, horizon_min, CASE WHEN conviction < 50 THEN '0-49' WHEN conviction < 60 THEN '50-59' WHEN conviction < 70 THEN '60-69' ELSE '70-80' END AS band,
    count(*) AS samples, {', '.join(f"count(*) FILTER (ls = '{s}') AS {s}" for s in O.STATUSES[:-1])},
    {R("count(*) FILTER (ls = 'good') / nullif(count(*) FILTER (ls IN ('good', 'bad')), 0)::DOUBLE", 'good_rate', 4)}
    FROM co WHERE maturity = 'matured' GROUP BY 1, 2, 3"""))
def a10(spark, sf):
    return rounded(O.conviction_calibration(_campaign(spark, sf)), ["variant", "horizon_min", "band", "samples", *O.STATUSES[:-1]], ["good_rate"], 4)


@query("J11_resume_plan", W(f"{DECISIONS}, {RESULTS}", """SELECT decision_id, variant FROM res r WHERE NOT EXISTS (
    SELECT 1 FROM res d WHERE d.variant = r.variant AND d.asset = r.asset AND d.ts = r.ts AND d.status = 'OK' AND NOT d.technical_failure AND d.decision_id % 3 <> 1)"""))
def j11(spark, sf):
    r = results(spark, sf)
    out = O.pending_plan(r, r.filter("decision_id % 3 <> 1"), ["variant", "asset", "ts"])
    return out.select("decision_id", "variant")


MODES = ("historical", "neutral-fresh", "technical-only")
PAIRS = f"""{DECISIONS}, {RESULTS}, md AS (
  SELECT asset AS signature, 'w' || decision_id AS window_id, m.m AS mode, variant, ts,
    CASE WHEN m.m = 'neutral-fresh' AND conviction < 20 THEN 'BUY' ELSE proposed_action END AS proposed_action,
    CASE WHEN m.m = 'technical-only' AND conviction > 90 THEN 'HOLD' ELSE risk_action END AS risk_action,
    CASE WHEN m.m = 'technical-only' AND decision_id % 89 = 0 THEN price + 1 ELSE price END AS price
  FROM res, (VALUES ('historical'), ('neutral-fresh'), ('technical-only')) m(m)
  WHERE NOT (m.m = 'technical-only' AND decision_id % 97 = 0) AND NOT (m.m = 'historical' AND decision_id % 101 = 0)),
pj AS (
  SELECT coalesce(a.signature, b.signature) AS signature, coalesce(a.mode, b.mode) AS mode, a.proposed_action AS al, a.risk_action AS ar,
    b.proposed_action AS bl, b.risk_action AS br, a.price AS ap, b.price AS bp,
    CASE WHEN a.ts IS NULL THEN 'missing_candidate' WHEN b.ts IS NULL THEN 'missing_baseline' ELSE 'paired' END AS match
  FROM (SELECT * FROM md WHERE mode <> 'historical') a
  FULL OUTER JOIN (SELECT md.* REPLACE (m.m AS mode) FROM md, (VALUES ('neutral-fresh'), ('technical-only')) m(m) WHERE mode = 'historical') b
    ON a.signature = b.signature AND a.variant = b.variant AND a.window_id = b.window_id AND a.ts = b.ts AND a.mode = b.mode)"""


def mode_results(spark, sf):
    r = results(spark, sf).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES])))
    i = F.col("decision_id")
    r = r.filter(~((F.col("mode") == "technical-only") & (i % 97 == 0)) & ~((F.col("mode") == "historical") & (i % 101 == 0)))
    return r.select(
        F.col("asset").alias("signature"), F.concat(F.lit("w"), i.cast("string")).alias("window_id"), "mode", "variant", "ts", "atr",
        F.when((F.col("mode") == "neutral-fresh") & (F.col("conviction") < 20), "BUY").otherwise(F.col("proposed_action")).alias("proposed_action"),
        F.when((F.col("mode") == "technical-only") & (F.col("conviction") > 90), "HOLD").otherwise(F.col("risk_action")).alias("risk_action"),
        F.when((F.col("mode") == "technical-only") & (i % 89 == 0), F.col("price") + 1).otherwise(F.col("price")).alias("price"),
        F.lit("NEUTRAL").alias("rsi"), F.lit("NEUTRAL").alias("macd"))


@query("J08_paired_join", W(PAIRS, """SELECT signature, mode, count(*) FILTER (match = 'paired') AS paired_points, count(*) FILTER (match <> 'paired') AS key_mismatches,
    count(*) FILTER (match = 'paired' AND ap <> bp) AS technical_mismatches, count(*) FILTER (match = 'paired' AND (al <> bl OR ar <> br)) AS changes FROM pj GROUP BY 1, 2"""))
def j08(spark, sf):
    return O.group_summary(O.paired_comparison(mode_results(spark, sf), MODES, "historical"))


@query("M19_paired_changes", W(PAIRS, """SELECT mode, bl AS before_llm, al AS after_llm, br AS before_risk, ar AS after_risk, count(*) AS n
    FROM pj WHERE match = 'paired' AND (al <> bl OR ar <> br) GROUP BY 1, 2, 3, 4, 5"""))
def m19(spark, sf):
    return O.paired_changes(O.paired_comparison(mode_results(spark, sf), MODES, "historical"))


@query("U02_key_set_difference", W(PAIRS, """SELECT signature, window_id, ts, 'left' AS side FROM (SELECT signature, window_id, ts FROM md WHERE mode = 'historical'
      EXCEPT SELECT signature, window_id, ts FROM md WHERE mode = 'technical-only') UNION ALL
    SELECT signature, window_id, ts, 'right' FROM (SELECT signature, window_id, ts FROM md WHERE mode = 'technical-only' EXCEPT SELECT signature, window_id, ts FROM md WHERE mode = 'historical')"""))
def u02(spark, sf):
    r = mode_results(spark, sf)
    return quality.key_set_difference(r.filter("mode = 'historical'"), r.filter("mode = 'technical-only'"), ["signature", "window_id", "ts"])


@query("A03_frequency_tables", W(f"{DECISIONS}, {RESULTS}", """SELECT * FROM (SELECT variant, regime, risk_action, count(*) AS n,
      row_number() OVER (PARTITION BY variant ORDER BY count(*) DESC, regime, risk_action) AS rank FROM res GROUP BY 1, 2, 3) WHERE rank <= 6"""))
def a03(spark, sf):
    return O.top_reasons(results(spark, sf), ["regime", "risk_action"], 6, ["variant"])


@query("A24_scenario_matrix", W(f"{DECISIONS}, {RESULTS}", """SELECT regime, count(*) AS n, count(*) FILTER (expected_action IS NULL OR proposed_action = expected_action) AS quality_passed,
    count(*) FILTER (regime = 'HIGH_VOLATILITY' OR risk_action = 'HOLD' OR risk_action = expected_action) AS safety_passed FROM res GROUP BY 1"""))
def a24(spark, sf):
    from tidemark.plans.reports import scenario_matrix
    scenarios = {"UPTREND": ("BUY", ["BUY", "HOLD"]), "DOWNTREND": ("SELL", ["SELL", "HOLD"]), "SIDEWAYS": ("HOLD", ["HOLD"])}
    return scenario_matrix(results(spark, sf), "regime", scenarios)


# Regime windows: 24 hours every 6 hours over hourly bars.
def _windows(spark, sf):
    return regimes.sliding_windows(bars(spark, sf), window=86400, stride=21600, bar=TF, trend_pct=2.0, sideways_pct=0.8,
                                   min_coverage_pct=80, width=WIDTH)


WINDOWS = f"""{BARS}, sp AS (SELECT asset, min(ts) AS a, max(ts) AS z FROM bars GROUP BY 1),
st AS (SELECT asset, unnest(generate_series(a, z - 86400, 21600)) AS s FROM sp),
wr AS (SELECT st.asset, st.s, b.ts, b.close, (b.close / lag(b.close) OVER (PARTITION BY st.asset, st.s ORDER BY b.ts) - 1) * 100 AS r
  FROM st JOIN bars b ON b.asset = st.asset AND b.ts BETWEEN st.s AND st.s + 86400),
wa AS (SELECT asset, s AS nominal_start, count(*) AS candles, min(ts) AS start_ts, max(ts) AS end_ts, arg_min(close, ts) AS start_price, arg_max(close, ts) AS end_price,
  round(coalesce(stddev_pop(r), 0), 4) + 0.0 AS volatility_pct FROM wr GROUP BY 1, 2 HAVING count(*) >= 19),
wm AS (SELECT *, round((end_price - start_price) / start_price * 100, 4) + 0.0 AS move_pct FROM wa),
win AS (SELECT *, CASE WHEN move_pct >= 2 THEN 'UPTREND' WHEN move_pct <= -2 THEN 'DOWNTREND' WHEN abs(move_pct) <= 0.8 THEN 'SIDEWAYS' ELSE 'MIXED' END AS label FROM wm)"""


@query("W34_sliding_regime_windows", W(WINDOWS, f"SELECT asset, nominal_start, candles, start_ts, end_ts, label, {RS(['start_price', 'end_price', 'move_pct', 'volatility_pct'], 4)} FROM win"))
def w34(spark, sf):
    return rounded(_windows(spark, sf), ["asset", "nominal_start", "candles", "start_ts", "end_ts", "label"],
                   ["start_price", "end_price", "move_pct", "volatility_pct"], 4)


ORDERED = """CASE label WHEN 'UPTREND' THEN -move_pct WHEN 'DOWNTREND' THEN move_pct ELSE abs(move_pct) END,
      CASE label WHEN 'SIDEWAYS' THEN volatility_pct ELSE -volatility_pct END, start_ts"""


@query("T03_regime_examples", W(WINDOWS, f"""SELECT asset, label, start_ts, rank FROM (SELECT *, row_number() OVER (PARTITION BY asset, label ORDER BY {ORDERED}) AS rank
    FROM win WHERE label <> 'MIXED') WHERE rank <= 3"""))
def t03(spark, sf):
    return regimes.regime_examples(_windows(spark, sf), 3).select("asset", "label", "start_ts", "rank")


def _greedy_windows(ordered: str) -> str:
    return f"""{ordered},
    wk AS (SELECT asset, CAST(0 AS BIGINT) AS i, [] :: STRUCT(s BIGINT, e BIGINT, r VARCHAR, lane BIGINT)[] AS used FROM (SELECT DISTINCT asset FROM cand)
      UNION ALL
      SELECT w.asset, w.i + 1, CASE WHEN len(list_filter(w.used, lambda u: u.r = c.regime)) < 2
          AND len(list_filter(w.used, lambda u: u.r = c.regime AND u.lane = c.lane AND c.lane < 2)) = 0
          AND len(list_filter(w.used, lambda u: c.start_ts <= u.e AND u.s <= c.end_ts)) = 0
        THEN list_append(w.used, {{'s': c.start_ts, 'e': c.end_ts, 'r': c.regime, 'lane': c.lane}}) ELSE w.used END
      FROM wk w JOIN cand c ON c.asset = w.asset AND c.i = w.i),
    picked AS (SELECT asset, unnest(arg_max(used, i), recursive := true) FROM wk GROUP BY 1)"""


RANKS = f"""ra AS (SELECT *, label AS regime, CAST(2 AS BIGINT) AS lane, row_number() OVER (PARTITION BY asset, label ORDER BY {ORDERED}) AS rank FROM win WHERE label <> 'MIXED'
  UNION ALL SELECT *, 'HIGH_VOLATILITY', 2, row_number() OVER (PARTITION BY asset ORDER BY -volatility_pct, -abs(move_pct), start_ts) FROM win),
cand AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY CASE regime WHEN 'UPTREND' THEN 0 WHEN 'DOWNTREND' THEN 1 WHEN 'SIDEWAYS' THEN 2 ELSE 3 END, lane, rank) - 1 AS i FROM ra)"""


@query("T05_non_overlapping_windows", W(f"{WINDOWS}, {_greedy_windows(RANKS)}", "SELECT asset, r AS regime, s AS start_ts, e AS end_ts FROM picked", True))
def t05(spark, sf):
    out = regimes.select_windows(_windows(spark, sf), 2, window=86400, stride=21600, high_volatility=True)
    return out.select("asset", "regime", "start_ts", "end_ts")


BANDS = """so AS (SELECT *, label AS regime, row_number() OVER (PARTITION BY asset, label ORDER BY CASE label WHEN 'SIDEWAYS' THEN volatility_pct ELSE abs(move_pct) END,
    CASE label WHEN 'SIDEWAYS' THEN abs(move_pct) ELSE volatility_pct END, start_ts) - 1 AS rk, count(*) OVER (PARTITION BY asset, label) AS n FROM win WHERE label <> 'MIXED'),
bd AS (SELECT so.*, b.b, rk - b.b * n // 2 AS spot, (b.b + 1) * n // 2 - b.b * n // 2 AS size FROM so, (VALUES (0), (1)) b(b) WHERE rk >= b.b * n // 2 AND rk < (b.b + 1) * n // 2),
ra AS (SELECT asset, regime, start_ts, end_ts, CAST(b AS BIGINT) AS lane, row_number() OVER (PARTITION BY asset, regime, b ORDER BY abs(spot - (size - 1) / 2.0), spot) AS rank FROM bd
  UNION ALL SELECT asset, regime, start_ts, end_ts, 2, rk FROM so),
cand AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY CASE regime WHEN 'UPTREND' THEN 0 WHEN 'DOWNTREND' THEN 1 ELSE 2 END, lane, rank) - 1 AS i FROM ra)"""


def _plan(spark, sf):
    picks = regimes.select_windows(_windows(spark, sf), 2, window=86400, stride=21600, strategy="stratified")
    return regimes.frozen_plan(picks, bars(spark, sf), 3, 14400)


@query("T05_stratified_windows", W(f"{WINDOWS}, {_greedy_windows(BANDS)}", "SELECT asset, r AS regime, s AS start_ts, e AS end_ts FROM picked", True))
def t05b(spark, sf):
    out = regimes.select_windows(_windows(spark, sf), 2, window=86400, stride=21600, strategy="stratified")
    return out.select("asset", "regime", "start_ts", "end_ts")


SPACED = f"""pw AS (SELECT p.asset, p.s, b.ts FROM picked p JOIN bars b ON b.asset = p.asset AND b.ts BETWEEN p.s AND p.e),
{greedy_sql('pw', ['asset', 's'], 14400)},
cy AS (SELECT *, row_number() OVER (PARTITION BY asset, s ORDER BY ts) AS cycle FROM taken)"""


@query("M17_campaign_plan", W(f"{WINDOWS}, {_greedy_windows(BANDS)}, {SPACED}", """SELECT p.asset, p.r AS regime, p.s AS start_ts,
    CASE p.r WHEN 'UPTREND' THEN 'BUY' WHEN 'DOWNTREND' THEN 'SELL' ELSE 'HOLD' END AS expected_action,
    string_agg(CAST(c.ts AS VARCHAR), ',' ORDER BY c.ts) AS stamps FROM picked p JOIN cy c ON c.asset = p.asset AND c.s = p.s AND c.cycle <= 3 GROUP BY 1, 2, 3, 4""", True))
def m17(spark, sf):
    return _plan(spark, sf).select("asset", "regime", "start_ts", "expected_action",
                                   F.array_join(F.col("cycle_timestamps").cast("array<string>"), ",").alias("stamps"))


@query("A25_plan_fingerprint", W(f"{WINDOWS}, {_greedy_windows(BANDS)}, {SPACED}, pl AS (SELECT p.asset, p.r, p.s, p.e, string_agg(CAST(c.ts AS VARCHAR), ',' ORDER BY c.ts) AS stamps FROM picked p JOIN cy c ON c.asset = p.asset AND c.s = p.s AND c.cycle <= 3 GROUP BY 1, 2, 3, 4)",
    "SELECT asset, sha256(string_agg(t, chr(10) ORDER BY t)) AS fingerprint FROM (SELECT asset, 'cfg|' || r || '|' || s || '|' || e || '|' || stamps AS t FROM pl) GROUP BY 1", True))
def a25(spark, sf):
    from tidemark.plans.splits import fingerprint
    plan = _plan(spark, sf).select("asset", F.lit("cfg").alias("config"), "regime", "start_ts", "end_ts",
                                   F.array_join(F.col("cycle_timestamps").cast("array<string>"), ",").alias("stamps"))
    return fingerprint(plan, ["asset"], ["config", "regime", "start_ts", "end_ts", "stamps"])


@query("T04_spaced_timestamps", W(f"{BARS}, wd AS (SELECT DISTINCT asset, ts // 86400 * 86400 AS s FROM bars), pw AS (SELECT w.asset, w.s, b.ts FROM wd w JOIN bars b ON b.asset = w.asset AND b.ts BETWEEN w.s AND w.s + 43200), {greedy_sql('pw', ['asset', 's'], 10800)}",
    "SELECT asset, CAST(s AS VARCHAR) AS window_id, ts, cycle FROM (SELECT *, row_number() OVER (PARTITION BY asset, s ORDER BY ts) AS cycle FROM taken) WHERE cycle <= 3", True))
def t04(spark, sf):
    b = bars(spark, sf)
    start = F.col("ts") - F.pmod("ts", F.lit(86400))
    wins = b.select("asset", start.alias("start_ts")).distinct().select(
        "asset", F.col("start_ts").cast("string").alias("window_id"), "start_ts", (F.col("start_ts") + 43200).alias("end_ts"))
    return select.spaced_timestamps(b, wins, 3, 10800)


@query("J12_interval_overlap", W(WINDOWS, """SELECT a.asset, a.start_ts AS left_start, b.start_ts AS right_start FROM win a JOIN win b ON a.asset = b.asset
    AND a.label = 'UPTREND' AND b.label = 'DOWNTREND' AND a.start_ts <= b.end_ts AND b.start_ts <= a.end_ts"""))
def j12(spark, sf):
    w = _windows(spark, sf).withColumn("id", F.col("start_ts"))
    pairs = asof.overlap_pairs(w.filter("label = 'UPTREND'"), w.filter("label = 'DOWNTREND'"), 86400)
    return pairs.select("asset", "left_start", "right_start")


@query("T08_stratified_samples", W(f"""{BARS}, rk AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS r FROM bars),
    ca AS (SELECT a.asset, a.ts, b.ts AS future_ts, (b.close - a.close) / a.close * 100 AS m FROM rk a JOIN rk b ON b.asset = a.asset AND b.r = a.r + 8 WHERE a.r >= 8 AND a.r % 8 = 0),
    cl AS (SELECT *, CASE WHEN m >= 1 THEN 'UPTREND' WHEN m <= -1 THEN 'DOWNTREND' WHEN abs(m) <= 0.2 THEN 'SIDEWAYS' ELSE 'MIXED' END AS regime FROM ca),
    cr AS (SELECT *, row_number() OVER (PARTITION BY asset, regime ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY asset, regime) AS n FROM cl),
    s1 AS (SELECT * FROM cr WHERE regime <> 'MIXED' AND (n <= 7 + CAST(regime <> 'SIDEWAYS' AS INT) OR p IN (SELECT unnest(list_transform(range(7 + CAST(regime <> 'SIDEWAYS' AS INT)),
      lambda i: CASE WHEN i = 6 + CAST(regime <> 'SIDEWAYS' AS INT) THEN n - 1 ELSE CAST(floor(i * ((n - 1) / CAST(6 + CAST(regime <> 'SIDEWAYS' AS INT) AS DOUBLE))) AS BIGINT) END))))),
    wt AS (SELECT asset, 23 - count(*) AS want FROM s1 GROUP BY 1),
    s2 AS (SELECT c.* FROM cr c JOIN wt USING (asset) WHERE regime = 'MIXED' AND want > 0 AND (n <= want OR p IN (SELECT unnest(list_transform(range(want),
      lambda i: CASE WHEN i = want - 1 THEN CASE WHEN want = 1 THEN 0 ELSE n - 1 END ELSE CAST(floor(i * ((n - 1) / CAST(nullif(want - 1, 0) AS DOUBLE))) AS BIGINT) END)))))""",
    f"SELECT asset, ts, future_ts, regime, {R('m', 'future_move_pct')} FROM s1 UNION ALL SELECT asset, ts, future_ts, regime, {R('m', 'future_move_pct')} FROM s2"))
def t08(spark, sf):
    out = regimes.stratified_samples(bars(spark, sf), 23, spacing=8, width=WIDTH)
    return rounded(out, ["asset", "ts", "future_ts", "regime"], ["future_move_pct"])


# The gate over decisions with derived health, risk and portfolio inputs.
GATE_IN = """gi AS (SELECT decision_id, account, ts, proposed_action, conviction, CAST((account * 7) % 100 AS DOUBLE) AS exposure_pct, 5.0::DOUBLE AS max_risk_pct,
  CASE WHEN decision_id % 9 = 0 THEN NULL ELSE CAST(decision_id % 15 AS DOUBLE) END AS daily_drawdown_pct,
  decision_id % 13 = 0 AS market_stale, decision_id % 7 = 0 AS news_stale, decision_id % 6 = 0 AS red_flag, decision_id % 17 = 0 AS untrusted,
  CASE WHEN decision_id % 6 = 0 THEN ['ban', 'hack'] ELSE [] END AS matched_terms, decision_id % 5 AS news_count,
  ['NEUTRAL', 'OVERBOUGHT', 'OVERSOLD', 'NEUTRAL'][decision_id % 4 + 1] AS rsi_status,
  ['NEUTRAL', 'BULLISH_EXPANDING', 'BEARISH_EXPANDING'][decision_id % 3 + 1] AS macd_status,
  CASE WHEN decision_id % 19 = 0 THEN 'EXTREME' ELSE 'NORMAL' END AS atr_status, value AS atr, execution_price AS price, decision_id % 10 = 0 AS in_cooldown,
  decision_id % 23 = 0 AS tools_degraded FROM decisions)"""


def gate_inputs(spark, sf):
    d, i = decisions(spark, sf), F.col("decision_id")
    pick = lambda names, k: F.get(F.array(*[F.lit(n) for n in names]), (i % k).cast("int"))
    none = F.array().cast("array<string>")
    return d.select(
        "decision_id", "account", "ts", "proposed_action", "conviction", ((F.col("account") * 7) % 100).cast("double").alias("exposure_pct"),
        F.lit(5.0).alias("max_risk_pct"), F.when(i % 9 != 0, (i % 15).cast("double")).alias("daily_drawdown_pct"),
        (i % 13 == 0).alias("market_stale"), (i % 7 == 0).alias("news_stale"), (i % 6 == 0).alias("red_flag"), (i % 17 == 0).alias("untrusted"),
        F.when(i % 6 == 0, F.array(F.lit("ban"), F.lit("hack"))).otherwise(none).alias("matched_terms"), (i % 5).alias("news_count"),
        pick(("NEUTRAL", "OVERBOUGHT", "OVERSOLD", "NEUTRAL"), 4).alias("rsi_status"),
        pick(("NEUTRAL", "BULLISH_EXPANDING", "BEARISH_EXPANDING"), 3).alias("macd_status"),
        F.when(i % 19 == 0, "EXTREME").otherwise("NORMAL").alias("atr_status"), F.col("value").alias("atr"),
        F.col("execution_price").alias("price"), (i % 10 == 0).alias("in_cooldown"), (i % 23 == 0).alias("tools_degraded"))


GATE = f"""{DECISIONS}, {GATE_IN}, gr AS (SELECT *, CASE WHEN news_count = 0 THEN 0.7 ELSE 1 END::DOUBLE * CASE WHEN market_stale THEN 0.3 ELSE 1 END::DOUBLE
    * CASE WHEN news_stale THEN 0.6 ELSE 1 END::DOUBLE
    * CASE WHEN red_flag AND NOT (proposed_action = 'SELL' AND NOT market_stale AND NOT news_stale AND NOT untrusted AND rsi_status <> 'OVERSOLD' AND macd_status = 'BEARISH_EXPANDING') THEN 0.7 ELSE 1 END::DOUBLE
    * CASE WHEN atr / price > 0.05 THEN 0.5 ELSE 1 END::DOUBLE AS reliability FROM gi),
gh AS (SELECT *, conviction / 100.0::DOUBLE * reliability AS hybrid, CASE proposed_action WHEN 'BUY' THEN 5.0 ELSE least(5.0, exposure_pct) END AS size FROM gr),
gb AS (SELECT *, 'Directional Gate: ' || proposed_action || ' bloqueado por ' AS b FROM gh),
gx AS (SELECT *, CASE
  WHEN proposed_action = 'HOLD' THEN 'LLM sugeriu HOLD.'
  WHEN proposed_action = 'BUY' AND daily_drawdown_pct >= 10 THEN 'Limite de drawdown diario atingido (' || printf('%.2f', daily_drawdown_pct) || '% >= 10.00%). BUY bloqueado.'
  WHEN market_stale THEN b || 'market data stale' WHEN untrusted THEN b || 'instrucao nao confiavel em noticias'
  WHEN proposed_action = 'BUY' AND news_stale THEN b || 'noticias stale'
  WHEN proposed_action = 'BUY' AND red_flag THEN b || 'news red flag (ban, hack)'
  WHEN proposed_action = 'BUY' AND rsi_status = 'OVERBOUGHT' THEN b || 'RSI OVERBOUGHT'
  WHEN proposed_action = 'BUY' AND rsi_status = 'OVERSOLD' AND macd_status <> 'BULLISH_EXPANDING' THEN b || 'RSI OVERSOLD sem confirmacao MACD bullish'
  WHEN proposed_action = 'BUY' AND macd_status = 'BEARISH_EXPANDING' THEN b || 'MACD BEARISH_EXPANDING'
  WHEN proposed_action = 'BUY' AND atr_status = 'EXTREME' THEN b || 'ATR EXTREME'
  WHEN proposed_action = 'SELL' AND rsi_status = 'OVERSOLD' THEN b || 'RSI OVERSOLD'
  WHEN proposed_action = 'SELL' AND macd_status = 'BULLISH_EXPANDING' THEN b || 'MACD BULLISH_EXPANDING'
  WHEN in_cooldown THEN 'Cooldown: ' || proposed_action || ' repetido nos ultimos 15 minutos'
  WHEN conviction < 70 THEN 'Conviccao bruta da IA insuficiente (' || CAST(conviction AS BIGINT) || '%). Exige-se minimo de 70%.'
  WHEN news_count = 0 AND conviction < 80 THEN 'Noticias velhas/ausentes. IA nao tem conviccao absoluta (' || CAST(conviction AS BIGINT) || '% < 80%).'
  WHEN hybrid < 0.5 THEN 'Confianca Hibrida muito baixa (' || printf('%.1f', hybrid * 100) || '%). Limiar e 50%.'
  WHEN proposed_action = 'BUY' AND exposure_pct >= 90 THEN 'Teto de alocacao de portfolio (90.0%) atingido. Compras bloqueadas.'
  WHEN size <= 0 THEN 'SELL bloqueado: portfolio sem exposicao em BTC.' END AS blocked FROM gb)"""


@query("F20_decision_gate", W(GATE, f"""SELECT decision_id, CASE WHEN blocked IS NULL THEN proposed_action ELSE 'HOLD' END AS risk_action,
    coalesce(blocked, 'Aprovado. Confianca Hibrida: ' || printf('%.1f', hybrid * 100) || '%. ' || CASE proposed_action WHEN 'BUY' THEN 'Tamanho do Kelly: ' ELSE 'Reducao de exposicao: ' END || printf('%.2f', size) || '%') AS risk_reason,
    {R('CASE WHEN blocked IS NULL THEN size ELSE 0 END', 'executed_size')}, {R('reliability')} FROM gx"""))
def f20(spark, sf):
    out = gate.evaluate_gate(gate_inputs(spark, sf), gate.GateConfig(max_exposure=90.0))
    return rounded(out, ["decision_id", "risk_action", "risk_reason"], ["executed_size", "reliability"])


@query("F21_proposal_caps", W(f"{DECISIONS}, {GATE_IN}", f"""SELECT decision_id, CASE WHEN f THEN 'HOLD' ELSE proposed_action END AS proposed_action,
    {R("CASE WHEN f THEN 0 ELSE least(CASE WHEN proposed_action <> 'HOLD' AND news_stale THEN least(conviction, 60) ELSE conviction END, 80) END", 'conviction')},
    CASE WHEN NOT f THEN NULL WHEN tools_degraded THEN 'HOLD: contexto de ferramentas degradado.' WHEN market_stale THEN 'HOLD: market data stale.' ELSE 'HOLD: instrucao nao confiavel em noticias.' END AS cap_reason
    FROM (SELECT *, proposed_action <> 'HOLD' AND (tools_degraded OR market_stale OR untrusted) AS f FROM gi)"""))
def f21(spark, sf):
    return rounded(gate.cap_proposals(gate_inputs(spark, sf)), ["decision_id", "proposed_action", "cap_reason"], ["conviction"])


@query("W23_cooldown_replay", W(f"{DECISIONS}, cs AS (SELECT * FROM decisions WHERE proposed_action <> 'HOLD'), {greedy_sql('cs', ['account', 'proposed_action'], 86401)}",
    """SELECT c.decision_id, t.ts IS NULL OR c.decision_id <> min(c.decision_id) OVER (PARTITION BY c.account, c.proposed_action, c.ts) AS in_cooldown
    FROM cs c LEFT JOIN taken t USING (account, proposed_action, ts)""", True))
def w23(spark, sf):
    from tidemark.plans.ledger import cooldown_replay
    d = decisions(spark, sf).filter("proposed_action <> 'HOLD'")
    out = cooldown_replay(d, ["account", "proposed_action"], 86400, "decision_id")
    return out.select("decision_id", "in_cooldown")


@query("F14_cost_model", W(DECISIONS, f"""SELECT decision_id, {R('200 * (0.003 + s)', 'round_trip_pct')}, {R('100 * (0.003 + s)', 'one_way_pct')}, {R('s', 'slippage_rate')}
    FROM (SELECT *, least(0.003, greatest(0.0005, value / execution_price * 0.1)) AS s FROM decisions)"""))
def f14(spark, sf):
    d = decisions(spark, sf).withColumn("slippage_rate", costs.slippage_rate(F.col("value"), F.col("execution_price")))
    d = d.withColumn("round_trip_pct", costs.round_trip_cost_pct(0.003, F.col("slippage_rate"))).withColumn(
        "one_way_pct", costs.one_way_cost_pct(0.003, F.col("slippage_rate")))
    return rounded(d, ["decision_id"], ["round_trip_pct", "one_way_pct", "slippage_rate"])


@query("M18_campaign_scoring", W(f"""{GATE}, {BARS}, go AS (SELECT g.*, d.asset, d.variant, CASE WHEN blocked IS NULL THEN g.proposed_action ELSE 'HOLD' END AS ra,
      CASE WHEN blocked IS NULL THEN size ELSE 0 END AS es, least(0.003, greatest(0.0005, g.atr / g.price * 0.1)) AS sl FROM gx g JOIN decisions d USING (decision_id)),
    fo AS (SELECT go.*, b.close AS fp, (b.close - price) / price * 100 AS m FROM (SELECT *, ts + 14400 AS target FROM go) go ASOF LEFT JOIN (SELECT asset AS ba, ts AS bts, close FROM bars) b
      ON go.asset = b.ba AND go.target <= b.bts WHERE b.bts <= target + 1800)""",
    f"""SELECT variant, count(*) FILTER (ra <> 'HOLD') AS directional_samples, {R("avg(CASE ra WHEN 'BUY' THEN m - 200 * (0.003 + sl) ELSE -m - 100 * (0.003 + sl) END) FILTER (ra <> 'HOLD')", 'average_edge_pct', 4)},
    {R("avg(CASE ra WHEN 'BUY' THEN m - 200 * (0.003 + sl) ELSE -m - 100 * (0.003 + sl) END * es / 100) FILTER (ra <> 'HOLD')", 'average_weighted_edge_pct', 4)}
    FROM fo GROUP BY 1"""))
def m18(spark, sf):
    from tidemark.plans.campaign import score_responses
    tags = decisions(spark, sf).select("decision_id", "asset", "variant")
    responses = gate_inputs(spark, sf).join(tags, "decision_id")
    out = O.horizon_summary(score_responses(responses, bars(spark, sf), (240,), 1.0, gate.GateConfig(max_exposure=90.0), tolerance=TOL))
    return rounded(out, ["variant", "directional_samples"], ["average_edge_pct", "average_weighted_edge_pct"], 4)
