"""Registered queries: snapshots, analysis tools, decision memory and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import R, RS, query, rnd, rounded, table
from tidemark.catalog.datasets import WIDTH
from tidemark.catalog.fixtures import BARS, DECISIONS, LEXICON, NEWS, TF, W, bars, decisions, news
from tidemark.catalog.outcomes import GATE_IN, gate_inputs
from tidemark.functions import text
from tidemark.operators import asof
from tidemark.plans import campaign, documents, memory, reports, snapshot, tools
from tidemark.registry import Registry

#: Characters beyond Latin accents that the tables and fixtures hold; DuckDB does not decompose them itself.
WIDE = lambda c: f"translate(replace({c}, 'ﬁ', 'fi'), 'ｅｇｉｎｏｒ', 'eginor')"
FOLD = lambda c: f"replace({WIDE(f'strip_accents(lower({c}))')}, 'ß', 'ss')"
FOLD_ASCII = lambda c: f"regexp_replace({WIDE(f'strip_accents(lower({c}))')}, '[^\x00-\x7F]', '', 'g')"
FLAGGED = lambda c: "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in text.NEWS_PATTERNS) + ")"
LEX_SQL = "[" + ", ".join(f"'{t}'" for t in LEXICON) + "]"
NEWS_X = NEWS + f""", nx AS (SELECT *, list_sort(list_filter({LEX_SQL}, lambda t: list_contains(string_split_regex({FOLD('headline')}, '[^a-z0-9]+'), t))) AS terms,
  {FLAGGED(FOLD('headline'))} AS flagged FROM news)"""

TECH = f"""{BARS}, br AS (SELECT *, row_number() OVER s AS r, lag(close) OVER s AS pc FROM bars WINDOW s AS (PARTITION BY asset ORDER BY ts)),
bt AS (SELECT asset, r, greatest(r - 49, 1) AS f, least(r, 50) AS n, ts, close, volume FROM br),
ag AS (
  SELECT a.asset, a.r, a.f, a.n, a.ts, a.close AS price, a.volume,
    avg(CASE WHEN b.r > a.r - 14 THEN CASE WHEN b.r = a.f THEN 0 ELSE greatest(b.close - b.pc, 0) END END) AS gain,
    avg(CASE WHEN b.r > a.r - 14 THEN CASE WHEN b.r = a.f THEN 0 ELSE greatest(b.pc - b.close, 0) END END) AS loss,
    avg(CASE WHEN b.r > a.r - 14 THEN CASE WHEN b.r = a.f THEN b.high - b.low ELSE greatest(b.high - b.low, abs(b.high - b.pc), abs(b.low - b.pc)) END END) AS atr,
    avg(b.close) FILTER (b.r > a.r - 20) AS bb_middle, stddev_samp(b.close) FILTER (b.r > a.r - 20) AS sd,
    avg(b.volume) FILTER (b.r > a.r - 20) AS mean_volume, min(b.low) AS lo, max(b.high) AS hi
  FROM bt a JOIN br b ON b.asset = a.asset AND b.r BETWEEN a.f AND a.r GROUP BY ALL),
te AS (
  SELECT t.asset, t.r, t.f, b.close AS e9, b.close AS e21, b.close AS e12, b.close AS e26, 0.0::DOUBLE AS sig, 0.0::DOUBLE AS hist,
    0.0::DOUBLE AS h0, b.close AS p9, b.close AS p21, t.f AS i FROM bt t JOIN br b ON b.asset = t.asset AND b.r = t.f
  UNION ALL
  SELECT asset, r, f, n9, n21, n12, n26, sig + (n12 - n26 - sig) * 0.2, (n12 - n26) - (sig + (n12 - n26 - sig) * 0.2), hist, e9, e21, i + 1 FROM (
    SELECT t.*, t.e9 + (b.close - t.e9) * 2 / 10 AS n9, t.e21 + (b.close - t.e21) * 2 / 22 AS n21,
      t.e12 + (b.close - t.e12) * 2 / 13 AS n12, t.e26 + (b.close - t.e26) * 2 / 27 AS n26
    FROM te t JOIN br b ON b.asset = t.asset AND b.r = t.i + 1 WHERE t.i < t.r)),
vb AS (SELECT a.asset, a.r, least(9, greatest(0, CAST(floor((b.close - a.lo) / ((a.hi - a.lo) / 10)) AS INT))) AS bin, sum(b.volume) AS v
  FROM ag a JOIN br b ON b.asset = a.asset AND b.r BETWEEN a.f AND a.r WHERE a.hi > a.lo GROUP BY 1, 2, 3),
vp AS (SELECT asset, r, arg_max(bin, (v, -bin)) AS bin FROM vb GROUP BY 1, 2),
tk AS (
  SELECT ag.*, e9 AS ema9, e21 AS ema21, hist AS macd, h0, p9, p21,
    CASE WHEN loss = 0 AND gain = 0 THEN 50 WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi,
    CASE WHEN hi > lo THEN lo + (vp.bin + 0.5) * ((hi - lo) / 10) ELSE price END AS poc_price
  FROM ag JOIN te ON te.asset = ag.asset AND te.r = ag.r AND te.i = ag.r LEFT JOIN vp ON vp.asset = ag.asset AND vp.r = ag.r),
tech AS (
  SELECT *, CASE WHEN loss = 0 AND gain = 0 THEN 'NEUTRAL' WHEN rsi >= 70 THEN 'OVERBOUGHT' WHEN rsi <= 30 THEN 'OVERSOLD' ELSE 'NEUTRAL' END AS rsi_status,
    CASE WHEN macd > 0 AND macd > h0 THEN 'BULLISH_EXPANDING' WHEN macd < 0 AND macd < h0 THEN 'BEARISH_EXPANDING' ELSE 'NEUTRAL' END AS macd_status,
    bb_middle + 2 * sd AS bb_upper, bb_middle - 2 * sd AS bb_lower,
    CASE WHEN price > bb_middle + 2 * sd THEN 'ABOVE_UPPER' WHEN price < bb_middle - 2 * sd THEN 'BELOW_LOWER' ELSE 'INSIDE' END AS bb_status,
    CASE WHEN p9 <= p21 AND ema9 > ema21 THEN 'BULLISH_CROSS' WHEN p9 >= p21 AND ema9 < ema21 THEN 'BEARISH_CROSS'
         WHEN ema9 > ema21 THEN 'BULLISH' WHEN ema9 < ema21 THEN 'BEARISH' ELSE 'NEUTRAL' END AS ema_status,
    mean_volume > 0 AND volume > 2 * mean_volume AS volume_spike, CASE WHEN price > 0 AND atr / price > 0.05 THEN 'EXTREME' ELSE 'NORMAL' END AS atr_status
  FROM tk),
{DECISIONS}, ds AS (SELECT d.*, t.* EXCLUDE (asset, ts), t.ts AS latest_bar_ts FROM decisions d ASOF LEFT JOIN tech t ON t.asset = d.asset AND d.ts >= t.ts)"""


def _technical(spark, sf):
    states = snapshot.technical_states(decisions(spark, sf), bars(spark, sf), WIDTH // 4)
    return states.filter(F.col("n_bars") >= snapshot.LEAST_BARS)


def _tech(key, doubles, plain=()):
    @query(key, W(TECH, f"SELECT {', '.join(['decision_id', *plain])}, {RS(doubles, 4)} FROM ds WHERE n >= 30", True))
    def run(spark, sf):
        return rounded(_technical(spark, sf), ["decision_id", *plain], doubles, 4)


_tech("W04_rsi_live", ["rsi"], ("rsi_status",))
_tech("W07_macd_state", ["macd"], ("macd_status",))
_tech("W08_atr_live", ["atr"], ("atr_status",))
_tech("W09_bollinger_live", ["bb_upper", "bb_middle", "bb_lower"], ("bb_status",))
_tech("W10_ema_cross", ["ema9", "ema21"], ("ema_status",))
_tech("W11_volume_spike", ["volume", "mean_volume"], ("volume_spike",))
_tech("A21_volume_profile", ["poc_price"])

RECENT = """rn AS (SELECT d.decision_id, n.*, row_number() OVER (PARTITION BY d.decision_id ORDER BY n.ts DESC, n.news_id DESC) AS rk
  FROM decisions d JOIN nx n ON n.ts BETWEEN d.ts - 86400 AND d.ts + 300),
ra AS (SELECT decision_id, count(*) AS news_count, count(*) FILTER (len(terms) > 0) AS hits, bool_or(flagged) AS untrusted,
  array_to_string(list_sort(list_distinct(flatten(list(terms)))), ',') AS terms, max(ts) AS latest_news FROM rn WHERE rk <= 5 GROUP BY 1),
nr AS (SELECT d.decision_id, d.ts, coalesce(news_count, 0) AS news_count, coalesce(hits > 0, false) AS red_flag, coalesce(untrusted, false) AS untrusted,
  CASE WHEN untrusted OR hits >= 2 THEN 'HIGH' WHEN hits = 1 THEN 'ELEVATED' ELSE 'NORMAL' END AS risk_level, coalesce(terms, '') AS terms, latest_news
  FROM decisions d LEFT JOIN ra USING (decision_id))"""


@query("F09_news_risk", W(f"{DECISIONS}, {NEWS_X}, {RECENT}", "SELECT decision_id, news_count, red_flag, untrusted, risk_level, terms FROM nr"))
def f09(spark, sf):
    out = snapshot.news_states(decisions(spark, sf).select("decision_id", "ts"), snapshot.scanned_news(news(spark, sf), LEXICON))
    return out.select("decision_id", F.col("news_count").cast("bigint").alias("news_count"), "red_flag", "untrusted", "risk_level",
                      F.array_join("matched_terms", ",").alias("terms"))


@query("F10_data_health", W(f"{BARS}, {DECISIONS}, {NEWS_X}, {RECENT}", """SELECT decision_id, CASE WHEN b.ts IS NOT NULL THEN greatest(d.ts - b.ts, 0) END AS kline_age,
    b.ts IS NULL OR d.ts - b.ts > 3000 AS market_stale, CASE WHEN latest_news IS NOT NULL THEN greatest(d.ts - latest_news, 0) END AS news_age,
    latest_news IS NULL OR d.ts - latest_news > 21600 AS news_stale
    FROM (SELECT d.*, nr.latest_news FROM decisions d JOIN nr USING (decision_id)) d ASOF LEFT JOIN bars b ON b.asset = d.asset AND d.ts >= b.ts"""))
def f10(spark, sf):
    tail = asof.trailing_context(decisions(spark, sf), bars(spark, sf), 1, ["close"], WIDTH // 4)
    known = tail.select("decision_id", "ts", F.try_element_at("tail", F.lit(-1))["ts"].alias("bar_ts"))
    found = snapshot.news_states(known, snapshot.scanned_news(news(spark, sf), LEXICON))
    health = snapshot.data_health(F.col("bar_ts"), F.col("latest_news"), F.col("ts"), market_stale=3000)
    return found.withColumns(health).select("decision_id", "kline_age", "market_stale", "news_age", "news_stale")


def _snapshots(spark, sf, shown=None):
    d = decisions(spark, sf).select("decision_id", "asset", "ts", F.lit(5000.0).alias("cash"), (F.col("account") % 7).cast("double").alias("holding"))
    return snapshot.build_snapshots(d, bars(spark, sf), news(spark, sf), width=WIDTH // 4, lexicon=LEXICON, market_stale=3000, shown=shown)


SNAP = f"""{TECH}, {NEWS_X}, {RECENT}, sn AS (
  SELECT ds.*, nr.red_flag, nr.untrusted, nr.risk_level, nr.terms, nr.news_count, greatest(ds.ts - latest_bar_ts, 0) AS kline_age,
    latest_bar_ts IS NULL OR ds.ts - latest_bar_ts > 3000 AS market_stale, latest_news IS NULL OR ds.ts - latest_news > 21600 AS news_stale,
    5000 + account % 7 * price AS equity, CASE WHEN coalesce(n, 0) < 30 THEN 'ERROR' ELSE 'OK' END AS status
  FROM ds JOIN nr USING (decision_id))"""


@query("M21_snapshot_builder", W(SNAP, f"""SELECT decision_id, status, rsi_status, macd_status, ema_status, bb_status, red_flag, untrusted, risk_level, market_stale, news_stale,
    {RS(['price', 'rsi', 'atr', 'poc_price'], 4)}, {R('(account % 7 * price) / equity * 100', 'exposure_pct', 4)} FROM sn WHERE status = 'OK'""", True))
def m21(spark, sf):
    out = _snapshots(spark, sf).filter("status = 'OK'")
    return rounded(out, ["decision_id", "status", "rsi_status", "macd_status", "ema_status", "bb_status", "red_flag", "untrusted", "risk_level",
                         "market_stale", "news_stale"], ["price", "rsi", "atr", "poc_price", "exposure_pct"], 4)


@query("P10_compact_snapshot", W(SNAP, f"SELECT decision_id, rsi_status, macd_status, risk_level, terms, market_stale, {R('price', digits=4)} FROM sn WHERE status = 'OK'", True))
def p10(spark, sf):
    # Written as JSON text and read back through the tolerant decoder.
    out = snapshot.compact_json(_snapshots(spark, sf, snapshot.SHOWN).filter("status = 'OK'"))
    back = memory.decoded(out.select("decision_id", "snapshot"))
    level = F.get_json_object("snapshot", "$.news_risk.risk_level")
    terms = F.array_join(F.from_json(F.get_json_object("snapshot", "$.news_risk.matched_terms"), "array<string>"), ",")
    return back.select("decision_id", "rsi_status", "macd_status", level.alias("risk_level"), terms.alias("terms"), "market_stale",
                       rnd("price", 4).alias("price"))


@query("W30_technical_context", W(f"""{BARS}, br AS (SELECT *, row_number() OVER s AS r, lag(close) OVER s AS pc FROM bars WINDOW s AS (PARTITION BY asset ORDER BY ts)),
    dd AS (SELECT a.asset, a.r, b.r AS br, (b.close / max(b.close) OVER (PARTITION BY a.asset, a.r ORDER BY b.r) - 1) * 100 AS d
      FROM br a JOIN br b ON b.asset = a.asset AND b.r BETWEEN a.r - 31 AND a.r WHERE a.r >= 32),
    dm AS (SELECT asset, r, min(d) AS maximum_drawdown_pct, arg_max(d, br) AS current_drawdown_pct FROM dd GROUP BY 1, 2),
    cx AS (SELECT a.asset, a.ts, a.r, a.close AS price, max(b.close) FILTER (b.r = a.r - 4) AS c4, max(b.close) FILTER (b.r = a.r - 16) AS c16,
      max(b.close) FILTER (b.r = a.r - 31) AS c31, regr_slope(b.close, b.r) AS slope, stddev_pop(CASE WHEN b.r > a.r - 31 THEN b.close / b.pc - 1 END) AS sd,
      max(b.volume) FILTER (b.r = a.r) / avg(b.volume) FILTER (b.r > a.r - 16) AS volume_ratio, max(b.high) / min(b.low) AS rg, CAST(sum(b.volume) AS BIGINT) AS observations
      FROM br a JOIN br b ON b.asset = a.asset AND b.r BETWEEN a.r - 31 AND a.r WHERE a.r >= 32 GROUP BY 1, 2, 3, 4)""",
    f"""SELECT asset, ts, observations, {R('(price / c4 - 1) * 100', 'return_4_pct', 5)}, {R('(price / c16 - 1) * 100', 'return_16_pct', 5)}, {R('(price / c31 - 1) * 100', 'return_31_pct', 5)},
    {R('slope * 4 / price * 100', 'slope_pct_per_hour', 5)}, {R('sd * sqrt(31) * 100', 'realized_volatility_pct', 5)}, {R('volume_ratio', digits=5)},
    {RS(['maximum_drawdown_pct', 'current_drawdown_pct'], 5)}, {R('(rg - 1) * 100', 'range_pct', 5)} FROM cx JOIN dm USING (asset, r)"""))
def w30(spark, sf):
    b = bars(spark, sf).withColumn("observations", F.col("volume").cast("bigint"))
    tail = asof.trailing_context(b.select("asset", "ts"), b, 32, ["close", "high", "low", "volume", "observations"], WIDTH // 4)
    out = snapshot.technical_context(tail).filter("status = 'OK'")
    return rounded(out, ["asset", "ts", "observations"], ["return_4_pct", "return_16_pct", "return_31_pct", "slope_pct_per_hour", "realized_volatility_pct",
                   "volume_ratio", "maximum_drawdown_pct", "current_drawdown_pct", "range_pct"], 5)


REQ = f"""{BARS}, br AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS r FROM bars), {DECISIONS},
rq AS (SELECT decision_id AS request_id, asset, ts,
  ['multi_timeframe_trend', 'donchian_breakout', 'drawdown_profile', 'volume_confirmation', 'other_tool'][CASE WHEN decision_id % 50 = 49 THEN 5 ELSE decision_id % 4 + 1 END] AS tool,
  CASE decision_id % 3 WHEN 0 THEN [15, 60, 240] WHEN 1 THEN [5, 30] ELSE [15, 15] END AS windows,
  CASE decision_id % 4 WHEN 1 THEN CASE WHEN decision_id % 8 = 1 THEN 20 ELSE 55 END WHEN 2 THEN CASE decision_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 240 ELSE 1440 END
    WHEN 3 THEN CASE WHEN decision_id % 8 = 3 THEN 20 ELSE 33 END END AS lookback FROM decisions),
rb AS (SELECT q.*, b.r, CASE WHEN tool = 'other_tool' THEN 'UNKNOWN_TOOL' WHEN tool = 'multi_timeframe_trend' AND request_id % 3 = 2 THEN 'INVALID_WINDOWS'
    WHEN tool = 'volume_confirmation' AND lookback = 33 THEN 'INVALID_LOOKBACK' END AS error_code,
  CASE tool WHEN 'multi_timeframe_trend' THEN list_max(windows) WHEN 'drawdown_profile' THEN lookback ELSE lookback + 1 END AS need
  FROM rq q ASOF LEFT JOIN br b ON b.asset = q.asset AND q.ts >= b.ts),
ro AS (SELECT *, CASE WHEN error_code IS NOT NULL THEN 'ERROR' WHEN coalesce(r, 0) >= need THEN 'OK' ELSE 'INSUFFICIENT_DATA' END AS status FROM rb)"""


def requests(spark, sf):
    d, i = decisions(spark, sf), F.col("decision_id")
    names = F.array(*[F.lit(t) for t in ("multi_timeframe_trend", "donchian_breakout", "drawdown_profile", "volume_confirmation", "other_tool")])
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    return d.select(
        i.alias("request_id"), "asset", "ts", F.get(names, F.when(i % 50 == 49, 4).otherwise(i % 4).cast("int")).alias("tool"),
        F.when(i % 3 == 0, arr(15, 60, 240)).when(i % 3 == 1, arr(5, 30)).otherwise(arr(15, 15)).alias("windows"),
        F.when(i % 4 == 1, F.when(i % 8 == 1, 20).otherwise(55)).when(i % 4 == 2, F.when(i % 3 == 0, 60).when(i % 3 == 1, 240).otherwise(1440))
        .when(i % 4 == 3, F.when(i % 8 == 3, 20).otherwise(33)).alias("lookback"))


def _tools(spark, sf, tool=None):
    r = requests(spark, sf)
    return tools.run_tools(r if tool is None else r.filter(F.col("tool") == tool), bars(spark, sf), WIDTH // 4)


@query("D02_tool_plan_validation", W(REQ, """SELECT request_id // 5 AS plan_id, count(*) AS requests, count(DISTINCT tool) AS tools FROM rq GROUP BY 1
    HAVING count(*) > 3 OR count(DISTINCT tool) < count(*)"""))
def d02(spark, sf):
    return tools.plan_errors(requests(spark, sf).withColumn("plan_id", F.floor(F.col("request_id") / 5)))


def _bar_range(tail, n):
    sample = asof.last_items(tail, n)
    spread = F.array_max(F.transform(sample, lambda b: b["high"])) - F.array_min(F.transform(sample, lambda b: b["low"]))
    return {"bar_range": spread, "state": F.when(spread > 500, "WIDE").otherwise("NARROW")}


@query("D02_registered_tool", W(REQ, f"""SELECT q.request_id, CASE WHEN max(b.high) - min(b.low) > 500 THEN 'WIDE' ELSE 'NARROW' END AS state, {R('max(b.high) - min(b.low)', 'bar_range', 4)}
    FROM rb q JOIN br b ON b.asset = q.asset AND b.r > q.r - (10 + q.request_id % 2 * 290) AND b.r <= q.r
    WHERE q.r >= 10 + q.request_id % 2 * 290 GROUP BY 1"""))
def d02_own(spark, sf):
    """A caller's own tool beside the given ones."""
    own = Registry(**tools.TOOLS)
    own.register("bar_range", tools.Tool((10, 300), _bar_range))
    r = requests(spark, sf).withColumns({"tool": F.lit("bar_range"), "lookback": 10 + F.col("request_id") % 2 * 290})
    out = tools.run_tools(r, bars(spark, sf), WIDTH // 4, own).filter("status = 'OK'")
    return rounded(out, ["request_id", "state"], ["bar_range"], 4)


DONCHIAN = f"""SELECT request_id, CASE WHEN c > u THEN 'BREAKOUT_UP' WHEN c < l THEN 'BREAKOUT_DOWN' ELSE 'INSIDE' END AS state,
    {R('u', 'prior_upper', 4)}, {R('l', 'prior_lower', 4)}, {R('CASE WHEN u > l THEN (c - l) / (u - l) ELSE 0.5 END', 'channel_position', 4)},
    {R('(u / c - 1) * 100', 'distance_to_upper_pct', 4)}, {R('(c / l - 1) * 100', 'distance_to_lower_pct', 4)}
    FROM (SELECT o.request_id, max(b.high) FILTER (b.r < o.r) AS u, min(b.low) FILTER (b.r < o.r) AS l, max(b.close) FILTER (b.r = o.r) AS c
      FROM ro o JOIN br b ON b.asset = o.asset AND b.r BETWEEN o.r - o.lookback AND o.r WHERE tool = 'donchian_breakout' AND status = 'OK' GROUP BY 1)"""
DONCHIAN_FACTS = ["prior_upper", "prior_lower", "channel_position", "distance_to_upper_pct", "distance_to_lower_pct"]


@query("W26_donchian_breakout", W(REQ, DONCHIAN))
def w26(spark, sf):
    out = _tools(spark, sf, "donchian_breakout").filter("status = 'OK'")
    return rounded(out, ["request_id", "state"], DONCHIAN_FACTS, 4)


DRAW_CTES = """dr AS (SELECT o.request_id, o.asset, o.ts AS as_of, b.r, b.ts, b.close, b.close / lag(b.close) OVER w - 1 AS ret, max(b.close) OVER w AS pk, max(b.close) OVER (PARTITION BY o.request_id) AS top
  FROM ro o JOIN br b ON b.asset = o.asset AND b.r > o.r - o.lookback AND b.r <= o.r WHERE tool = 'drawdown_profile' AND status = 'OK'
  WINDOW w AS (PARTITION BY o.request_id ORDER BY b.r)),
dt AS (SELECT request_id, asset, as_of, min((close / pk - 1) * 100) AS worst, arg_min(r, ((close / pk - 1) * 100, r)) AS tr, arg_min(ts, ((close / pk - 1) * 100, r)) AS trough_ts,
  (arg_max(close, r) / max(top) - 1) * 100 AS cur, sqrt(avg(least(ret, 0) ** 2) FILTER (ret IS NOT NULL)) * 100 AS down FROM dr GROUP BY 1, 2, 3),
dp AS (SELECT d.request_id, d.asset, d.as_of, worst, cur, down, trough_ts, arg_max(r.ts, (r.close, -r.r)) AS peak_ts,
  CASE WHEN worst <= -7 THEN 'SEVERE' WHEN worst <= -3 THEN 'ELEVATED' WHEN worst <= -1 THEN 'WATCH' ELSE 'NORMAL' END AS state
  FROM dt d JOIN dr r ON r.request_id = d.request_id AND r.r <= d.tr GROUP BY 1, 2, 3, 4, 5, 6, 7)"""
DRAW = f"{REQ}, {DRAW_CTES}"
DRAWDOWN = f"SELECT request_id, state, peak_ts, trough_ts, {R('cur', 'current_drawdown_pct', 4)}, {R('worst', 'max_drawdown_pct', 4)}, {R('down', 'downside_semideviation_pct', 4)} FROM dp"
DRAWDOWN_FACTS = ["current_drawdown_pct", "max_drawdown_pct", "downside_semideviation_pct"]


@query("W27_drawdown_profile", W(DRAW, DRAWDOWN))
def w27(spark, sf):
    out = _tools(spark, sf, "drawdown_profile").filter("status = 'OK'")
    return rounded(out, ["request_id", "state", "peak_ts", "trough_ts"], DRAWDOWN_FACTS, 4)


@query("W29_drawdown_events", W(DRAW, """SELECT sha256(asset || '|DRAWDOWN|' || peak_ts || '|' || trough_ts || '|' || state) AS dedupe_key, asset, state AS severity,
    trough_ts AS event_ts, min(as_of) AS detected_ts FROM dp WHERE state IN ('ELEVATED', 'SEVERE') GROUP BY 1, 2, 3, 4"""))
def w29(spark, sf):
    return tools.drawdown_events(_tools(spark, sf, "drawdown_profile")).select("dedupe_key", "asset", "severity", "event_ts", "detected_ts")


VOLUME_CTES = """vr AS (SELECT o.request_id, o.r AS last_r, o.lookback, b.r, b.volume, sign(b.close - lag(b.close) OVER (PARTITION BY o.request_id ORDER BY b.r)) * b.volume AS flow
      FROM ro o JOIN br b ON b.asset = o.asset AND b.r BETWEEN o.r - o.lookback AND o.r WHERE tool = 'volume_confirmation' AND status = 'OK'),
    vz AS (SELECT request_id, max(volume) FILTER (r = last_r) AS cur, avg(volume) FILTER (r < last_r) AS mean, stddev_pop(volume) FILTER (r < last_r) AS sd,
      coalesce(sum(flow) FILTER (r < last_r), 0) / greatest(max(lookback) - 1, 1) AS obv FROM vr GROUP BY 1)"""
VOLUME = f"""SELECT request_id, CASE WHEN z >= 2 THEN 'HIGH_VOLUME' WHEN z <= -1 THEN 'LOW_VOLUME' ELSE 'NEUTRAL' END AS state, {R('mean', 'mean_volume', 5)}, {R('z', 'volume_z_score', 5)}, {R('obv', 'obv_slope_per_bar', 5)}
    FROM (SELECT *, CASE WHEN sd > 0 THEN (cur - mean) / sd ELSE 0 END AS z FROM vz)"""
VOLUME_FACTS = ["mean_volume", "volume_z_score", "obv_slope_per_bar"]


@query("W28_volume_confirmation", W(f"{REQ}, {VOLUME_CTES}", VOLUME))
def w28(spark, sf):
    out = _tools(spark, sf, "volume_confirmation").filter("status = 'OK'")
    return rounded(out, ["request_id", "state"], VOLUME_FACTS, 5)


TREND_CTES = """tw AS (SELECT request_id, asset, r, unnest(windows) AS w FROM ro WHERE tool = 'multi_timeframe_trend' AND status = 'OK'),
    tl AS (SELECT t.request_id, t.w, list(b.close ORDER BY b.r) AS c FROM tw t JOIN br b ON b.asset = t.asset AND b.r > t.r - t.w AND b.r <= t.r GROUP BY 1, 2),
    tf AS (SELECT *, (c[-1] / c[1] - 1) * 100 AS ret, list_reduce(c, lambda a, x: a + (x - a) * 2 / (least(9, w) + 1)) AS f, list_reduce(c, lambda a, x: a + (x - a) * 2 / (least(21, w) + 1)) AS s,
      list_reduce(c[1:len(c) - least(5, len(c) - 1)], lambda a, x: a + (x - a) * 2 / (least(21, w) + 1)) AS s0 FROM tl),
    tt AS (SELECT *, (f / s - 1) * 100 AS sp, (s - s0) / c[-1] * 100 / least(5, len(c) - 1) AS slope, CASE WHEN ret >= 0.15 AND (f / s - 1) * 100 >= 0.02 THEN 'BULLISH'
      WHEN ret <= -0.15 AND (f / s - 1) * 100 <= -0.02 THEN 'BEARISH' ELSE 'MIXED' END AS t FROM tf)"""
TREND = f"""SELECT request_id, CASE WHEN count(*) FILTER (t = 'BULLISH') > count(*) / 2.0 THEN 'BULLISH' WHEN count(*) FILTER (t = 'BEARISH') > count(*) / 2.0 THEN 'BEARISH' ELSE 'MIXED' END AS state,
    string_agg(t, ',' ORDER BY w) AS trends, {R('sum(ret)', 'return_sum', 4)}, {R('sum(sp)', 'spread_sum', 4)}, {R('sum(slope)', 'slope_sum', 4)} FROM tt GROUP BY 1"""


def _trend_facts():
    total = lambda name: F.aggregate("windows_detail", F.lit(0.0), lambda a, d: a + d[name])
    return [F.array_join(F.transform("windows_detail", lambda d: d["trend"]), ",").alias("trends"),
            rnd(total("return_pct"), 4).alias("return_sum"), rnd(total("ema_spread_pct"), 4).alias("spread_sum"), rnd(total("slope_pct_per_bar"), 4).alias("slope_sum")]


@query("W25_multi_timeframe_trend", W(f"{REQ}, {TREND_CTES}", TREND))
def w25(spark, sf):
    out = _tools(spark, sf, "multi_timeframe_trend").filter("status = 'OK'")
    return out.select("request_id", "state", *_trend_facts())


@query("M22_analysis_tool_batch", W(f"{DRAW}, {VOLUME_CTES}, {TREND_CTES}, xd AS ({DONCHIAN}), xw AS ({DRAWDOWN}), xv AS ({VOLUME}), xt AS ({TREND})", f"""
    SELECT request_id, tool, status, error_code, coalesce(xd.state, xw.state, xv.state, xt.state) AS state, peak_ts, trough_ts, trends, return_sum, spread_sum, slope_sum,
      {', '.join([*DONCHIAN_FACTS, *DRAWDOWN_FACTS, *VOLUME_FACTS])}
    FROM ro LEFT JOIN xd USING (request_id) LEFT JOIN xw USING (request_id) LEFT JOIN xv USING (request_id) LEFT JOIN xt USING (request_id)"""))
def m22(spark, sf):
    """Every request with all facts of its tool."""
    return _tools(spark, sf).select("request_id", "tool", "status", "error_code", "state", "peak_ts", "trough_ts", *_trend_facts(),
                                    *[rnd(c, 4).alias(c) for c in DONCHIAN_FACTS + DRAWDOWN_FACTS], *[rnd(c, 5).alias(c) for c in VOLUME_FACTS])


# Audit rows with JSON snapshots of both shapes, some unreadable.
LOGS = f"""{DECISIONS}, lg AS (SELECT decision_id, ts, account % 5 AS account, proposed_action, risk_action, floor(conviction / 50) * 50 AS conviction,
  ['OVERSOLD', 'OVERBOUGHT', 'neutral', 'weird'][account % 4 + 1] AS rs, ['BULLISH_EXPANDING', 'BEARISH_EXPANDING', 'NEUTRAL'][account % 3 + 1] AS ms,
  CASE WHEN decision_id % 2 = 0 THEN 'true' ELSE 'false' END AS ns, CASE WHEN account % 2 = 0 THEN 'true' ELSE 'false' END AS rf FROM decisions),
logs AS (SELECT *, CASE WHEN decision_id % 12 = 5 THEN '{{"technical": '
  WHEN decision_id % 3 = 0 THEN '{{"technical_context":{{"current_price":1000.5,"rsi":{{"value":50,"status":"' || rs || '"}},"macd":{{"histogram":1.5,"status":"' || ms || '"}},"ema_crossover":{{"status":"BULLISH"}}}},"data_health":{{"is_market_data_stale":false,"is_news_stale":' || ns || '}},"news_risk":{{"has_negative_red_flag":' || rf || ',"risk_level":"HIGH","matched_terms":["ban","hack"]}},"portfolio_context":{{"current_exposure_percentage":10}}}}'
  ELSE '{{"technical":{{"current_price":1000.5,"rsi_value":50,"rsi_status":"' || rs || '","macd_histogram":1.5,"macd_status":"' || ms || '","ema_status":"BULLISH"}},"data_health":{{"is_market_data_stale":false,"is_news_stale":' || ns || '}},"news_risk":{{"has_negative_red_flag":' || rf || ',"risk_level":"NORMAL","matched_terms":["ban"]}},"portfolio":{{"current_exposure_percentage":10}}}}' END AS snapshot FROM lg)"""


def logs(spark, sf):
    d, i = decisions(spark, sf), F.col("decision_id")
    pick = lambda names, k: F.get(F.array(*[F.lit(n) for n in names]), (F.col("account") % k).cast("int"))
    rs, ms = pick(("OVERSOLD", "OVERBOUGHT", "neutral", "weird"), 4), pick(("BULLISH_EXPANDING", "BEARISH_EXPANDING", "NEUTRAL"), 3)
    ns, rf = F.when(i % 2 == 0, "true").otherwise("false"), F.when(F.col("account") % 2 == 0, "true").otherwise("false")
    tail = lambda level, terms, pf: (F.lit('},"data_health":{"is_market_data_stale":false,"is_news_stale":'), ns, F.lit('},"news_risk":{"has_negative_red_flag":'), rf,
                                     F.lit(f',"risk_level":"{level}","matched_terms":{terms}}},"{pf}":{{"current_exposure_percentage":10}}}}'))
    live = F.concat(F.lit('{"technical_context":{"current_price":1000.5,"rsi":{"value":50,"status":"'), rs, F.lit('"},"macd":{"histogram":1.5,"status":"'), ms,
                    F.lit('"},"ema_crossover":{"status":"BULLISH"}'), *tail("HIGH", '["ban","hack"]', "portfolio_context"))
    flat = F.concat(F.lit('{"technical":{"current_price":1000.5,"rsi_value":50,"rsi_status":"'), rs, F.lit('","macd_histogram":1.5,"macd_status":"'), ms,
                    F.lit('","ema_status":"BULLISH"'), *tail("NORMAL", '["ban"]', "portfolio"))
    return d.select("decision_id", "ts", (F.col("account") % 5).alias("account"), "proposed_action", "risk_action",
                    (F.floor(F.col("conviction") / 50) * 50).cast("double").alias("conviction"),
                    F.when(i % 12 == 5, '{"technical": ').when(i % 3 == 0, live).otherwise(flat).alias("snapshot"))


TAGS = """tg AS (SELECT *, decision_id % 12 = 5 AS bad, CASE WHEN rs IN ('OVERSOLD', 'OVERBOUGHT') THEN rs WHEN rs = 'neutral' THEN 'NEUTRAL' ELSE 'UNKNOWN' END AS rse FROM logs),
te AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT bad AND ns = 'true' THEN 'NEWS_STALE' END, CASE WHEN NOT bad AND rf = 'true' THEN 'NEGATIVE_NEWS_RISK' END,
    CASE WHEN proposed_action = 'HOLD' THEN 'MODEL_ABSTAINED' WHEN risk_action = 'HOLD' THEN 'RISK_BLOCKED_DIRECTION' ELSE 'RISK_APPROVED_DIRECTION' END,
    CASE WHEN NOT bad AND ((rse = 'OVERSOLD' AND ms = 'BEARISH_EXPANDING') OR rse = 'OVERBOUGHT' OR ms = 'BEARISH_EXPANDING') THEN 'TECHNICAL_CONFLICT' END], lambda x: x IS NOT NULL)[1:3], ',') AS tags,
  CASE WHEN bad THEN 'UNKNOWN' ELSE rse END AS rsi_status, CASE WHEN bad THEN 'UNKNOWN' ELSE ms END AS macd_status FROM tg)"""


@query("P11_snapshot_decode", W(LOGS, """SELECT decision_id, CASE WHEN decision_id % 12 = 5 THEN NULL ELSE rs END AS rsi_status, CASE WHEN decision_id % 12 = 5 THEN NULL ELSE 1000.5::DOUBLE END AS price,
    CASE WHEN decision_id % 12 = 5 THEN NULL ELSE ns = 'true' END AS news_stale, CASE WHEN decision_id % 12 = 5 THEN NULL ELSE 10.0::DOUBLE END AS exposure_pct FROM logs"""))
def p11(spark, sf):
    return memory.decoded(logs(spark, sf)).select("decision_id", "rsi_status", "price", "news_stale", "exposure_pct")


@query("P12_field_sanitising", W(LOGS, """SELECT decision_id, CASE WHEN upper(rs) IN ('OVERSOLD', 'OVERBOUGHT', 'NEUTRAL') THEN upper(rs) ELSE 'UNKNOWN' END AS rsi_status,
    CASE WHEN decision_id % 7 = 0 THEN NULL ELSE CASE WHEN conviction + decision_id % 60 <= 100 THEN conviction + decision_id % 60 END END AS conviction,
    CASE decision_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag FROM logs"""))
def p12(spark, sf):
    i = F.col("decision_id")
    rs = F.get(F.array(*[F.lit(n) for n in ("OVERSOLD", "OVERBOUGHT", "neutral", "weird")]), F.pmod(F.col("acct"), F.lit(4)).cast("int"))
    raw = logs(spark, sf).drop("account").join(decisions(spark, sf).select("decision_id", F.col("account").alias("acct")), "decision_id")
    number = F.when(i % 7 == 0, "abc").otherwise((F.col("conviction") + i % 60).cast("string"))
    flag = F.when(i % 4 == 0, "True").when(i % 4 == 1, " 0").when(i % 4 == 2, "1").otherwise("yes")
    return raw.select("decision_id", text.pick_enum(rs, memory.RSI).alias("rsi_status"), text.bounded_number(number, 0, 100, 2).alias("conviction"),
                      text.strict_bool(flag).alias("flag"))


@query("F23_justification_tags", W(f"{LOGS}, {TAGS}", "SELECT decision_id, tags FROM te"))
def f23(spark, sf):
    return memory.episodes(logs(spark, sf)).select("decision_id", F.array_join("tags", ",").alias("tags"))


#: The signature of an episode as JSON; unreadable snapshots leave most of it out.
EPISODE_SQL = """'{"proposed_action":"' || proposed_action || '","conviction":' || conviction || ',"risk_action":"' || risk_action || CASE WHEN bad THEN '"' ELSE '","price":1000.5,"rsi":50.0' END
    || ',"rsi_status":"' || rsi_status || '","macd_status":"' || macd_status || CASE WHEN bad THEN '","ema_status":"UNKNOWN","market_stale":true,"news_stale":true'
    ELSE '","ema_status":"BULLISH","market_stale":false,"news_stale":' || ns || ',"exposure_pct":10.0' END || ',"tags":["' || replace(tags, ',', '","') || '"]}'"""


def memory_sql(source_rows: int | None) -> str:
    return W(f"""{LOGS}, {TAGS}, sg AS (SELECT decision_id, account, ts, {EPISODE_SQL} AS s FROM te),
    pr AS (SELECT a.decision_id AS d, b.ts, b.decision_id AS i, b.s, row_number() OVER (PARTITION BY a.decision_id ORDER BY b.ts DESC, b.decision_id DESC) AS rk
      FROM sg a JOIN sg b ON b.account = a.account AND b.ts BETWEEN a.ts - 7200 AND a.ts AND b.decision_id <> a.decision_id),
    fl AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER w THEN 1 ELSE 0 END AS f FROM pr {f'WHERE rk <= {source_rows}' if source_rows else ''} WINDOW w AS (PARTITION BY d ORDER BY ts, i)),
    gr AS (SELECT *, sum(f) OVER (PARTITION BY d ORDER BY ts, i) AS g FROM fl),
    ep AS (SELECT d, g, any_value(s) AS s, count(*) AS n, max(ts) AS newest, row_number() OVER (PARTITION BY d ORDER BY g DESC) AS back FROM gr GROUP BY 1, 2)""",
    """SELECT decision_id, count(g) AS episodes, coalesce(CAST(sum(n) AS BIGINT), 0) AS source_rows, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY g), '') AS repeats, max(newest) AS newest_ts,
      md5(coalesce(string_agg(s || '@' || newest, ',' ORDER BY g), '')) AS signatures
    FROM decisions LEFT JOIN ep ON d = decision_id AND back <= 8 GROUP BY 1""")


def _memory(spark, sf, **bounds):
    l = logs(spark, sf)
    out = memory.decision_memory(l.select("decision_id", "account", "ts"), l, **bounds)
    reps = F.transform("episodes", lambda e: e["repeat_count"])
    sign = F.transform("episodes", lambda e: F.concat(e["signature"], F.lit("@"), e["newest_ts"].cast("string")))
    return out.select("decision_id", F.size("episodes").cast("bigint").alias("episodes"), F.aggregate(reps, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("source_rows"),
                      F.array_join(reps.cast("array<string>"), ",").alias("repeats"), F.array_max(F.transform("episodes", lambda e: e["newest_ts"])).alias("newest_ts"),
                      F.md5(F.array_join(sign, ",")).alias("signatures"))


@query("M23_decision_memory", memory_sql(None))
def m23(spark, sf):
    """All rows of each window, whatever their number."""
    return _memory(spark, sf)


@query("M23_bounded_memory", memory_sql(5))
def m23b(spark, sf):
    """A caller that wants the newest five rows only."""
    return _memory(spark, sf, source_rows=5)


@query("W24_compact_runs", W("""c AS (SELECT conv_id, turn, CASE WHEN length(text) > 400 THEN 'long' ELSE 'short' END AS s FROM conversations),
    f AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS n FROM c),
    g AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f)""",
    "SELECT conv_id, CAST(run AS BIGINT) AS run, s, count(*) AS repeat_count, min(turn) AS first, max(turn) AS last FROM g GROUP BY 1, 2, 3"))
def w24(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.length("text") > 400, "long").otherwise("short").alias("s"))
    return memory.compact_runs(c, ["conv_id"], "turn", "s", width=3)


@query("A23_snapshot_health", W(LOGS, """SELECT false AS market_stale, ns = 'true' AS news_stale, rf = 'true' AS red_flag, CASE WHEN decision_id % 3 = 0 THEN 'HIGH' ELSE 'NORMAL' END AS risk_level, count(*) AS n
    FROM logs WHERE decision_id % 12 <> 5 GROUP BY 1, 2, 3, 4"""))
def a23(spark, sf):
    return reports.snapshot_health(logs(spark, sf))


@query("A23_snapshot_terms", W(LOGS, "SELECT unnest(CASE WHEN decision_id % 3 = 0 THEN ['ban', 'hack'] ELSE ['ban'] END) AS term, count(*) AS n FROM logs WHERE decision_id % 12 <> 5 GROUP BY 1"))
def a23b(spark, sf):
    return reports.snapshot_terms(logs(spark, sf))


MODED = f"""{DECISIONS}, {GATE_IN}"""


@query("F22_news_modes", W(MODED, """SELECT decision_id, m.m AS news_mode, CASE m.m WHEN 'historical' THEN 'OBSERVED' WHEN 'neutral-fresh' THEN 'SYNTHETIC_NEUTRAL' ELSE 'UNAVAILABLE_BY_TEST_DESIGN' END AS news_context_mode,
    red_flag AND m.m = 'historical' AS red_flag, untrusted AND m.m = 'historical' AS untrusted, CASE m.m WHEN 'historical' THEN 'NORMAL' WHEN 'neutral-fresh' THEN 'NORMAL' ELSE 'UNAVAILABLE' END AS risk_level,
    CASE m.m WHEN 'historical' THEN news_stale WHEN 'neutral-fresh' THEN false ELSE true END AS news_stale, CASE m.m WHEN 'historical' THEN news_count WHEN 'neutral-fresh' THEN 1 ELSE 0 END AS news_count
    FROM gi, (VALUES ('historical'), ('neutral-fresh'), ('technical-only')) m(m)"""))
def f22(spark, sf):
    g = gate_inputs(spark, sf).withColumns({"risk_level": F.lit("NORMAL"), "latest_news_ts": F.col("ts"), "news_age": F.lit(60).cast("bigint"),
                                            "headlines": F.array(F.lit("x"))})
    return campaign.with_news_modes(g).select("decision_id", "news_mode", "news_context_mode", "red_flag", "untrusted", "risk_level", "news_stale",
                                              F.col("news_count").cast("bigint").alias("news_count"))
