"""Registered queries that write the given tables through a sink or a stream and read them back.

Files go to the shared folder; streams read all of them at once and end.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark import schemas
from tidemark.catalog.base import ORACLES, QUERIES, R, RS, query, rounded, table
from tidemark.catalog.datasets import greedy_sql
from tidemark.catalog.fixtures import BARS, DECISIONS, NEWS, W, bars, decisions, events, news
from tidemark.session import materialize, shared_folder
from tidemark.sources import files, sinks
from tidemark.streaming import bars as windows
from tidemark.streaming import feeds, maturity, state

PRICES = ["open", "high", "low", "close", "volume"]
#: Result rows of a file of reports.
REPORT_ROWS = 8192
BAR_ROWS = f"SELECT asset, ts, {RS(PRICES)} FROM bars"


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def stream(df: DataFrame, name: str) -> DataFrame:
    """The rows of a table as a stream of files."""
    path = folder(df.sparkSession, name)
    sinks.write_table(df, path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def finish(writer: DataStreamWriter) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def streamed(df: DataFrame, name: str) -> DataFrame:
    """What a streaming plan has written once it has read all its files."""
    at = folder(df.sparkSession, name)
    finish(df.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint"))
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/rows")


@query("S01_candle_csv_scan", W(BARS, BAR_ROWS))
def s01(spark, sf):
    path = folder(spark, "candles")
    made = bars(spark, sf).select(
        F.col("ts").alias("timestamp"), F.timestamp_seconds("ts").cast("string").alias("datetime_utc"), *PRICES,
        F.col("asset").alias("symbol"), F.lit("1h").alias("resolution"), F.lit("events").alias("source"))
    sinks.write_table(made.select(*schemas.CANDLE_CSV.names), path, "csv")
    return rounded(files.candle_csv(spark, path), ["asset", "ts"], PRICES)


@query("S01_candle_csv_quarantine", W(BARS, "SELECT asset, count(*) FILTER (WHERE ts % 18000 <> 0) AS kept, count(*) FILTER (WHERE ts % 18000 = 0) AS refused FROM bars GROUP BY 1"))
def s01_quarantine(spark, sf):
    path = folder(spark, "candles")
    # The volume of every fifth hour is no number.
    volume = F.when(F.col("ts") % 18000 == 0, "many").otherwise(F.col("volume").cast("string"))
    made = bars(spark, sf).select(
        F.col("ts").alias("timestamp"), F.timestamp_seconds("ts").cast("string").alias("datetime_utc"), *PRICES[:4], volume.alias("volume"),
        F.col("asset").alias("symbol"), F.lit("1h").alias("resolution"), F.lit("events").alias("source"))
    sinks.write_table(made.select(*schemas.CANDLE_CSV.names), path, "csv")
    good, broken = files.candle_csv_quarantine(spark, path)
    refused = broken.filter(F.array_contains("wrong", "volume")).groupBy(F.col("symbol").alias("asset")).agg(F.count(F.lit(1)).alias("refused"))
    return good.groupBy("asset").agg(F.count(F.lit(1)).alias("kept")).join(refused, "asset")


def _chunk_files(spark, sf):
    """One CSV a day, named by the seconds it holds."""
    path = folder(spark, "chunks")
    made = bars(spark, sf).select(
        F.col("ts").alias("timestamp"), F.timestamp_seconds("ts").cast("string").alias("datetime_utc"), *PRICES,
        F.col("asset").alias("symbol"), F.lit("1h").alias("resolution"), F.lit("events").alias("source"))
    sinks.write_chunks(made.select(*schemas.CANDLE_CSV.names), path, 86400)
    return path


CHUNK_ROWS = f"""SELECT asset, ts, {RS(PRICES)}, day || '_' || (day + 86399) || '.csv' AS file, day AS window_start, day + 86399 AS window_end
  FROM (SELECT *, ts // 86400 * 86400 AS day FROM bars)"""


@query("S02_chunk_files", W(BARS, CHUNK_ROWS))
def s02(spark, sf):
    rows = files.candle_chunks(spark, _chunk_files(spark, sf))
    return rounded(rows, ["asset", "ts", "file", "window_start", "window_end"], PRICES)


@query("S03_chunk_file_window", W(BARS, f"{CHUNK_ROWS} WHERE ts BETWEEN 1704500000 AND 1705300000"))
def s03_files(spark, sf):
    """Only files whose name overlaps the window are opened."""
    rows = files.candle_chunks(spark, _chunk_files(spark, sf), 1704500000, 1705300000)
    return rounded(rows, ["asset", "ts", "file", "window_start", "window_end"], PRICES)


#: One text file a nation, with its customers.
NATIONS = """nt AS (SELECT n.n_name AS nation, '# ' || n.n_name || chr(10) || string_agg(c.c_name, chr(10) ORDER BY c.c_custkey) || chr(10) AS body
  FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1)"""


def _nation_files(spark, sf):
    path = folder(spark, "nations")
    names = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("_c"))
    body = F.concat(F.lit("# "), "n_name", F.lit("\n"), F.array_join(F.transform("_c", lambda c: c["c_name"]), "\n"))
    made = table(spark, sf, "nation").join(names, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("nation"), body.alias("body"))
    made.write.partitionBy("nation").text(path)
    return path


@query("S06_file_integrity", W(NATIONS, "SELECT sha256(body) AS sha256, CAST(strlen(body) AS BIGINT) AS bytes FROM nt"))
def s06(spark, sf):
    return files.file_hashes(spark, f"{_nation_files(spark, sf)}/*", "*.txt").select("sha256", "bytes")


@query("S09_text_documents", W(NATIONS, "SELECT nation AS title, 'study_note' AS source_type, md5(body) AS text FROM nt"))
def s09(spark, sf):
    return files.text_documents(spark, f"{_nation_files(spark, sf)}/*", "study_note").select("title", "source_type", F.md5("text").alias("text"))


@query("S08_campaign_reports", W(DECISIONS, """SELECT variant || '-' || account % 16 AS campaign_id, 'live' AS mode, asset, ts AS "timestamp", risk_action, h.horizon_min, h.maturity,
    CASE h.maturity WHEN 'matured' THEN 'PROFIT' ELSE 'NONE' END AS risk_status, round(conviction, 3) + 0.0 AS edge_pct
    FROM decisions, (VALUES (15, 'matured'), (60, 'data_gap')) h(horizon_min, maturity) WHERE account % 16 <> 3"""))
def s08(spark, sf):
    path, lit = folder(spark, "reports"), F.lit
    seen = lambda maturity, status: F.struct(lit(maturity).alias("maturity"), lit(1.0).alias("raw_move_pct"), F.struct(
        lit(status).alias("status"), F.col("conviction").alias("directional_edge_after_cost_pct")).alias("risk"))
    row = F.struct("variant", F.col("ts").alias("timestamp"), lit("ok").alias("status"), F.col("execution_price").alias("price"), "risk_action",
                   F.create_map(lit("15"), seen("matured", "PROFIT"), lit("60"), seen("data_gap", "NONE")).alias("horizons"))
    # Reports that are still running count for nothing.
    state = F.when(F.col("account") % 16 == 3, "RUNNING").otherwise("COMPLETED")
    # A report holds one account over 30 days: more accounts or a longer time make more reports, not larger ones.
    page = F.concat_ws("-", "account", F.floor(F.col("ts") / (30 * 86400)))
    d = decisions(spark, sf)
    made = d.groupBy(F.concat_ws("-", "variant", F.col("account") % 16).alias("campaign_id"), state.alias("status"), "asset", page.alias("page")).agg(
        F.collect_list(row).alias("results")).withColumn("config", F.struct("asset", lit("live").alias("news_mode")))
    # A file holds an array of reports, about REPORT_ROWS result rows: files grow in number with the decisions, not with the accounts.
    parts = -(-d.count() // REPORT_ROWS) or 1
    part = F.pmod(F.xxhash64("campaign_id", "status", "asset", "page"), lit(parts))
    filed = made.groupBy(part.alias("part")).agg(F.collect_list(F.struct("campaign_id", "status", "config", "results")).alias("reports"))
    filed.select(F.to_json("reports").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    out = files.report_horizons(files.campaign_reports(spark, [path, path]))
    return rounded(out, ["campaign_id", "mode", "asset", "timestamp", "risk_action", "horizon_min", "maturity", "risk_status"], ["edge_pct"], 3)


@query("S17_barrier_export", f"SELECT *, 'events-1h' AS source_fingerprint FROM ({ORACLES['M06_first_touch_barriers']})")
def s17(spark, sf):
    path = folder(spark, "barriers")
    sinks.write_labels(QUERIES["M06_first_touch_barriers"](spark, sf), path, "events-1h")
    return sinks.read_published(spark, path)


def _archives(made, path, by=()):
    """Vendor archives of bars: every third row opens some seconds before its minute and is moved up to it."""
    opened = (F.col("ts") + F.when(F.col("ts") / 3600 % 3 == 0, -7).otherwise(0)) * 1000
    made = made.withColumn("open_time", opened)
    blank = {c: F.lit(0) for c in schemas.ARCHIVE_CSV.names if c not in made.columns}
    made.withColumns(blank).select(*schemas.ARCHIVE_CSV.names, *by).write.partitionBy(*by).csv(path)


@query("S05_archive_scan", W(BARS, BAR_ROWS))
def s05(spark, sf):
    """One archive folder a market, each scanned under its own name."""
    path = folder(spark, "archive")
    _archives(bars(spark, sf), path, ["asset"])
    scans = [files.archive_csv(spark, f"{path}/asset={name}", name)[0] for name in ("click", "error", "purchase", "signup", "view")]
    return rounded(reduce(DataFrame.unionByName, scans), ["asset", "ts"], PRICES)


@query("S05_archive_scan_all", W(BARS, BAR_ROWS))
def s05_all(spark, sf):
    path = folder(spark, "archives")
    _archives(bars(spark, sf), path, ["asset"])
    rows, _ = files.archive_csv(spark, path, None)
    return rounded(rows, ["asset", "ts"], PRICES)


@query("S07_feed_items", W(NEWS, "SELECT ts, source, md5(trim(regexp_replace(headline, '\\s+', ' ', 'g'))) AS headline FROM news WHERE trim(headline) <> ''"))
def s07(spark, sf):
    path = folder(spark, "feed")
    stamp = F.date_format(F.timestamp_seconds("ts"), "EEE, d MMM yyyy HH:mm:ss")
    made = news(spark, sf).select("source", F.col("headline").alias("title"), F.concat(stamp, F.lit(" GMT")).alias("pubDate"))
    made.write.partitionBy("source").format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return files.rss_items(spark, path, None).select("ts", "source", F.md5("headline").alias("headline"))


@query("S13_published_table", W(BARS, BAR_ROWS))
def s13(spark, sf):
    path = folder(spark, "published")
    # The second version replaces the first as a whole.
    sinks.publish_table(bars(spark, sf).filter("ts % 7200 = 0"), path, partition_by=["asset"])
    sinks.publish_table(bars(spark, sf), path, partition_by=["asset"])
    return rounded(sinks.read_published(spark, path), ["asset", "ts"], PRICES)


@query("S18_table_copy_counts", """SELECT * FROM (SELECT 'customer' AS "table", count(*) AS left_rows, count(*) FILTER (WHERE c_custkey % 10 <> 0) AS right_rows FROM customer
  UNION ALL SELECT 'labels', count(*), NULL FROM labels)""")
def s18(spark, sf):
    names = ("customer", "nation", "orders")
    source = {n: table(spark, sf, n) for n in names}
    copies = {n: materialize(sinks.copy_columns(d.filter("c_custkey % 10 <> 0") if n == "customer" else d, d.columns), "copy") for n, d in source.items()}
    return sinks.count_differences({**source, "labels": table(spark, sf, "labels")}, copies)


@query("M10_partition_import", W(BARS, BAR_ROWS))
def m10(spark, sf):
    path = folder(spark, "imported")
    rows = bars(spark, sf).withColumn("ingest_seq", F.lit(1).cast("bigint"))
    even = materialize(rows.filter("ts % 7200 = 0"), "even")
    # The second import holds all rows again and replaces those of the first.
    sinks.import_partition(even.withColumn("close", F.lit(0.0)), path, even.count())
    whole = materialize(rows, "whole")
    sinks.import_partition(whole, path, whole.count())
    return rounded(spark.read.parquet(path), ["asset", "ts"], PRICES)


#: Hourly bars as they arrive: some too early, some too late.
DELAYS = "CASE WHEN ts / 3600 % 11 = 0 THEN -120 WHEN ts / 3600 % 7 = 0 THEN 1500 ELSE 30 END"


def _arrivals(spark, sf):
    return stream(bars(spark, sf).withColumn("received_at", (F.col("ts") + F.expr(DELAYS)).cast("bigint")), "arrivals")


def _fed(spark, sf):
    at = folder(spark, "fed")
    finish(feeds.candle_upserts(_arrivals(spark, sf), f"{at}/bars", f"{at}/rejected", f"{at}/checkpoint", 3600))
    return at


@query("R01_candle_feed", W(BARS, f"{BAR_ROWS} WHERE ({DELAYS}) = 30"))
def r01(spark, sf):
    return rounded(spark.read.parquet(f"{_fed(spark, sf)}/bars"), ["asset", "ts"], PRICES)


@query("R02_feed_rejections", W(BARS, f"SELECT asset, ts, CASE WHEN ({DELAYS}) < 0 THEN 'future' ELSE 'late' END AS rejection FROM bars WHERE ({DELAYS}) <> 30"))
def r02(spark, sf):
    return spark.read.parquet(f"{_fed(spark, sf)}/rejected").select("asset", "ts", "rejection")


@query("R03_news_feed", W(NEWS, "SELECT min(ts) AS ts, source, md5(headline) AS headline FROM news GROUP BY source, headline"))
def r03(spark, sf):
    at = folder(spark, "headlines")
    finish(feeds.news_inserts(stream(news(spark, sf).select("ts", "source", "headline"), "news"), f"{at}/news", f"{at}/checkpoint"))
    return spark.read.parquet(f"{at}/news").select("ts", "source", F.md5("headline").alias("headline"))


@query("R04_heartbeat_feed", """WITH w AS (SELECT n.worker, n.age, max(CAST(floor(epoch(e.ts)) AS BIGINT)) AS ts FROM (VALUES ('click', 3600), ('purchase', 60), ('absent', 60)) n(worker, age)
  LEFT JOIN events e ON e.event_type = n.worker GROUP BY 1, 2)
  SELECT worker, CASE WHEN ts IS NULL THEN 'missing' ELSE 'seen' END AS state, ts FROM w""")
def r04(spark, sf):
    at = folder(spark, "health")
    beats = events(spark, sf).select(F.col("event_type").alias("worker"), F.col("t").alias("ts"))
    finish(feeds.heartbeats(stream(beats, "beats"), f"{at}/health", f"{at}/checkpoint", lambda: 1706800000, {"click": 3600, "purchase": 60, "absent": 60}))
    found = spark.read.parquet(f"{at}/health")
    return found.select("worker", F.when(F.col("status") == "missing", "missing").otherwise("seen").alias("state"), F.col("heartbeat").alias("ts"))


@query("R05_decision_tail", W(BARS, BAR_ROWS))
def r05(spark, sf):
    at, feed = folder(spark, "tail"), _arrivals(spark, sf)
    # The second run finds nothing new behind its checkpoint.
    for _ in range(2):
        finish(feeds.decision_tail(feed, f"{at}/rows", f"{at}/checkpoint"))
    return rounded(spark.read.parquet(f"{at}/rows"), ["asset", "ts"], PRICES)


# Windows behind the watermark (the newest bar less the delay) are final and written; later ones wait for more bars.
@query("R06_streaming_bars", W(BARS, f"""SELECT asset, bin_end, max(ts) AS ts, {R('arg_min(open, ts)', 'open')}, {R('max(high)', 'high')}, {R('min(low)', 'low')}, {R('arg_max(close, ts)', 'close')}, {R('sum(volume)', 'volume')},
    count(*) AS observations FROM (SELECT *, (ts - 1) // 14400 * 14400 + 14400 AS bin_end FROM bars) WHERE bin_end <= (SELECT max(ts) - 1 - 1200 FROM bars) GROUP BY 1, 2"""))
def r06(spark, sf):
    return rounded(streamed(windows.tumbling_bars(stream(bars(spark, sf), "bars"), 240), "tumbling"), ["asset", "bin_end", "ts", "observations"], PRICES)


@query("R07_streaming_regimes", W(BARS, f"""SELECT asset, start_ts, end_ts, candles, label, {R('move', 'move_pct', 3)}, {R('vol', 'volatility_pct', 3)} FROM (
    SELECT *, CASE WHEN move >= 10 THEN 'UPTREND' WHEN move <= -10 THEN 'DOWNTREND' WHEN abs(move) <= 2 THEN 'SIDEWAYS' ELSE 'MIXED' END AS label FROM (
      SELECT asset, s AS start_ts, s + 43200 AS end_ts, count(*) AS candles, round((arg_max(close, ts) / arg_min(close, ts) - 1) * 100, 4) AS move, round(coalesce(stddev_pop(ret), 0), 4) AS vol
      FROM (SELECT *, (close / lag(close) OVER (PARTITION BY asset, s ORDER BY ts) - 1) * 100 AS ret FROM (SELECT *, ts // 14400 * 14400 - unnest([0, 14400, 28800]) AS s FROM bars))
      WHERE s + 43200 <= (SELECT max(ts) - 1200 FROM bars) GROUP BY 1, 2))"""))
def r07(spark, sf):
    made = windows.sliding_regimes(stream(bars(spark, sf), "bars"), 10.0, 2.0, "12 hours", "4 hours")
    return rounded(streamed(made, "regimes"), ["asset", "start_ts", "end_ts", "candles", "label"], ["move_pct", "volatility_pct"], 3)


@query("R08_maturity_join", W(f"{BARS}, {DECISIONS}", f"""SELECT decision_id, CASE WHEN f IS NULL THEN 'data_gap' ELSE 'matured' END AS maturity, f AS future_ts, {R('p', 'future_price')} FROM (
    SELECT d.decision_id, any_value(d.ts) + 14400 AS target, min(b.ts) AS f, arg_min(b.close, b.ts) AS p FROM decisions d
    LEFT JOIN bars b ON b.asset = d.asset AND b.ts BETWEEN d.ts + 14400 AND d.ts + 14400 + 1800 GROUP BY 1)
    WHERE f IS NOT NULL OR target + 1800 < (SELECT least(max(d.ts) + 14400, (SELECT max(ts) FROM bars)) - 600 FROM decisions d)"""))
def r08(spark, sf):
    d = stream(decisions(spark, sf).select("decision_id", "asset", "ts"), "decisions")
    out = maturity.first_matches(streamed(maturity.maturity_join(d, stream(bars(spark, sf), "bars"), 240, 1800), "maturity"))
    return rounded(out, ["decision_id", "maturity", "future_ts"], ["future_price"])


# Rows are judged once the watermark has passed them.
@query("R09_cooldown_state", W(f"{DECISIONS}, {greedy_sql('decisions', ['account', 'proposed_action'], 86401)}",
    """SELECT c.account, c.proposed_action AS action, c.decision_id, t.ts IS NULL OR c.decision_id <> min(c.decision_id) OVER (PARTITION BY c.account, c.proposed_action, c.ts) AS in_cooldown
    FROM decisions c LEFT JOIN taken t USING (account, proposed_action, ts) WHERE c.ts < (SELECT max(ts) - 600 FROM decisions)""", True))
def r09(spark, sf):
    d = decisions(spark, sf).select("account", F.col("proposed_action").alias("action"), "decision_id", "ts")
    return streamed(state.cooldown(stream(d, "proposals"), 86400), "cooldown").select("account", "action", "decision_id", "in_cooldown")


@query("R10_daily_equity_state", W(BARS, f"""SELECT asset, ts, day_start, {R('ref', 'reference_equity', 4)}, {R('greatest(0, (ref - close) / ref * 100)', 'daily_drawdown_pct', 4)} FROM (
    SELECT *, (ts - 10800) // 86400 * 86400 + 10800 AS day_start, first_value(close) OVER (PARTITION BY asset, (ts - 10800) // 86400 ORDER BY ts) AS ref FROM bars) WHERE ts < (SELECT max(ts) - 3600 FROM bars)"""))
def r10(spark, sf):
    b = bars(spark, sf).select("asset", F.col("ts").alias("id"), "ts", F.col("close").alias("equity"))
    return rounded(streamed(state.daily_drawdown(stream(b, "equity")), "equity-state"), ["asset", "ts", "day_start"], ["reference_equity", "daily_drawdown_pct"], 4)
