"""File scans: candle files, payloads, archives, feeds, reports, documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions import clock
from tidemark.operators import quality


def _candles(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("symbol").alias("asset"), F.col("timestamp").alias("ts"), "open", "high", "low", "close", "volume")


def candle_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Canonical candle files; a header that differs or a broken row fails the job."""
    return _candles(spark.read.schema(schemas.CANDLE_CSV).option("header", True).option("enforceSchema", False)
                    .option("mode", "FAILFAST").csv(path))


def candle_csv_quarantine(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Candles of the rows that can be read, and all others as text with their file and the fields that are missing or wrong."""
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schemas.CANDLE_CSV])
    rows = (spark.read.schema(as_text).option("header", True).option("enforceSchema", False).csv(path)
            .withColumn("file", F.col("_metadata.file_name")))
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in schemas.CANDLE_CSV}
    wrong = F.filter(F.array(*[F.when(v.isNull(), F.lit(n)) for n, v in typed.items()]), lambda n: n.isNotNull())
    marked = rows.withColumn("wrong", wrong)
    good = marked.filter(F.size("wrong") == 0).withColumns(typed)
    return _candles(good), marked.filter(F.size("wrong") > 0).select("file", "wrong", *schemas.CANDLE_CSV.names)


def file_window() -> tuple[Column, Column]:
    """Start and end a chunk file declares in its name (``start_end.csv``); another name is refused."""
    name = F.col("_metadata.file_name")
    pattern = r"^(-?\d+)_(-?\d+)\."
    refused = F.raise_error(F.concat(F.lit("a chunk file is named start_end.csv, not "), name)).cast("bigint")
    part = lambda k: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, k).cast("bigint")).otherwise(refused)
    return part(1), part(2)


def candle_chunks(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Chunk files with file, declared window and row position; bounds skip whole files.

    The window predicate only reads file metadata, so files outside are not opened.
    """
    first, last = file_window()
    rows = (spark.read.schema(schemas.CANDLE_CSV).option("header", True).option("enforceSchema", False)
            .option("mode", "FAILFAST").csv(path))
    out = rows.select(
        F.col("symbol").alias("asset"), F.col("timestamp").alias("ts"), "open", "high", "low", "close", "volume",
        F.col("_metadata.file_name").alias("file"), first.alias("window_start"), last.alias("window_end"),
        F.col("_metadata.file_block_start").alias("_block"))
    if start is not None:
        out = out.filter((F.col("window_end") >= start) & (F.col("ts") >= start))
    if end is not None:
        out = out.filter((F.col("window_start") <= end) & (F.col("ts") <= end))
    return out.drop("_block")


def partition_scan(bars: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of [start, end] from a table partitioned by ``day``; both predicates prune."""
    return bars.filter(F.col("day").between(start // 86400, end // 86400) & F.col("ts").between(start, end))


def context_window(start: int, end: int, history: int, gap_minutes: int, horizons: Sequence[int], tf: int = 60) -> tuple[int, int]:
    """Bounds of the rows a chunk needs to emit its own rows."""
    return start - history * tf - gap_minutes * 60, end + max(horizons) * 60


PAYLOAD = "t ARRAY<BIGINT>, o ARRAY<DOUBLE>, h ARRAY<DOUBLE>, l ARRAY<DOUBLE>, c ARRAY<DOUBLE>, v ARRAY<DOUBLE>"


def payload_candles(payloads: DataFrame, payload: str = "payload", strict: bool = True) -> DataFrame:
    """Column-array payloads to rows; arrays of different length are an error, or dropped where the caller says so."""
    body = F.from_json(F.col(payload), PAYLOAD)
    rows = payloads.withColumn("_p", body)
    sizes = [F.size(F.col(f"_p.{k}")) for k in "tohlcv"]
    even = sizes[0] >= 0
    for s in sizes[1:]:
        even = even & (s == sizes[0])
    even = F.coalesce(even, F.lit(False))
    if strict:
        even = F.when(even, F.lit(True)).otherwise(
            F.raise_error(F.lit("candle arrays are missing or differ in length")).cast("boolean"))
    zipped = F.arrays_zip(*[F.col(f"_p.{k}").alias(k) for k in "tohlcv"])
    keep = [c for c in payloads.columns if c != payload]
    return (rows.filter(even).select(*keep, F.inline(zipped))
            .withColumnsRenamed({"t": "ts", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}))


def archive_csv(spark: SparkSession, path: str | Sequence[str], asset: str | None, max_offset: int = 30) -> tuple[DataFrame, DataFrame]:
    """Unzipped vendor archives: canonical candles, and counts of realigned timestamps.

    Without an ``asset`` the path holds one ``asset=`` folder an archive; all are read, and counts are given for each.
    """
    schema = T.StructType([*schemas.ARCHIVE_CSV, *([T.StructField("asset", T.StringType())] if asset is None else [])])
    raw = spark.read.schema(schema).option("header", False).option("mode", "FAILFAST").csv(path)
    source = clock.epoch_from_raw(F.col("open_time"))
    moved = clock.realign(source, 60, max_offset)
    guard = F.when(moved.isNotNull(), moved).otherwise(
        F.raise_error(F.lit("archive timestamp outside the grid")).cast("bigint"))
    named = F.col("asset") if asset is None else F.lit(asset).alias("asset")
    rows = raw.select(named, guard.alias("ts"), "open", "high", "low", "close", "volume", source.alias("_source"))
    stats = realign_stats(rows, "_source", "ts", ["asset"] if asset is None else [])
    return quality.require_valid(rows.drop("_source")), stats


def realign_stats(rows: DataFrame, source: str, moved: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows that stand on the grid or were moved to it, and those that are too far off and must be refused (a null ``moved``)."""
    shift = F.col(moved) - F.col(source)
    return rows.groupBy(*keys).agg(F.count(moved).alias("rows"), F.count_if(shift != 0).alias("realigned_rows"), F.count_if(F.col(moved).isNull()).alias("refused_rows"),
                                   F.coalesce(F.max(F.abs(shift)), F.lit(0)).cast("bigint").alias("maximum_realign_seconds"))


def on_grid(rows: DataFrame, ts: str, step: int = 60, max_offset: int = 30) -> DataFrame:
    """Rows with ``ts`` moved up to the grid; a row farther off than ``max_offset`` fails the job."""
    refused = F.raise_error(F.concat(F.lit("timestamp outside the grid: "), F.col(ts).cast("string"))).cast("bigint")
    return rows.withColumn(ts, F.when(F.col(ts).isNotNull(), F.coalesce(clock.realign(F.col(ts), step, max_offset), refused)))


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, size and sha-256 of every file, hashed where it is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"),
                        F.sha2("content", 256).alias("sha256"))


def changed_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing, new or different from the manifest (name, sha256)."""
    joined = found.select("name", F.col("sha256").alias("_have")).join(
        manifest.select("name", F.col("sha256").alias("_want")), "name", "full_outer")
    state = (F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unlisted")
             .when(F.col("_have") != F.col("_want"), "changed"))
    return joined.withColumn("state", state).filter(F.col("state").isNotNull()).select("name", "state")


def checksum_text(text: Column) -> tuple[Column, Column]:
    """Hash and file name of a ``CHECKSUM`` line."""
    pattern = r"^\s*([0-9a-fA-F]{64})\s+\*?(\S+)\s*$"
    return F.lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def rss_items(spark: SparkSession, path: str, source: str | None, limit: int | None = None) -> DataFrame:
    """Items of RSS feed files: ts, headline, source; with ``limit`` the first ones of each file.

    Without a ``source`` the path holds one ``source=`` folder a feed, and all are read in one scan.
    """
    named = ", source STRING" if source is None else ""
    rows = (spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", True)
            .schema(f"title STRING, pubDate STRING, date STRING{named}").load(path)
            # Feed folders may hold files of one name: a file is known by its whole path.
            .select("title", F.coalesce("pubDate", "date").alias("published"), F.col("_metadata.file_path").alias("file"),
                    F.monotonically_increasing_id().alias("_seq"), (F.col("source") if source is None else F.lit(source)).alias("source")))
    return feed_rows(rows, F.col("source"), limit)


def feed_rows(rows: DataFrame, source: str | Column, limit: int | None = None) -> DataFrame:
    """``rows``: title, published, file, _seq; ``source`` names all of them or is a column."""
    source = source if isinstance(source, Column) else F.lit(source)
    headline = F.trim(F.regexp_replace("title", r"\s+", " "))
    stamp = F.regexp_replace("published", r"^\w{3},\s*", "")
    ts = F.coalesce(F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss z")),
                    F.try_to_timestamp("published"))
    w = Window.partitionBy("file").orderBy("_seq")
    named = rows.filter(F.col("title").isNotNull() & (headline != ""))
    if limit is not None:
        named = named.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    return (named.select(F.coalesce(F.unix_timestamp(ts), F.unix_timestamp(F.current_timestamp())).alias("ts"), headline.alias("headline"),
                    source.alias("source")))


RESULT = ("variant STRING, window_id STRING, regime STRING, timestamp BIGINT, status STRING, price DOUBLE, llm_action STRING, "
          "risk_action STRING, risk_reason STRING, llm_technical_failure BOOLEAN, llm_conviction DOUBLE, executed_size DOUBLE, "
          "horizons MAP<STRING, STRUCT<maturity: STRING, raw_move_pct: DOUBLE, risk: STRUCT<status: STRING, "
          "directional_edge_after_cost_pct: DOUBLE>>>")
REPORT = ("campaign_id STRING, status STRING, config STRUCT<asset: STRING, timeframe: STRING, from_ts: BIGINT, to_ts: BIGINT, "
          f"news_mode: STRING>, results ARRAY<STRUCT<{', '.join(': '.join(part.split(' ', 1)) for part in RESULT.split(', ')[:12])}, "
          f"horizons: {RESULT.split('horizons ')[1]}>>")


def campaign_reports(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Result rows of completed campaign reports; repeated paths are read once."""
    reports = spark.read.schema(REPORT).option("multiLine", True).json(sorted(set(paths)))
    return (reports.filter(F.col("status") == "COMPLETED")
            .select("campaign_id", F.col("config.news_mode").alias("mode"), F.col("config.asset").alias("asset"), F.inline("results")))


def report_horizons(results: DataFrame) -> DataFrame:
    """Nested horizon map as long rows."""
    return results.select(*[c for c in results.columns if c != "horizons"], F.explode("horizons").alias("horizon_min", "_h")).select(
        "*", F.col("_h.maturity").alias("maturity"), F.col("_h.risk.status").alias("risk_status"),
        F.col("_h.risk.directional_edge_after_cost_pct").alias("edge_pct")).drop("_h").withColumn("horizon_min", F.col("horizon_min").cast("int"))


def text_documents(spark: SparkSession, path: str, source_type: str) -> DataFrame:
    """Whole text or markdown files as documents; the title is the first heading or the file name."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_name").alias("_name"))
    heading = F.regexp_extract("value", r"(?m)^#\s+(.+)$", 1)
    return rows.select(F.xxhash64("source").alias("doc_id"), F.lit(source_type).alias("source_type"), "source",
                       F.when(heading != "", heading).otherwise(F.col("_name")).alias("title"), F.col("value").alias("text"),
                       F.lit(None).cast("bigint").alias("published_at"))


def merged_series(bars: DataFrame) -> DataFrame:
    """All chunk files as one series, range-ordered for writing."""
    return bars.repartitionByRange("asset", "ts").sortWithinPartitions("asset", "ts")


def file_inspection(rows: DataFrame) -> DataFrame:
    """Row count and first and last timestamp per file and declared window."""
    return rows.groupBy("asset", "file", "window_start", "window_end").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


