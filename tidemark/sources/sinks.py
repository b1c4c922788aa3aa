"""Writing: upserts, insert-if-absent, event appends, exports, copies."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import chunks as C
from tidemark.session import materialize

#: Parts a day is written in, by asset, and parts of a table of keys, by hash.
ASSET_PARTS, KEY_PARTS = 16, 64
KEY_PART = "key_part"
POINTER = "_current"


def merged(existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last write per key of stored and incoming rows; ``order`` is the ingest sequence."""
    rows = incoming if existing is None else existing.withColumn(order, F.lit(-1).cast("bigint")).unionByName(incoming)
    return C.dedupe_last(rows, keys, [order]).drop(order)


def absent(incoming: DataFrame, existing: DataFrame | None, key: str, order: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored, the earliest of equal ones."""
    first = C.dedupe_last(incoming, [key], order, keep="first")
    return first if existing is None else first.join(existing.select(key).distinct(), key, "left_anti")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def upsert_bars(incoming: DataFrame, path: str, order: str = "ingest_seq", timeframe: int = 60) -> None:
    """Insert or replace candles in a table partitioned by day.

    Only the day partitions that receive rows are read and rewritten (dynamic
    partition overwrite); running it twice gives the same table. A day is
    written in parts of its assets, so a day of very many assets is many tasks.
    """
    spark = incoming.sparkSession
    day = F.floor(F.col("ts") / 86400).cast("bigint")
    fresh = materialize(incoming.withColumn("timeframe", F.lit(timeframe)).withColumn("day", day), "upsert")
    stored = _read(spark, path)
    if stored is not None:
        stored = stored.join(fresh.select("day").distinct(), "day", "left_semi")
    rows = merged(stored, fresh, ["asset", "timeframe", "ts"], order)
    # The touched partitions are read while they are replaced: write a copy first.
    staged = materialize(rows, "merged")
    staged.repartition("day", F.pmod(F.xxhash64("asset"), F.lit(ASSET_PARTS))).sortWithinPartitions("day", "asset", "ts").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def insert_absent(incoming: DataFrame, path: str, key: str, order: Sequence[str]) -> int:
    """Append rows with new keys and return how many there were.

    The table is partitioned by a hash of the key: a batch reads the keys of the
    partitions it has keys for, so at most one partition a key.
    """
    first = materialize(absent(incoming, None, key, order).withColumn(KEY_PART, F.pmod(F.xxhash64(key), F.lit(KEY_PARTS)).cast("int")), "candidates")
    stored = _read(incoming.sparkSession, path)
    if stored is not None:
        first = first.join(keys_of(stored, key, first), key, "left_anti")
    fresh = materialize(first, "insert")
    count = fresh.count()
    if count:
        fresh.repartition(KEY_PART).write.mode("append").partitionBy(KEY_PART).parquet(path)
    return count


def keys_of(stored: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Stored keys of the hash partitions that ``wanted`` has keys in; the others are not opened."""
    parts = [r[0] for r in wanted.select(KEY_PART).distinct().collect()]  # KEY_PARTS at most
    return stored.filter(F.col(KEY_PART).isin(parts)).select(key).distinct()


def append_events(events: DataFrame, path: str) -> None:
    """Audit rows are only ever appended; the current state is folded when read."""
    events.write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Plain files at a path, in place of those before. Readers during a write, or after a failed one, find less: see ``publish_table``."""
    _writer(df.write.mode("overwrite"), fmt, partition_by).save(path)


def _writer(writer, fmt: str, partition_by: Sequence[str]):
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    return writer.format(fmt)


def _file_context(spark: SparkSession, path: str):
    """The file system of a path, with a rename that replaces in one step."""
    contexts = spark._jvm.org.apache.hadoop.fs.FileContext
    uri, conf = spark._jvm.org.apache.hadoop.fs.Path(path).toUri(), spark._jsc.hadoopConfiguration()
    return contexts.getFileContext(uri, conf) if uri.getScheme() else contexts.getFileContext(conf)


def _rename(spark: SparkSession, path: str, source, target, replace: bool) -> None:
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if replace else kind.NONE
    _file_context(spark, path).rename(source, target, options)


def publish_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), keep: int = 2) -> str:
    """Publish a table as a whole: readers see the version before until all files of this one are written.

    Every version is a folder of its own. When it is complete, a small pointer
    file is written and renamed over the last one, which is one step of the file
    system. A write that fails leaves the pointer, and so the table, as it was.
    The newest ``keep`` versions stay, for readers that have begun. Works with
    any file system Spark can write to; returns the folder.
    """
    spark = df.sparkSession
    folder = f"{path.rstrip('/')}/version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    _writer(df.write.mode("errorifexists"), fmt, partition_by).save(folder)
    hadoop = spark._jvm.org.apache.hadoop.fs
    note = hadoop.Path(f"{path.rstrip('/')}/.{POINTER}-{uuid.uuid4().hex}")
    made = note.getFileSystem(spark._jsc.hadoopConfiguration()).create(note, True)
    made.write(bytearray(folder.rsplit("/", 1)[1].encode()))
    made.close()
    _rename(spark, path, note, hadoop.Path(f"{path.rstrip('/')}/{POINTER}"), replace=True)
    for old in versions(spark, path)[:-keep] if keep else []:
        if old != folder:
            _file_context(spark, path).delete(hadoop.Path(old), True)
    return folder


def versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of all versions at a path, complete or not, oldest first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(place) if s.isDirectory()] if store.exists(place) else []
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names) if n.startswith("version-")]


def published_folder(spark: SparkSession, path: str) -> str:
    """Folder of the published version, as the pointer names it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{POINTER}")
    note = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return f"{path.rstrip('/')}/{spark._jvm.org.apache.commons.io.IOUtils.toString(note, 'UTF-8')}"
    finally:
        note.close()


def read_published(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The published version of a table; a reader keeps its version when a newer one comes."""
    reader = spark.read.option("header", True).option("escape", '"') if fmt == "csv" else spark.read
    return reader.format(fmt).load(published_folder(spark, path))


def write_labels(labels: DataFrame, path: str, source_fingerprint: str) -> None:
    """Barrier labels bound to the fingerprint of their source, published as a whole."""
    publish_table(labels.withColumn("source_fingerprint", F.lit(source_fingerprint)), path, partition_by=["horizon"])


def write_chunks(rows: DataFrame, path: str, seconds: int, ts: str = "timestamp") -> int:
    """CSV files named by the window they hold (``start_end.csv``), one a window of ``seconds``; returns how many.

    Spark writes one file for each window; the driver only renames them.
    """
    spark = rows.sparkSession
    start = F.col(ts) - F.pmod(F.col(ts), F.lit(seconds))
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    windowed = rows.withColumn("_window", start).repartition("_window").sortWithinPartitions("_window", ts)
    _writer(windowed.write, "csv", ["_window"]).save(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    for window in store.listStatus(hadoop.Path(staged)):
        name = window.getPath().getName()
        if not name.startswith("_window="):
            continue
        first = int(name.split("=", 1)[1])
        parts = [f.getPath() for f in store.listStatus(window.getPath()) if f.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise ValueError(f"window {first} was written in {len(parts)} files")
        _rename(spark, path, parts[0], hadoop.Path(f"{path.rstrip('/')}/{first}_{first + seconds - 1}.csv"), replace=False)
        n += 1
    store.delete(hadoop.Path(staged), True)
    return n


def copy_columns(source: DataFrame, target_columns: Sequence[str]) -> DataFrame:
    """Columns both sides have, in target order."""
    return source.select(*[c for c in target_columns if c in source.columns])


def count_differences(left: Mapping[str, DataFrame], right: Mapping[str, DataFrame]) -> DataFrame:
    """Tables whose row counts differ or that one side lacks."""
    def counts(tables):
        out = None
        for name, df in tables.items():
            part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
            out = part if out is None else out.unionByName(part)
        return out
    joined = counts(left).withColumnRenamed("rows", "left_rows").join(
        counts(right).withColumnRenamed("rows", "right_rows"), "table", "full_outer")
    return joined.filter(~F.col("left_rows").eqNullSafe(F.col("right_rows")))


def import_partition(rows: DataFrame, path: str, expected: int, order: str = "ingest_seq") -> int:
    """Upsert a partition after checking its row count against the manifest."""
    n = rows.count()
    if n != expected:
        raise ValueError(f"partition holds {n} rows, the manifest says {expected}")
    upsert_bars(rows, path, order)
    return n
