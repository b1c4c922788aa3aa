"""Leakage-safe splits: purged ranges, walk-forward folds, evaluation manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import chunks as C

PARTS = ("development", "validation", "holdout")


def _cut(n: Column, ratio: float) -> Column:
    return F.floor(n * F.lit(ratio)).cast("bigint")


def chronological_cuts(rows: DataFrame, width: int, train: float = 0.60, validation: float = 0.20,
                       keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Start timestamps of the validation and test part per key, by row counts."""
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("split ratios are invalid")
    n = F.col("_n_total")
    spots = F.array(_cut(n, train), _cut(n, train + validation))
    found = C.rows_at_positions(rows, keys, "ts", spots, width)
    return found.groupBy(*keys).agg(F.min("ts").alias("validation_start"), F.max("ts").alias("test_start"))


def chronological_split(rows: DataFrame, width: int, *, train: float = 0.60, validation: float = 0.20,
                        purge_minutes: int = 60, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Add ``part`` (train, validation, test); rows inside a purge gap are dropped."""
    cuts = chronological_cuts(rows, width, train, validation, keys)
    ts, gap = F.col("ts"), F.lit(purge_minutes * 60)
    v, t = F.col("validation_start"), F.col("test_start")
    part = (F.when(ts >= t, "test")
            .when((ts >= v) & (ts + gap < t), "validation")
            .when(ts + gap < v, "train"))
    return (rows.join(cuts, list(keys)).withColumn("part", part).filter(F.col("part").isNotNull())
            .drop("validation_start", "test_start"))


def sub_split(rows: DataFrame, width: int, *, first: float = 0.60, purge_minutes: int = 60,
              keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Two purged parts of an already bounded range: ``first`` and ``second``."""
    cuts = C.rows_at_positions(rows, keys, "ts", F.array(_cut(F.col("_n_total"), first)), width)
    cuts = cuts.select(*keys, F.col("ts").alias("_second"))
    ts, gap = F.col("ts"), F.lit(purge_minutes * 60)
    part = F.when(ts >= F.col("_second"), "second").when(ts + gap < F.col("_second"), "first")
    return rows.join(cuts, list(keys)).withColumn("part", part).filter(F.col("part").isNotNull()).drop("_second")


def walk_forward_folds(rows: DataFrame, width: int, *, minimum_train: int, selection: int, calibration: int,
                       test: int, step: int | None = None, purge_minutes: int = 0,
                       keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Expanding folds as (key, fold, part, start_ts, end_ts), closed ranges.

    Each part but the last ends before the next start minus the purge.
    """
    sizes = (minimum_train, selection, calibration, test)
    step = test if step is None else step
    if min(sizes) <= 0 or step <= 0 or purge_minutes < 0:
        raise ValueError("walk-forward sizes are invalid")
    n = F.col("_n_total")
    folds = F.floor((n - sum(sizes)) / F.lit(step)).cast("bigint")
    per_fold = F.transform(
        F.when(folds >= 0, F.sequence(F.lit(0).cast("bigint"), folds)).otherwise(F.array().cast("array<bigint>")),
        lambda f: F.array(
            minimum_train + f * step, minimum_train + selection + f * step,
            minimum_train + selection + calibration + f * step, sum(sizes) - 1 + f * step))
    spots = F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), F.flatten(per_fold)))
    found = C.rows_at_positions(rows, keys, "ts", spots, width)
    # Positions of one key: a few per fold.
    at = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("position", "ts"))).alias("_at"),
                                  F.max("position").alias("_last"))
    count = F.floor((F.col("_last") - (sum(sizes) - 1)) / F.lit(step)).cast("bigint")
    fold = at.filter(F.col("_last") >= sum(sizes) - 1).withColumn(
        "fold", F.explode(F.sequence(F.lit(0).cast("bigint"), count)))
    spot = lambda base: F.col("_at")[(F.lit(base) + F.col("fold") * step).cast("bigint")]
    gap = F.lit(purge_minutes * 60 + 1)
    starts = [F.col("_at")[F.lit(0).cast("bigint")], spot(minimum_train), spot(minimum_train + selection),
              spot(minimum_train + selection + calibration)]
    ends = [starts[1] - gap, starts[2] - gap, starts[3] - gap, spot(sum(sizes) - 1)]
    names = ("train", "selection", "calibration", "test")
    parts = F.array(*[F.struct(F.lit(p).alias("part"), s.alias("start_ts"), e.alias("end_ts"))
                      for p, s, e in zip(names, starts, ends)])
    return fold.select(*keys, "fold", F.inline(parts))


def fold_members(rows: DataFrame, folds: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Rows with every (fold, part) that holds them."""
    table = folds.groupBy(*keys).agg(F.collect_list(F.struct("fold", "part", "start_ts", "end_ts")).alias("_folds"))
    inside = F.filter("_folds", lambda f: F.col("ts").between(f["start_ts"], f["end_ts"]))
    return (rows.join(table, list(keys)).withColumn("_in", inside)
            .select(*rows.columns, F.inline("_in")).drop("start_ts", "end_ts"))


def manifest_ranges(bars: DataFrame, *, development: float = 0.60, validation: float = 0.20,
                    purge_minutes: int = 1440, step: int = 60, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Three ranges per key by elapsed time with a purge on both sides of each cut."""
    if not (0 < development < 1 and 0 < validation < 1 and development + validation < 1 and purge_minutes >= 0):
        raise ValueError("split ratios or purge are invalid")
    span = bars.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_z"))
    a, z = F.col("_a"), F.col("_z")
    cut = lambda r: (lambda x: x - F.pmod(x, F.lit(step)))(a + F.floor((z - a) * F.lit(r)).cast("bigint"))
    first, second = cut(development), cut(development + validation)
    purge = F.lit(purge_minutes * 60)
    ranges = [(a, first - purge - step), (first + purge, second - purge - step), (second + purge, z)]
    rows = F.array(*[F.struct(F.lit(p).alias("part"), s.alias("start_ts"), e.alias("end_ts"), F.lit(p == "holdout").alias("sealed"))
                     for p, (s, e) in zip(PARTS, ranges)])
    return span.select(*keys, F.inline(rows))


def partition_rows(bars: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Rows with the part that holds them (three ranges per key)."""
    table = ranges.groupBy(*keys).agg(F.collect_list(F.struct("part", "start_ts", "end_ts")).alias("_ranges"))
    hit = F.get(F.filter("_ranges", lambda r: F.col("ts").between(r["start_ts"], r["end_ts"])), F.lit(0))
    return (bars.join(table, list(keys)).withColumn("part", hit["part"]).drop("_ranges")
            .filter(F.col("part").isNotNull()))


def partition_coverage(bars: DataFrame, ranges: DataFrame, width: int, step: int = 60,
                       keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Rows, bounds, expected bars, coverage and longest gap per part."""
    inside = partition_rows(bars, ranges, keys)
    linked = C.previous_row(inside.select(*keys, "ts", "part"), keys, "ts", ["ts", "part"], width)
    gap = F.when(F.col("prev_part") == F.col("part"), F.floor((F.col("ts") - F.col("prev_ts")) / step) - 1)
    stats = linked.groupBy(*keys, "part").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.greatest(F.coalesce(F.max(gap), F.lit(0)), F.lit(0)).cast("bigint").alias("maximum_gap"))
    expected = F.floor((F.col("end_ts") - F.col("start_ts")) / step) + 1
    return (ranges.join(stats, [*keys, "part"], "left").withColumn("expected", expected.cast("bigint"))
            .withColumn("observed_coverage", F.round(F.coalesce("rows", F.lit(0)) / expected, 6)))


def evaluation_manifest(bars: DataFrame, sources: DataFrame, width: int, *, development: float = 0.60,
                        validation: float = 0.20, purge_minutes: int = 1440, step: int = 60,
                        keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Partition rows bound to a dataset id over ranges, coverage and source hashes.

    ``sources``: keys, name, rows, first_ts, last_ts, sha256 (one row per file).
    """
    ranges = manifest_ranges(bars, development=development, validation=validation,
                             purge_minutes=purge_minutes, step=step, keys=keys)
    parts = partition_coverage(bars, ranges, width, step, keys)
    own = fingerprint(sources, keys, ["name", "rows", "first_ts", "last_ts", "sha256"], "source_fingerprint")
    contract = fingerprint(parts, keys, ["part", "start_ts", "end_ts", "rows", "first_ts", "last_ts",
                                         "maximum_gap", "expected"], "_parts")
    split = f"{development}|{validation}|{purge_minutes}"
    joined = parts.join(own, list(keys), "left").join(contract, list(keys))
    dataset_id = F.substring(F.sha2(F.concat_ws("\n", F.lit(split), "source_fingerprint", "_parts"), 256), 1, 24)
    return joined.withColumn("dataset_id", dataset_id).drop("_parts")


def open_partition(manifest: DataFrame, part: str, unsealed_id: str | None = None) -> DataFrame:
    """Ranges of a part; a sealed one only shows when its dataset id is named."""
    rows = manifest.filter(F.col("part") == part)
    allowed = ~F.col("sealed") if unsealed_id is None else (~F.col("sealed") | (F.col("dataset_id") == unsealed_id))
    return rows.filter(allowed)


def fingerprint(rows: DataFrame, keys: Sequence[str], cols: Sequence[str], out: str = "fingerprint") -> DataFrame:
    """Order-independent sha256 of small contract tables (files, windows, variants)."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    joined = F.concat_ws("\n", F.array_sort(F.collect_list(text)))
    return rows.groupBy(*keys).agg(F.sha2(joined, 256).alias(out))
