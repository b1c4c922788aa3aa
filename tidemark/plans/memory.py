"""Episodic decision memory: recent audited decisions as compact categorical rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.text import pick_enum
from tidemark.operators import chunks as C
from tidemark.operators import ranges
from tidemark.session import materialize

WINDOW = 7200
EPISODES = 8
# Allowed categories, everything else becomes UNKNOWN.
PROPOSED = ("BUY", "SELL", "HOLD", "SKIPPED")
FINAL = ("BUY", "SELL", "HOLD")
RSI = ("OVERSOLD", "OVERBOUGHT", "NEUTRAL", "UNKNOWN")
MACD = ("BULLISH_EXPANDING", "BEARISH_EXPANDING", "BULLISH_DIVERGENCE", "BEARISH_DIVERGENCE", "NEUTRAL", "UNKNOWN")
EMA = ("BULLISH", "BEARISH", "BULLISH_CROSS", "BEARISH_CROSS", "UNKNOWN")


def decoded(logs: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Snapshot fields of either shape (live or compact); malformed text gives nulls."""
    s = F.from_json(F.col(snapshot), schemas.SNAPSHOT, {"mode": "PERMISSIVE"})
    rows = logs.withColumn("_s", s)
    live = F.col("_s.technical_context").isNotNull()
    either = lambda a, b: F.when(live, F.col(f"_s.technical_context.{a}")).otherwise(F.col(f"_s.technical.{b}"))
    exposure = F.when(F.col("_s.portfolio_context").isNotNull(), F.col("_s.portfolio_context.current_exposure_percentage")
                      ).otherwise(F.col("_s.portfolio.current_exposure_percentage"))
    return rows.withColumns({
        "price": either("current_price", "current_price"), "rsi": either("rsi.value", "rsi_value"),
        "rsi_status": either("rsi.status", "rsi_status"), "macd_status": either("macd.status", "macd_status"),
        "ema_status": either("ema_crossover.status", "ema_status"), "exposure_pct": exposure,
        "market_stale": F.col("_s.data_health.is_market_data_stale"), "news_stale": F.col("_s.data_health.is_news_stale"),
        "red_flag": F.col("_s.news_risk.has_negative_red_flag"), "untrusted": F.col("_s.news_risk.has_untrusted_instruction"),
    }).drop("_s")


def _bounded(value: Column, low: float, high: float, digits: int) -> Column:
    kept = F.round(F.when(~F.isnan(value), value), digits)
    return F.when(kept.between(low, high), kept)


def justification_tags() -> Column:
    """Up to three ordered tags of a decoded decision."""
    c = F.col
    true = lambda name: F.coalesce(c(name), F.lit(False))
    rsi, macd, ema = pick_enum(c("rsi_status"), RSI), pick_enum(c("macd_status"), MACD), pick_enum(c("ema_status"), EMA)
    proposed, final = pick_enum(c("proposed_action"), PROPOSED), pick_enum(c("risk_action"), FINAL, "HOLD")
    bull = macd.contains("BULLISH") | ema.contains("BULLISH")
    bear = macd.contains("BEARISH") | ema.contains("BEARISH")
    verdict = (F.when(proposed == "HOLD", "MODEL_ABSTAINED").when(~proposed.isin("BUY", "SELL"), "INVALID_AUDIT_ACTION")
               .when(final == "HOLD", "RISK_BLOCKED_DIRECTION").otherwise("RISK_APPROVED_DIRECTION"))
    conflict = ((rsi == "OVERSOLD") & bear) | ((rsi == "OVERBOUGHT") & bull) | (bull & bear)
    tags = F.array(
        F.when(true("market_stale"), "MARKET_STALE"), F.when(true("news_stale"), "NEWS_STALE"),
        F.when(true("untrusted"), "UNTRUSTED_NEWS_INSTRUCTION").when(true("red_flag"), "NEGATIVE_NEWS_RISK"),
        verdict, F.when(conflict, "TECHNICAL_CONFLICT"))
    return F.slice(F.filter(tags, lambda t: t.isNotNull()), 1, 3)


def episodes(logs: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Sanitised episode fields and their signature text per audit row."""
    c = F.col
    rows = decoded(logs, snapshot)
    rows = rows.withColumn("tags", justification_tags()).withColumns({
        "proposed_action": pick_enum(c("proposed_action"), PROPOSED), "risk_action": pick_enum(c("risk_action"), FINAL, "HOLD"),
        "conviction": _bounded(c("conviction"), 0, 100, 0), "price": _bounded(c("price"), 0, 1e9, 2),
        "rsi": _bounded(c("rsi"), 0, 100, 2), "rsi_status": pick_enum(c("rsi_status"), RSI),
        "macd_status": pick_enum(c("macd_status"), MACD), "ema_status": pick_enum(c("ema_status"), EMA),
        "market_stale": F.coalesce("market_stale", F.lit(True)), "news_stale": F.coalesce("news_stale", F.lit(True)),
        "exposure_pct": _bounded(c("exposure_pct"), 0, 100, 2)})
    signature = F.to_json(F.struct("proposed_action", "conviction", "risk_action", "price", "rsi", "rsi_status", "macd_status",
                                   "ema_status", "market_stale", "news_stale", "exposure_pct", "tags"))
    return rows.withColumn("signature", signature)


def run_index(rows: DataFrame, keys: Sequence[str], id_col: str, width: int) -> DataFrame:
    """Rows in order of (ts, id) with ``pos`` (from 0), the number of their ``run`` of equal signatures, and ``prev_ts``.

    Positions and run numbers are local ranks plus sums over the table of
    chunks; the row before is looked up across chunks. No key passes one task.
    """
    order = ["ts", id_col]
    known = C.with_chunk(rows.withColumn("_hash", F.xxhash64("signature")), "ts", width)
    w = C.chunk_window(keys, order)
    near = known.withColumns({"_near": F.lag(F.struct("_hash", "ts")).over(w), "_rank": F.row_number().over(w)})
    lasts = known.groupBy(*keys, C.CHUNK).agg(F.count(F.lit(1)).alias("_n"), F.max_by(F.struct("_hash", "ts"), F.struct(*order)).alias("_last"))
    before = C.carry(lasts, keys, {"_before": ("_n", "sum"), "_open": ("_last", "last")})
    linked = near.join(before, [*keys, C.CHUNK]).withColumn("_prev", F.coalesce("_near", "_open"))
    fresh = F.col("_prev").isNull() | (F.col("_prev._hash") != F.col("_hash"))
    linked = linked.select(*rows.columns, C.CHUNK, (F.col("_before") + F.col("_rank") - 1).alias("pos"), F.col("_prev.ts").alias("prev_ts"), fresh.cast("bigint").alias("_new"))
    starts = linked.groupBy(*keys, C.CHUNK).agg(F.sum("_new").alias("_n"))
    earlier = C.carry(starts, keys, {"_earlier": ("_n", "sum")})
    inside = F.sum("_new").over(C.chunk_window(keys, ["pos"]).rowsBetween(Window.unboundedPreceding, 0))
    return (linked.withColumn("_inside", inside).join(earlier, [*keys, C.CHUNK])
            .withColumn("run", F.col("_earlier") + F.col("_inside")).drop("_earlier", "_inside", "_new", C.CHUNK))


def _joined_runs(found: Column) -> Column:
    """Neighbouring runs of equal signatures as one: only the point's own row can have stood between them."""
    def step(done, run):
        last = F.element_at(done, -1)
        both = F.struct(run["signature"].alias("signature"), (last["repeat_count"] + run["repeat_count"]).alias("repeat_count"), run["newest_ts"].alias("newest_ts"))
        same = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["signature"] == run["signature"])
        return F.when(same, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(run)))
    kind = "array<struct<signature:string,repeat_count:bigint,newest_ts:bigint>>"
    bare = F.transform(found, lambda r: F.struct(r["signature"].alias("signature"), r["repeat_count"].alias("repeat_count"), r["newest_ts"].alias("newest_ts")))
    return F.aggregate(bare, F.array().cast(kind), step)


def decision_memory(points: DataFrame, logs: DataFrame, *, keys: Sequence[str] = ("account",), id_col: str = "decision_id", window: int = WINDOW,
                    limit: int = EPISODES, width: int = 600, source_rows: int | None = None, max_repeat: int | None = None) -> DataFrame:
    """Per decision point, the last ``limit`` runs of equal episodes before it.

    Adds ``episodes``: array of (signature, repeat_count, newest_ts), oldest
    first, over all rows of the window but the point's own; ``source_rows`` and
    ``max_repeat`` bound the rows looked at and the count shown, where wanted.

    Runs of an account are numbered once. A point finds the first and last
    position of its window and reads the few last runs by number, cut at the
    window; its rows are never packed, however many there are.
    """
    names = points.columns
    # Snapshots are decoded once, before the index reads their signatures several times.
    signed = materialize(episodes(logs).select(*keys, "ts", id_col, "signature"), "episodes")
    indexed = materialize(run_index(signed, keys, id_col, width), "runs")
    runs = indexed.groupBy(*keys, "run").agg(F.min("pos").alias("_start"), F.max("pos").alias("_end"), F.max("ts").alias("_newest"), F.min("signature").alias("signature"))
    log = ranges.series(indexed, [id_col], width, keys)
    placed = log.place(points, "ts", "_b").withColumn("_since", F.col("ts") - window - 1)
    placed = log.place(placed, "_since", "_a").withColumn("_a", F.col("_a") + 1)
    # Points of one id and time are one question; rows of one id are all its own rows.
    asked = placed.groupBy(*keys, id_col, "ts").agg(F.collect_list(F.struct(*names)).alias("_points"), F.first("_a").alias("_a"), F.first("_b").alias("_b"))
    own = indexed.groupBy(*keys, id_col).agg(F.collect_list(F.struct(F.col("pos").alias("own"), "prev_ts")).alias("_owns"))
    newest = indexed.select(*keys, F.col("pos").alias("_b"), F.col("run").alias("_last"), F.col("ts").alias("_b_ts"))
    at = materialize(asked.join(own, [*keys, id_col], "left").join(newest, [*keys, "_b"], "left"), "points")
    # Without the own row a run may vanish and two may become one, so two more are read. Runs are packed by number, so many
    # to a block, next to the block before: a point reads one row, and its runs are never shuffled.
    span = limit + 2
    block = F.floor(F.col("run") / span)
    packed = (runs.withColumn("_block", F.explode(F.array(block, block + 1))).groupBy(*keys, "_block")
              .agg(F.collect_list(F.struct("run", "_start", "_end", "_newest", "signature")).alias("_packed")))
    met = at.withColumn("_block", F.floor(F.col("_last") / span)).join(packed, [*keys, "_block"], "left")
    near = F.filter("_packed", lambda r: r["run"].between(F.col("_last") - span + 1, F.col("_last")))
    mine = F.coalesce("_owns", F.array(F.lit(None).cast("struct<own:bigint,prev_ts:bigint>")))
    each = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_points")), lambda _: F.transform(mine, lambda o: _cut_runs(F.col("_near"), o, source_rows))))
    cut = C.pin(C.pin(met, "_near", near), "_runs", F.array_sort(F.flatten(each)))
    merged = C.pin(cut, "_merged", _joined_runs(F.col("_runs")))
    kept = F.slice("_merged", F.greatest(F.size("_merged") - limit, F.lit(0)) + 1, F.lit(limit))
    if max_repeat is not None:
        kept = F.transform(kept, lambda r: r.withField("repeat_count", F.least(F.lit(max_repeat).cast("bigint"), r["repeat_count"])))
    none = F.array().cast(merged.schema["_merged"].dataType)
    known = F.when(F.col(id_col).isNotNull(), kept)
    return merged.select(F.explode("_points").alias("_p"), F.coalesce(known, none).alias("episodes")).select(*[F.col(f"_p.{n}").alias(n) for n in names], "episodes")


def _cut_runs(near: Column, mine: Column, source_rows: int | None) -> Column:
    """The runs that reach into a point's window ``_a`` to ``_b``, cut there and without its own row."""
    a, b, own = F.col("_a"), F.col("_b"), mine["own"]
    if source_rows is not None:
        oldest = b - source_rows + 1
        a = F.greatest(a, oldest - F.coalesce((own >= oldest).cast("bigint"), F.lit(0)))

    def cut(r: Column) -> Column:
        start, end = F.greatest(r["_start"], a), F.least(r["_end"], b)
        held = F.coalesce(own.between(start, end), F.lit(False))
        newest = F.when(held & (own == end), mine["prev_ts"]).when(r["_end"] > b, F.col("_b_ts")).otherwise(r["_newest"])
        return F.struct(r["run"].alias("run"), r["signature"].alias("signature"), (end - start + 1 - held.cast("bigint")).alias("repeat_count"), newest.alias("newest_ts"))
    return F.filter(F.transform(near, cut), lambda r: (r["repeat_count"] > 0) & (a <= b))


def compact_runs(rows: DataFrame, keys: Sequence[str], order: str, signature: str, width: int = 100_000,
                 limit: int | None = None, max_repeat: int | None = None) -> DataFrame:
    """Runs of equal neighbours as (keys, run, signature, repeat_count, first, last).

    Works over any length of history: neighbours are compared across chunks and
    runs are numbered by a two-level running sum.
    """
    linked = C.previous_row(rows.select(*keys, order, signature), keys, order, [order, signature], width)
    fresh = F.col(f"prev_{order}").isNull() | ~F.col(signature).eqNullSafe(F.col(f"prev_{signature}"))
    marked = linked.withColumn("_new", fresh.cast("bigint"))
    numbered = C.running_sum(marked, keys, order, "_new", width, "run")
    count = F.count(F.lit(1)) if max_repeat is None else F.least(F.count(F.lit(1)), F.lit(max_repeat))
    runs = numbered.groupBy(*keys, "run", signature).agg(count.alias("repeat_count"), F.min(order).alias("first"), F.max(order).alias("last"))
    if limit is None:
        return runs
    newest = runs.groupBy(*keys).agg(F.max("run").alias("_max"))
    return runs.join(newest, list(keys)).filter(F.col("run") > F.col("_max") - limit).drop("_max")
