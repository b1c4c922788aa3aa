"""Snapshots for many decision points: technical state, news risk, health, exposure.

The 50 bars and the newest headlines before each decision come as bounded
arrays, by position in their series; everything else is column arithmetic on
those arrays. Headlines are scanned once each, before they meet decisions. What
they say is folded once for each run of headlines some decision sees, so no
decision carries texts that are not asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import asof, ranges
from tidemark.operators import chunks as C
from tidemark.session import materialize

BARS = 50
LEAST_BARS = 30
NEWS_LIMIT = 5
NEWS_WINDOW = 86400
NEWS_TOLERANCE = 300
FUTURE_TOLERANCE = 30
MARKET_STALE = 1200
NEWS_STALE = 21600
#: Characters of a headline in a compact snapshot.
SHOWN = 240


def scanned_news(news: DataFrame, lexicon: Sequence[str] = text.NEGATIVE_TERMS) -> DataFrame:
    """Headlines with matched terms, instruction flag and redacted text."""
    folded = C.pin(news, "_folded", text.fold_text(F.col("headline")))
    rows = C.pin(folded, "flagged", text.looks_like_instruction(F.col("_folded")))
    shown = F.when(F.col("flagged"), F.lit(text.REDACTED)).otherwise(F.col("headline"))
    return rows.select("news_id", "ts", "source", shown.alias("headline"),
                       text.negative_terms(F.col("_folded"), lexicon).alias("terms"), "flagged")


def recent_news(decisions: DataFrame, news: DataFrame, limit: int = NEWS_LIMIT, window: int = NEWS_WINDOW,
                tolerance: int = NEWS_TOLERANCE, width: int = 3600, out: str = "news") -> DataFrame:
    """The newest headlines of the last day per decision, oldest first."""
    cols = [c for c in news.columns if c not in ("ts", "news_id")]
    seen = decisions.withColumn("_at", F.col("ts") + F.lit(tolerance))
    found = asof.trailing_context(seen, news, limit, cols, width, keys=(), at="_at", order=("news_id",), out=out)
    fresh = F.filter(out, lambda n: n["ts"] >= F.col("ts") - F.lit(window))
    return found.withColumn(out, fresh).drop("_at")


def news_risk(items: Column) -> dict[str, Column]:
    """Risk columns of a headline array with ``terms`` and ``flagged``."""
    hits = F.size(F.filter(items, lambda n: F.size(n["terms"]) > 0))
    untrusted = F.exists(items, lambda n: n["flagged"])
    return {
        "red_flag": hits > 0, "untrusted": untrusted,
        "risk_level": F.when(untrusted | (hits >= 2), "HIGH").when(hits == 1, "ELEVATED").otherwise("NORMAL"),
        "matched_terms": F.array_sort(F.array_distinct(F.flatten(F.transform(items, lambda n: n["terms"])))),
        "headlines": F.transform(F.reverse(items), lambda n: n["headline"]),
        "news_count": F.size(items),
    }


def _news_facts(items: Column) -> dict[str, Column]:
    return news_risk(items) | {"latest_news": F.array_max(F.transform(items, lambda n: n["ts"]))}


def headline_series(news: DataFrame, limit: int = NEWS_LIMIT, width: int = 3600) -> ranges.Series:
    """Scanned headlines, capped per instant and written as a series, which gives positions and tails."""
    kept = asof.cap_per_instant(news.filter("ts IS NOT NULL"), (), "ts", ("news_id",), limit)
    return ranges.series(kept, ["news_id", *[c for c in news.columns if c not in ("ts", "news_id")]], width, keys=())


def place_heads(decisions: DataFrame, heads: ranges.Series, tolerance: int = NEWS_TOLERANCE) -> DataFrame:
    """Decisions with ``_head``, the position of the newest headline they see; written."""
    placed = heads.place(decisions.withColumn("_at", F.col("ts") + F.lit(tolerance)), "_at", "_head").drop("_at")
    return materialize(placed, "heads")


def head_states(placed: DataFrame, heads: ranges.Series, limit: int = NEWS_LIMIT, shown: int | None = None) -> DataFrame:
    """Times and risk columns of the last headlines up to each ``_head`` of ``placed``.

    Risks are arrays by the number of headlines that count. Texts are held once,
    newest first, since fewer headlines are the first of them; only the first
    ``shown`` characters of each where that is all a caller shows.
    """
    tail = heads.tail(placed.select(F.col("_head").alias("pos")).filter("pos >= 0").distinct(), limit, "_items")
    size = F.size("_items")
    newest = lambda k: F.slice("_items", size - k + 1, k)
    by_number = lambda name: F.transform(F.sequence(F.lit(0), size), lambda k: _news_facts(newest(k))[name]).alias(f"_{name}")
    texts = _news_facts(F.col("_items"))["headlines"]
    if shown is not None:
        texts = F.transform(texts, lambda h: F.substring(h, 1, shown))
    return tail.select(F.col("pos").alias("_head"), F.col("_items.ts").alias("_times"), texts.alias("_headlines"),
                       *[by_number(name) for name in _news_facts(F.col("_items")) if name != "headlines"])


def with_head_states(placed: DataFrame, heads: ranges.Series, states: DataFrame, window: int = NEWS_WINDOW) -> DataFrame:
    """Rows with the risk columns of their fresh headlines for ``_head``. Nothing is shuffled by it afterwards if it is joined last."""
    fresh = F.size(F.filter("_times", lambda t: t >= F.col("ts") - F.lit(window)))
    rows = C.pin(placed.join(states, "_head", "left"), "_fresh", F.when(F.col("_head") >= 0, fresh))
    seen = lambda name: F.slice("_headlines", F.lit(1), F.col("_fresh")) if name == "headlines" else F.get(f"_{name}", F.col("_fresh"))
    none = F.array().cast(heads.packed.schema["_rows"].dataType)
    out = {name: F.when(F.col("_fresh").isNull(), empty).otherwise(seen(name)) for name, empty in _news_facts(none).items()}
    return rows.select(*[c for c in placed.columns if c != "_head"], *[v.alias(name) for name, v in out.items()])


def news_states(decisions: DataFrame, news: DataFrame, limit: int = NEWS_LIMIT, window: int = NEWS_WINDOW,
                tolerance: int = NEWS_TOLERANCE, width: int = 3600) -> DataFrame:
    """Decisions with the risk columns of their newest headlines of the last day, and ``latest_news``.

    ``news`` is scanned. The newest headline a decision sees and how many of the
    last ones are still fresh decide its risk. Risks are folded once for each
    such headline and number, as arrays by number; a decision joins the arrays
    it reads and takes one entry of them.
    """
    heads = headline_series(news, limit, width)
    placed = place_heads(decisions, heads, tolerance)
    return with_head_states(placed, heads, head_states(placed, heads, limit), window)


def data_health(latest_bar: Column, latest_news: Column, now: Column, market_stale: int = MARKET_STALE,
                news_stale: int = NEWS_STALE, tolerance: int = FUTURE_TOLERANCE) -> dict[str, Column]:
    """Ages clamped at zero and stale flags; no data counts as stale."""
    age = F.greatest(now - latest_bar, F.lit(0))
    age = F.when(latest_bar.isNotNull(), age)
    ahead = F.coalesce(now - latest_bar < -tolerance, F.lit(False))
    news_age = F.when(latest_news.isNotNull(), F.greatest(now - latest_news, F.lit(0)))
    return {
        "kline_age": age, "market_future": ahead,
        "market_stale": age.isNull() | ahead | (age > market_stale),
        "latest_news_ts": latest_news, "news_age": news_age, "news_stale": news_age.isNull() | (news_age > news_stale),
    }


def _mean(values: Column, n: Column | int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n


_last = asof.last_items


def technical(tail: DataFrame, bars: str = "tail") -> DataFrame:
    """Live indicator values and states of the last bar of each tail."""
    field = lambda n: F.transform(bars, lambda b: b[n])
    rows = tail.withColumns({f"_{n}": field(n) for n in ("close", "high", "low", "volume")})
    n = F.size(bars)
    prior = F.concat(F.array(F.lit(None).cast("double")), F.slice("_close", 1, F.greatest(n - 1, F.lit(0))))
    rows = rows.withColumn("_prior", prior)
    rows = rows.withColumn("_delta", F.zip_with("_close", "_prior", lambda c, p: F.coalesce(c - p, F.lit(0.0))))
    spread = F.zip_with(F.arrays_zip("_high", "_low"), F.col("_prior"), lambda b, p: F.greatest(
        b["_high"] - b["_low"], F.abs(b["_high"] - p), F.abs(b["_low"] - p)))
    rows = rows.withColumn("_tr", spread)
    # One fold carries every recursive average of the tail.
    step = lambda old, x, span: old + (x - old) * (2.0 / (span + 1.0))
    names = ("e9", "e21", "e12", "e26", "sig", "hist", "h0", "p9", "p21")
    first = F.get("_close", F.lit(0))
    seed = F.struct(*[(first if i < 4 else F.lit(0.0)).alias(k) for i, k in enumerate(names[:7])],
                    first.alias("p9"), first.alias("p21"))

    def fold(s, x):
        e12, e26 = step(s["e12"], x, 12), step(s["e26"], x, 26)
        sig = step(s["sig"], e12 - e26, 9)
        values = (step(s["e9"], x, 9), step(s["e21"], x, 21), e12, e26, sig, e12 - e26 - sig, s["hist"], s["e9"], s["e21"])
        return F.struct(*[v.alias(k) for k, v in zip(names, values)])

    rows = C.pin(rows, "_m", F.aggregate(F.slice("_close", 2, F.greatest(n, F.lit(1))), seed, fold))
    last14 = _last(F.col("_delta"), 14)
    k = F.size(last14)
    gain = _mean(F.transform(last14, lambda d: F.greatest(d, F.lit(0.0))), k)
    loss = _mean(F.transform(last14, lambda d: F.greatest(-d, F.lit(0.0))), k)
    price = F.try_element_at("_close", F.lit(-1))
    atr = _mean(_last(F.col("_tr"), 14), F.size(_last(F.col("_tr"), 14)))
    band = _last(F.col("_close"), 20)
    middle = _mean(band, 20)
    var = F.aggregate(band, F.lit(0.0), lambda a, x: a + F.pow(x - F.col("bb_middle"), 2)) / 19.0
    low, high = F.array_min("_low"), F.array_max("_high")
    rows = rows.withColumns({
        "n_bars": n, "price": price, "latest_bar_ts": F.try_element_at(bars, F.lit(-1))["ts"],
        "rsi": F.when((loss == 0) & (gain == 0), F.lit(50.0)).when(loss == 0, 100.0)
        .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide(gain, loss))),
        "_flat": (loss == 0) & (gain == 0),
        "macd": F.col("_m.hist"), "atr": atr, "bb_middle": middle, "volume": F.try_element_at("_volume", F.lit(-1)),
        "mean_volume": _mean(_last(F.col("_volume"), 20), 20), "_lo": low, "_w": (high - low) / 10.0,
        "ema9": F.col("_m.e9"), "ema21": F.col("_m.e21"),
    })
    rows = rows.withColumn("_sd", F.sqrt(var))
    c = F.col
    bin_of = lambda x: F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.try_divide(x - c("_lo"), c("_w"))))).cast("int")
    rows = C.pin(rows, "_slots", F.transform(bars, lambda b: F.struct(bin_of(b["close"]).alias("i"), b["volume"].alias("v"))))
    weights = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.aggregate(
        "_slots", F.lit(0.0), lambda a, b: a + F.when(b["i"] == i, b["v"]).otherwise(0.0)))
    rows = C.pin(rows, "_bins", F.when(c("_w") > 0, weights))
    peak = F.array_position("_bins", F.array_max("_bins")) - 1
    rows = rows.withColumns({
        "rsi_status": F.when(c("_flat"), "NEUTRAL").when(c("rsi") >= 70, "OVERBOUGHT").when(c("rsi") <= 30, "OVERSOLD").otherwise("NEUTRAL"),
        "macd_status": F.when((c("macd") > 0) & (c("macd") > c("_m.h0")), "BULLISH_EXPANDING")
        .when((c("macd") < 0) & (c("macd") < c("_m.h0")), "BEARISH_EXPANDING").otherwise("NEUTRAL"),
        "bb_upper": c("bb_middle") + 2 * c("_sd"), "bb_lower": c("bb_middle") - 2 * c("_sd"),
        "bb_status": F.when(c("price") > c("bb_middle") + 2 * c("_sd"), "ABOVE_UPPER")
        .when(c("price") < c("bb_middle") - 2 * c("_sd"), "BELOW_LOWER").otherwise("INSIDE"),
        "ema_status": F.when((c("_m.p9") <= c("_m.p21")) & (c("ema9") > c("ema21")), "BULLISH_CROSS")
        .when((c("_m.p9") >= c("_m.p21")) & (c("ema9") < c("ema21")), "BEARISH_CROSS")
        .when(c("ema9") > c("ema21"), "BULLISH").when(c("ema9") < c("ema21"), "BEARISH").otherwise("NEUTRAL"),
        "volume_spike": (c("mean_volume") > 0) & (c("volume") > 2 * c("mean_volume")),
        "poc_price": F.when(c("_w") > 0, c("_lo") + (peak + 0.5) * c("_w")).otherwise(c("price")),
        "atr_status": F.when((c("price") > 0) & (c("atr") / c("price") > 0.05), "EXTREME").otherwise("NORMAL"),
    })
    return rows.drop(*[x for x in rows.columns if x.startswith("_")], bars)


def bar_states(placed: DataFrame, known: ranges.Series) -> DataFrame:
    """Technical columns of the bars that some row of ``placed`` falls on, by asset and ``pos``."""
    anchors = placed.select("asset", "pos").filter("pos >= 0").distinct()
    tail = known.tail(anchors, BARS).withColumn("ts", F.element_at("tail", -1)["ts"])
    return technical(tail).drop("latest_bar_ts").withColumnRenamed("ts", "latest_bar_ts")


def with_bar_states(placed: DataFrame, states: DataFrame) -> DataFrame:
    out = placed.join(states, ["asset", "pos"], "left").drop("pos")
    return out.withColumn("n_bars", F.coalesce("n_bars", F.lit(0)))


def technical_states(decisions: DataFrame, bars: DataFrame, width: int) -> DataFrame:
    """Decisions with the technical columns of their newest bar.

    The state belongs to the bar, so it is computed once per bar that some
    decision falls on, however many decisions share it. Bars are read once and
    written as a series, which gives positions and tails.
    """
    known = ranges.series(bars, ["open", "high", "low", "close", "volume"], width)
    placed = materialize(known.place(decisions), "placed")
    return with_bar_states(placed, bar_states(placed, known))


def build_snapshots(decisions: DataFrame, bars: DataFrame, news: DataFrame, *, width: int, initial_equity: float = 10000.0,
                    lexicon: Sequence[str] = text.NEGATIVE_TERMS, market_stale: int = MARKET_STALE,
                    news_stale: int = NEWS_STALE, news_width: int = 3600, shown: int | None = None) -> DataFrame:
    """Snapshot columns per decision; ``status`` is ERROR below 30 bars.

    ``decisions`` needs asset, ts and the balances ``cash`` and ``holding``.
    ``headlines`` are whole texts; all of a text is scanned, also where a caller
    shows the first ``shown`` characters only.
    """
    # Decisions find their place in both series before they meet any state. Texts are met last, so that no decision takes them
    # through a shuffle.
    known = ranges.series(bars, ["open", "high", "low", "close", "volume"], width)
    heads = headline_series(scanned_news(news, lexicon), width=news_width)
    placed = place_heads(materialize(known.place(decisions), "placed"), heads)
    rows = with_bar_states(placed, bar_states(placed, known))
    rows = with_head_states(rows, heads, head_states(placed, heads, shown=shown))
    health = data_health(F.col("latest_bar_ts"), F.col("latest_news"), F.col("ts"), market_stale, news_stale)
    rows = rows.withColumns(health).drop("latest_news")
    held = F.col("holding") * F.col("price")
    equity = F.col("cash") + held
    return (rows.withColumn("equity", equity)
            .withColumn("exposure_pct", F.when(equity > 0, held / equity * 100).otherwise(F.lit(0.0)))
            .withColumn("in_drawdown", equity < initial_equity)
            .withColumn("max_risk_pct", F.lit(5.0))
            .withColumn("status", F.when(F.col("n_bars") < LEAST_BARS, "ERROR").otherwise("OK")))


def compact_json(rows: DataFrame, out: str = "snapshot") -> DataFrame:
    """Compact audit snapshot of a decision as JSON text."""
    c = F.col
    news = F.transform(F.slice("headlines", 1, 5), lambda h: F.struct(F.substring(h, 1, SHOWN).alias("headline")))
    body = F.struct(
        F.lit(1).alias("schema_version"),
        F.struct(c("price").alias("current_price"), c("rsi").alias("rsi_value"), "rsi_status", c("macd").alias("macd_histogram"),
                 "macd_status", "ema_status", c("atr").alias("volatility_atr")).alias("technical"),
        F.struct(c("kline_age").alias("kline_age_seconds"), c("news_age").alias("news_age_seconds"),
                 c("market_stale").alias("is_market_data_stale"), c("news_stale").alias("is_news_stale")).alias("data_health"),
        F.struct(c("red_flag").alias("has_negative_red_flag"), "risk_level", "matched_terms").alias("news_risk"),
        F.struct(c("exposure_pct").alias("current_exposure_percentage"), c("in_drawdown").alias("is_in_drawdown"),
                 c("max_risk_pct").alias("max_allowed_risk_per_trade")).alias("portfolio"),
        news.alias("recent_news"))
    return rows.withColumn(out, F.to_json(body))


def technical_context(tail: DataFrame, bars: str = "tail", n: int = 32) -> DataFrame:
    """Eight-hour context of 32 bars: returns, slope, volatility, volume, drawdown, range.

    Bars carry close, high, low, volume and observations.
    """
    rows = tail.withColumn("_t", _last(F.col(bars), n))
    field = lambda name: F.transform("_t", lambda b: b[name])
    rows = rows.withColumns({"_c": field("close"), "_v": field("volume")})
    last, first = F.try_element_at("_c", F.lit(-1)), F.get("_c", F.lit(0))
    back = lambda k: (last / F.try_element_at("_c", F.lit(-1 - k)) - 1) * 100
    rets = F.zip_with(F.slice("_c", 2, n), F.slice("_c", 1, n - 1), lambda b, a: b / a - 1)
    rows = rows.withColumn("_r", rets)
    m = float(n - 1)
    mean = F.aggregate("_r", F.lit(0.0), lambda a, x: a + x) / m
    rows = rows.withColumn("_mean", mean)
    std = F.sqrt(F.aggregate("_r", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("_mean"), 2)) / m)
    middle = (n - 1) / 2.0
    sxx = sum((i - middle) ** 2 for i in range(n))
    sxy = F.aggregate(F.transform("_c", lambda x, i: (i - middle) * x), F.lit(0.0), lambda a, x: a + x)
    mean_v = F.aggregate(_last(F.col("_v"), 16), F.lit(0.0), lambda a, x: a + x) / 16.0
    start = F.struct(first.alias("top"), F.lit(0.0).alias("worst"), F.lit(0.0).alias("now"))

    def draw(s, x):
        top = F.greatest(s["top"], x)
        now = (x / top - 1) * 100
        return F.struct(top.alias("top"), F.least(s["worst"], now).alias("worst"), now.alias("now"))

    rows = C.pin(rows, "_d", F.aggregate("_c", start, draw)).withColumn("_mv", mean_v)
    ok = F.size("_t") >= n
    out = {
        "return_4_pct": back(4), "return_16_pct": back(16), f"return_{n - 1}_pct": (last / first - 1) * 100,
        "slope_pct_per_hour": sxy / sxx * 4 / last * 100, "realized_volatility_pct": std * (m ** 0.5) * 100,
        "volume_ratio": F.coalesce(F.try_divide(F.try_element_at("_v", F.lit(-1)), F.nullif("_mv", F.lit(0.0))), F.lit(0.0)),
        "maximum_drawdown_pct": F.col("_d.worst"), "current_drawdown_pct": F.col("_d.now"),
        "range_pct": (F.array_max(field("high")) / F.array_min(field("low")) - 1) * 100,
        "observations": F.aggregate(field("observations"), F.lit(0).cast("bigint"), lambda a, x: a + x),
    }
    rows = rows.withColumn("status", F.when(ok, "OK").otherwise("INSUFFICIENT_DATA"))
    rows = rows.withColumns({k: F.when(ok, v) for k, v in out.items()})
    return rows.drop("_t", "_c", "_v", "_r", "_mean", "_d", "_mv", bars)
