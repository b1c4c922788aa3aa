"""Analysis tools over a table of requests.

Tools are entries of a registry (``TOOLS``); a caller adds its own with
``TOOLS.register(name, Tool(...))`` or passes a registry of its own.

``requests``: request_id, asset, ts, tool, windows (array), lookback. Invalid
requests come back as ERROR rows, short history as INSUFFICIENT_DATA.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import asof, ranges
from tidemark.operators import chunks as C
from tidemark.registry import Registry
from tidemark.session import materialize

RETURN_BAND = 0.15
SPREAD_BAND = 0.02
MOST_WINDOWS = 4
#: Fast and slow span of the trend averages, bars back to which the slow one is compared.
FAST, SLOW, SLOPE_BARS = 9, 21, 5
TREND_WINDOWS = (5, 15, 30, 60, 240)
BAR_COLUMNS = ("high", "low", "close", "volume")


@dataclass(frozen=True)
class Tool:
    """A bounded question about the newest bars of a request.

    ``choices`` lists the allowed values of ``parameter``: ``lookback``, one of
    them, or ``windows``, up to four different ones. The tool reads that many
    bars and ``before`` more. ``facts`` gives its columns, among them ``state``.

    With ``spans`` (an array of structs of first and last bar, counted back from
    the newest one, from the parameter), ``facts`` gets the range summary of the
    newest bar and one for each span. Without, it gets the bars themselves, oldest first.
    ``state`` gives the state from the facts, where ``facts`` does not.
    """

    choices: tuple[int, ...]
    facts: Callable[[Column, Column], Mapping[str, Column]]
    spans: Callable[[Column], Column] | None = None
    parameter: str = "lookback"
    before: int = 0
    state: Callable[[Mapping[str, Column]], Column] | None = None

    def __post_init__(self):
        if not self.choices or min(self.choices) <= 0 or self.before < 0:
            raise ValueError("a tool reads a positive number of bars")
        if self.parameter not in ("lookback", "windows"):
            raise ValueError("a tool's parameter is lookback or windows")

    @property
    def longest(self) -> int:
        return max(self.choices) + self.before

    @property
    def error(self) -> str:
        return f"INVALID_{self.parameter.upper()}"

    def allows(self) -> Column:
        if self.parameter == "lookback":
            return F.coalesce(F.col("lookback").isin(*self.choices), F.lit(False))
        size = F.size("windows")
        fine = size.between(1, MOST_WINDOWS) & (F.size(F.array_distinct("windows")) == size)
        return F.coalesce(fine & F.forall("windows", lambda w: F.coalesce(w.isin(*self.choices), F.lit(False))), F.lit(False))

    def needs(self) -> Column:
        asked = F.array_max("windows") if self.parameter == "windows" else F.col("lookback")
        return asked + F.lit(self.before)


def _unrounded_zero(value: Column) -> Column:
    # Null, NaN and infinite values are not below infinity.
    return F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(F.lit(0.0))


def _per_tool(tools: Mapping[str, Tool], value: Callable[[Tool], Column]) -> Column:
    """``value`` of the tool a row names; null where it names none."""
    pairs = [((F.col("tool") == name), value(tool)) for name, tool in tools.items()]
    return F.coalesce(*[F.when(test, v) for test, v in pairs]) if pairs else F.lit(None)


def request_error(tools: Mapping[str, Tool] | None = None) -> Column:
    """Code of the rule a request breaks, null when it is fine."""
    known = TOOLS if tools is None else tools
    broken = _per_tool(known, lambda t: F.when(~t.allows(), t.error))
    return F.when(F.coalesce(F.col("tool").isin(*known), F.lit(False)), broken).otherwise("UNKNOWN_TOOL")


def plan_errors(requests: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Plans with more than three requests or the same tool twice."""
    per_plan = requests.groupBy(plan).agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("tool").alias("tools"))
    return per_plan.filter((F.col("requests") > 3) | (F.col("tools") < F.col("requests")))


def _average_spans() -> tuple[int, ...]:
    return tuple(sorted({min(span, w) for w in TREND_WINDOWS for span in (FAST, SLOW)}))


def _lift(bar: Column) -> Column:
    """Marks compare as structs: the highest close (then the earliest), the lowest close, the deepest fall (then the earliest)."""
    zero, mark = F.lit(0.0), F.struct(bar["ts"].alias("ts"), bar["close"].alias("close"))
    return F.struct(
        F.lit(1).cast("bigint").alias("n"), bar["close"].alias("first"), bar["close"].alias("last"), bar["volume"].alias("first_volume"),
        bar["high"].alias("high"), bar["low"].alias("low"), bar["volume"].alias("mean"), zero.alias("m2"), zero.alias("flow"), zero.alias("down"),
        F.struct(bar["close"].alias("close"), (-bar["ts"]).alias("ago")).alias("top"), F.struct(bar["close"].alias("close"), bar["ts"].alias("ts")).alias("bottom"),
        F.struct(zero.alias("fall"), mark.alias("trough"), mark.alias("peak")).alias("worst"),
        *[(bar["close"] * (2.0 / (span + 1))).alias(f"ema{span}") for span in _average_spans()])


def _merge(a: Column, b: Column) -> Column:
    """Summary of two neighbouring stretches of bars, the earlier one first."""
    n = a["n"] + b["n"]
    gap = b["mean"] - a["mean"]
    move = F.coalesce(F.signum(b["first"] - a["last"]) * b["first_volume"], F.lit(0.0))
    loss = F.least(b["first"] / a["last"] - 1, F.lit(0.0))
    # The deepest fall lies in one part, or leads from the top of the first to the bottom of the second.
    across = F.struct(((b["bottom"]["close"] / a["top"]["close"] - 1) * 100).alias("fall"),
                      F.struct(b["bottom"]["ts"].alias("ts"), b["bottom"]["close"].alias("close")).alias("trough"),
                      F.struct((-a["top"]["ago"]).alias("ts"), a["top"]["close"].alias("close")).alias("peak"))
    return F.struct(
        n.alias("n"), a["first"].alias("first"), b["last"].alias("last"), a["first_volume"].alias("first_volume"),
        F.greatest(a["high"], b["high"]).alias("high"), F.least(a["low"], b["low"]).alias("low"),
        (a["mean"] + gap * (b["n"] / n)).alias("mean"), (a["m2"] + b["m2"] + gap * gap * (a["n"] * b["n"] / n)).alias("m2"),
        (a["flow"] + move + b["flow"]).alias("flow"), (a["down"] + loss * loss + b["down"]).alias("down"),
        F.greatest(a["top"], b["top"]).alias("top"), F.least(a["bottom"], b["bottom"]).alias("bottom"), F.least(a["worst"], across, b["worst"]).alias("worst"),
        *[(a[f"ema{s}"] * F.pow(F.lit(1 - 2.0 / (s + 1)), b["n"]) + b[f"ema{s}"]).alias(f"ema{s}") for s in _average_spans()])


#: What a stretch of bars is known by: extremes, mean and spread of volume, signed flow, falls, and averages as linear maps.
BAR_SUMMARY = ranges.Summary(_lift, _merge)


def _back(first: Column, last: Column) -> Column:
    return F.struct(first.cast("bigint").alias("first"), last.cast("bigint").alias("last"))


def _ema(s: Column, span: Column) -> Column:
    """Average over a stretch that starts from its first close."""
    pick = lambda value: F.coalesce(*[F.when(span == k, value(k)) for k in _average_spans()])
    return pick(lambda k: s["first"] * F.pow(F.lit(1 - 2.0 / (k + 1)), s["n"]) + s[f"ema{k}"])


def trend_spans(windows: Column) -> Column:
    """Each window, and each window without its newest bars."""
    less = lambda w: F.least(F.lit(SLOPE_BARS), w - 1)
    return F.flatten(F.transform(windows, lambda w: F.array(_back(w - 1, F.lit(0)), _back(w - 1, less(w)))))


def trend(found: Column, windows: Column) -> dict[str, Column]:
    """Per window return, EMA spread, slow-EMA slope and direction."""
    # Three steps over the windows, so that no expression is written out several times.
    def averages(w, i):
        whole, before = F.get(found, 2 * i + 1), F.get(found, 2 * i + 2)
        slow_span = F.least(F.lit(SLOW), w)
        return F.struct(w.alias("window"), F.least(F.lit(SLOPE_BARS), w - 1).alias("bars"), whole["first"].alias("first"), whole["last"].alias("last"),
                        _ema(whole, F.least(F.lit(FAST), w)).alias("fast"), _ema(whole, slow_span).alias("slow"), _ema(before, slow_span).alias("before"))

    def rates(x):
        slope = F.when(x["bars"] > 0, _unrounded_zero(F.try_divide((x["slow"] - x["before"]) * 100, x["last"]) / x["bars"])).otherwise(0.0)
        return F.struct(x["window"].alias("window"), _unrounded_zero((F.try_divide(x["last"], x["first"]) - 1) * 100).alias("return_pct"),
                        _unrounded_zero((F.try_divide(x["fast"], x["slow"]) - 1) * 100).alias("ema_spread_pct"), slope.alias("slope_pct_per_bar"))

    def directed(x):
        way = (F.when((x["return_pct"] >= RETURN_BAND) & (x["ema_spread_pct"] >= SPREAD_BAND), "BULLISH")
               .when((x["return_pct"] <= -RETURN_BAND) & (x["ema_spread_pct"] <= -SPREAD_BAND), "BEARISH").otherwise("MIXED"))
        return F.struct(*[x[n].alias(n) for n in ("window", "return_pct", "ema_spread_pct", "slope_pct_per_bar")], way.alias("trend"))
    details = F.transform(F.transform(F.transform(windows, averages), rates), directed)
    return {"windows_detail": details}


def alignment(details: Column) -> Column:
    votes = lambda way: F.size(F.filter(details, lambda d: d["trend"] == way))
    half = F.size(details) / 2
    return F.when(votes("BULLISH") > half, "BULLISH").when(votes("BEARISH") > half, "BEARISH").otherwise("MIXED")


def prior_span(n: Column) -> Column:
    return F.array(_back(n, F.lit(1)))


def donchian(found: Column, n: Column) -> dict[str, Column]:
    prior, close = F.get(found, F.lit(1)), F.get(found, F.lit(0))["last"]
    upper, lower = prior["high"], prior["low"]
    return {
        "prior_upper": upper, "prior_lower": lower,
        "channel_position": F.when(upper > lower, F.try_divide(close - lower, upper - lower)).otherwise(0.5),
        "distance_to_upper_pct": _unrounded_zero((F.try_divide(upper, close) - 1) * 100),
        "distance_to_lower_pct": _unrounded_zero((F.try_divide(close, lower) - 1) * 100),
        "state": F.when(close > upper, "BREAKOUT_UP").when(close < lower, "BREAKOUT_DOWN").otherwise("INSIDE"),
    }


def sample_span(n: Column) -> Column:
    return F.array(_back(n - 1, F.lit(0)))


def drawdown(found: Column, n: Column) -> dict[str, Column]:
    s = F.get(found, F.lit(1))
    worst = s["worst"]["fall"]
    return {
        "current_drawdown_pct": (s["last"] / s["top"]["close"] - 1) * 100, "max_drawdown_pct": worst,
        "downside_semideviation_pct": F.sqrt(s["down"] / F.greatest(n - 1, F.lit(1))) * 100,
        "peak_ts": s["worst"]["peak"]["ts"], "trough_ts": s["worst"]["trough"]["ts"],
        "peak_price": s["worst"]["peak"]["close"], "trough_price": s["worst"]["trough"]["close"],
        "state": F.when(worst <= -7, "SEVERE").when(worst <= -3, "ELEVATED").when(worst <= -1, "WATCH").otherwise("NORMAL"),
    }


def volume(found: Column, n: Column) -> dict[str, Column]:
    prior, now = F.get(found, F.lit(1)), F.get(found, F.lit(0))["first_volume"]
    mean, spread = prior["mean"], F.sqrt(prior["m2"] / n)
    # A flat window has no spread beyond rounding.
    z = F.when(spread > 1e-9 * F.greatest(F.abs(mean), F.lit(1e-9)), F.try_divide(now - mean, spread)).otherwise(0.0)
    return {
        "current_volume": now, "mean_volume": mean, "volume_z_score": z,
        "obv_slope_per_bar": prior["flow"] / F.greatest(n - 1, F.lit(1)),
        "state": F.when(z >= 2, "HIGH_VOLUME").when(z <= -1, "LOW_VOLUME").otherwise("NEUTRAL"),
    }


#: The tools every plan may ask for. Choices are fixed values.
TOOLS = Registry(
    multi_timeframe_trend=Tool(TREND_WINDOWS, trend, trend_spans, parameter="windows", state=lambda facts: alignment(facts["windows_detail"])),
    donchian_breakout=Tool((20, 55), donchian, prior_span, before=1),
    drawdown_profile=Tool((60, 240, 1440), drawdown, sample_span),
    volume_confirmation=Tool((20, 60, 240), volume, prior_span, before=1),
)


def run_tools(requests: DataFrame, bars: DataFrame, width: int, tools: Mapping[str, Tool] | None = None) -> DataFrame:
    """One result row per request: status, error code, state and facts per tool (``TOOLS`` by default).

    Bars are read once and written as a series. Equal questions about the same
    newest bar are answered once and joined back.
    """
    known = TOOLS if tools is None else tools
    marked = requests.withColumn("error_code", request_error(known))
    good = marked.filter(F.col("error_code").isNull())
    # Only a tool's own parameter is part of its question.
    by_windows = F.col("tool").isin(*[n for n, t in known.items() if t.parameter == "windows"])
    bar_series = ranges.series(bars, BAR_COLUMNS, width)
    placed = materialize(bar_series.place(good).withColumns({
        "_windows": F.when(by_windows, F.array_join(F.col("windows").cast("array<string>"), ",")).otherwise(""),
        "_lookback": F.when(by_windows, F.lit(0)).otherwise(F.col("lookback"))}), "placed")
    ask = ["asset", "pos", "tool", "_windows", "_lookback"]
    distinct = placed.groupBy(*ask).agg(F.first("windows").alias("windows")).select("*", F.col("_lookback").alias("lookback"))
    distinct = distinct.withColumn("windows", F.when(F.col("_windows") != "", F.col("windows")))
    facts = answers(distinct, bar_series, known).drop("windows", "lookback")
    done = placed.join(facts, ask, "left").drop("_windows", "_lookback", "pos")
    done = done.withColumn("status", F.coalesce("status", F.lit("INSUFFICIENT_DATA")))
    failed = marked.filter(F.col("error_code").isNotNull()).withColumn("status", F.lit("ERROR"))
    return done.unionByName(failed, allowMissingColumns=True)


def answers(questions: DataFrame, bars: ranges.Series, tools: Mapping[str, Tool] | None = None) -> DataFrame:
    """Facts per distinct question (asset, pos, tool, windows, lookback) that enough bars lie before."""
    known = TOOLS if tools is None else tools
    ready = questions.withColumn("_need", _per_tool(known, Tool.needs)).filter(F.col("pos") + 1 >= F.col("_need")).drop("_need")
    merged = {name: tool for name, tool in known.items() if tool.spans is not None}
    packed = {name: tool for name, tool in known.items() if tool.spans is None}
    out = None
    if merged:
        table = ranges.blocks(bars, BAR_SUMMARY)
        spans = F.concat(F.array(_back(F.lit(0), F.lit(0))), _per_tool(merged, lambda t: t.spans(F.col(t.parameter))))
        places = F.transform(spans, lambda s: F.struct((F.col("pos") - s["first"]).alias("first"), (F.col("pos") - s["last"]).alias("last")))
        asked = ready.filter(F.col("tool").isin(*merged))
        out = _with_facts(ranges.ask(asked, places, table, BAR_SUMMARY, out="_source"), merged)
    if packed:
        rows = bars.rows().select(*bars.keys, F.col("pos").alias("ts"), F.struct("row.*").alias("row"))
        tails = asof.trailing_context(ready.filter(F.col("tool").isin(*packed)), rows, max(t.longest for t in packed.values()), ["row"], bars.width, bars.keys, at="pos", out="_tail")
        needed = _per_tool(packed, Tool.needs).cast("int")
        tails = C.pin(tails, "_source", F.transform(asof.last_items(F.col("_tail"), needed), lambda r: r["row"])).drop("_tail")
        own = _with_facts(tails, packed)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.withColumn("status", F.lit("OK"))


def _with_facts(found: DataFrame, tools: Mapping[str, Tool]) -> DataFrame:
    """Facts of each row's tool; a fact is computed once, then its state is read from it."""
    columns: dict[str, list[Column]] = {}
    for name, tool in tools.items():
        for fact, value in tool.facts(F.col("_source"), F.col(tool.parameter)).items():
            columns.setdefault(fact, []).append(F.when(F.col("tool") == name, value))
    done = C.pin(found, "_facts", F.struct(*[F.coalesce(*values).alias(fact) for fact, values in columns.items()]))
    said = [F.when(F.col("tool") == name, tool.state({f: F.col(f"_facts.{f}") for f in columns})) for name, tool in tools.items() if tool.state]
    if said:
        known = [F.col("_facts.state")] if "state" in columns else []
        done = done.withColumn("_facts", F.col("_facts").withField("state", F.coalesce(*said, *known)))
    return done.select("*", "_facts.*").drop("_source", "_facts")


def drawdown_events(results: DataFrame) -> DataFrame:
    """Elevated drawdowns as events with a dedupe key, one row per key."""
    hits = results.filter((F.col("tool") == "drawdown_profile") & F.col("state").isin("ELEVATED", "SEVERE"))
    keyed = hits.select(
        text.drawdown_key(F.col("asset"), F.col("peak_ts"), F.col("trough_ts"), F.col("state")).alias("dedupe_key"),
        "asset", F.lit("DRAWDOWN").alias("event_type"), F.col("trough_ts").alias("event_ts"), F.col("state").alias("severity"),
        "peak_ts", F.col("ts").alias("detected_ts"))
    return keyed.groupBy("dedupe_key", "asset", "event_type", "event_ts", "severity", "peak_ts").agg(
        F.min("detected_ts").alias("detected_ts"))
