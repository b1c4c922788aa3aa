"""Deterministic decision gate as one ordered CASE chain.

Inputs are columns of a decisions table; portfolio terms (daily drawdown,
exposure) and the cooldown flag are inputs, since they depend on what was
executed before. Reason texts are fixed values of the audit format.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BULLISH = ("BULLISH_EXPANDING", "BULLISH_DIVERGENCE")
BEARISH = ("BEARISH_EXPANDING", "BEARISH_DIVERGENCE")


@dataclass(frozen=True)
class GateConfig:
    max_daily_drawdown: float = 10.0
    max_exposure: float = 100.0
    cooldown_minutes: int = 15
    win_rate: float = 0.55
    risk_reward: float = 1.5
    kelly_share: float = 0.5

    def __post_init__(self):
        if not self.max_daily_drawdown > 0:
            raise ValueError("max_daily_drawdown must be positive")
        if not 0 < self.max_exposure <= 100:
            raise ValueError("max_exposure must be in (0, 100]")
        if self.cooldown_minutes < 0:
            raise ValueError("cooldown_minutes must not be negative")

    @property
    def kelly_pct(self) -> float:
        if not 0 < self.win_rate < 1 or self.risk_reward <= 0 or not 0 < self.kelly_share <= 1:
            return 0.0
        edge = self.win_rate - (1 - self.win_rate) / self.risk_reward
        return max(0.0, edge) * self.kelly_share * 100.0


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def reliability(action: Column) -> Column:
    """Product of penalties for missing, stale, negative or violent inputs."""
    c = F.col
    confirms = ((action == "SELL") & ~c("market_stale") & ~c("news_stale") & ~c("untrusted")
                & ~c("rsi_status").eqNullSafe("OVERSOLD") & c("macd_status").isin(*BEARISH))
    penalties = [
        (c("news_count") == 0, 0.7), (c("market_stale"), 0.3), (c("news_stale"), 0.6),
        (c("red_flag") & ~F.coalesce(confirms, F.lit(False)), 0.7),
        (c("atr") / c("price") > F.lit(0.05), 0.5),
    ]
    out = F.lit(1.0)
    for condition, factor in penalties:
        out = out * F.when(condition, F.lit(factor)).otherwise(F.lit(1.0))
    sane = _finite(c("price")) & (c("price") > 0) & _finite(c("atr")) & (c("atr") >= 0)
    return F.when(sane, out).otherwise(F.lit(0.0))


def _pct(c: Column, digits: int) -> Column:
    """Fixed decimals of the exact binary value, ties to even."""
    return F.call_function("format_number", c, F.lit("0." + "0" * digits))


def _plain(c: Column) -> Column:
    """A number without trailing zeros, as ``70`` or ``70.5``."""
    return F.call_function("format_number", c, F.lit("0.####"))


def evaluate_gate(decisions, config: GateConfig = GateConfig()):
    """Add ``risk_action``, ``risk_reason``, ``executed_size``, ``reliability``.

    Needs: proposed_action, conviction, exposure_pct, max_risk_pct,
    daily_drawdown_pct (nullable), market_stale, news_stale, red_flag,
    untrusted, matched_terms (array), news_count, rsi_status, macd_status,
    atr_status, atr, price, in_cooldown.
    """
    c = F.col
    action = F.upper(F.trim(c("proposed_action")))
    buy, sell = action == "BUY", action == "SELL"
    conviction, exposure, allowed = c("conviction"), c("exposure_pct"), c("max_risk_pct")
    drawdown = c("daily_drawdown_pct")
    sys_rel = reliability(action)
    hybrid = conviction / F.lit(100.0) * sys_rel
    block = lambda text: F.concat(F.lit("Directional Gate: "), action, F.lit(f" bloqueado por {text}"))
    terms = F.concat_ws(", ", F.coalesce(c("matched_terms"), F.array().cast("array<string>")))
    terms = F.when(terms == "", F.lit("unknown")).otherwise(terms)
    size = F.when(buy, F.least(F.lit(config.kelly_pct), allowed)).otherwise(F.least(allowed, exposure))

    steps = [
        (~(_finite(conviction) & _finite(exposure) & _finite(allowed)), F.lit("Risk input nao finito.")),
        (~conviction.between(0, 100), F.lit("Conviccao fora do intervalo 0..100.")),
        (exposure < 0, F.lit("Exposicao nao pode ser negativa.")),
        (~((allowed > 0) & (allowed <= 100)), F.lit("Limite por trade fora do intervalo 0..100.")),
        (action == "HOLD", F.lit("LLM sugeriu HOLD.")),
        (~action.isin("BUY", "SELL"), F.concat(F.lit("LLM sugeriu acao invalida: "), c("proposed_action"))),
        (buy & drawdown.isNotNull() & ~(_finite(drawdown) & (drawdown >= 0)),
         F.lit("Drawdown diario invalido ou nao finito.")),
        (buy & (drawdown >= F.lit(config.max_daily_drawdown)), F.concat(
            F.lit("Limite de drawdown diario atingido ("), _pct(drawdown, 2),
            F.lit(f"% >= {config.max_daily_drawdown:.2f}%). BUY bloqueado."))),
        (c("market_stale"), block("market data stale")),
        (c("untrusted"), block("instrucao nao confiavel em noticias")),
        (buy & c("news_stale"), block("noticias stale")),
        (buy & c("red_flag"), F.concat(block("news red flag ("), terms, F.lit(")"))),
        (buy & (c("rsi_status") == "OVERBOUGHT"), block("RSI OVERBOUGHT")),
        (buy & (c("rsi_status") == "OVERSOLD") & ~F.coalesce(c("macd_status").isin(*BULLISH), F.lit(False)),
         block("RSI OVERSOLD sem confirmacao MACD bullish")),
        (buy & c("macd_status").isin(*BEARISH), F.concat(block("MACD "), c("macd_status"))),
        (buy & (c("atr_status") == "EXTREME"), block("ATR EXTREME")),
        (sell & (c("rsi_status") == "OVERSOLD"), block("RSI OVERSOLD")),
        (sell & c("macd_status").isin(*BULLISH), F.concat(block("MACD "), c("macd_status"))),
        (c("in_cooldown"), F.concat(F.lit("Cooldown: "), action,
                                    F.lit(f" repetido nos ultimos {config.cooldown_minutes} minutos"))),
        (conviction < 70, F.concat(F.lit("Conviccao bruta da IA insuficiente ("), _plain(conviction),
                                   F.lit("%). Exige-se minimo de 70%."))),
        ((c("news_count") == 0) & (conviction < 80), F.concat(
            F.lit("Noticias velhas/ausentes. IA nao tem conviccao absoluta ("), _plain(conviction),
            F.lit("% < 80%)."))),
        (hybrid < 0.5, F.concat(F.lit("Confianca Hibrida muito baixa ("), _pct(hybrid * 100, 1),
                                F.lit("%). Limiar e 50%."))),
        (buy & (exposure >= F.lit(config.max_exposure)),
         F.lit(f"Teto de alocacao de portfolio ({config.max_exposure}%) atingido. Compras bloqueadas.")),
        (buy & (size <= 0), F.lit("Matematica de Kelly sugere lote nulo ou negativo.")),
        (sell & (size <= 0), F.lit("SELL bloqueado: portfolio sem exposicao em BTC.")),
    ]
    blocked = F.lit(None).cast("string")
    for condition, text in reversed(steps):
        blocked = F.when(condition, text).otherwise(blocked)
    label = F.when(buy, "Tamanho do Kelly: ").otherwise("Reducao de exposicao: ")
    approved = F.concat(F.lit("Aprovado. Confianca Hibrida: "), _pct(hybrid * 100, 1), F.lit("%. "),
                        label, _pct(size, 2), F.lit("%"))
    out = decisions.withColumn("_blocked", blocked)
    free = c("_blocked").isNull()
    return (out.withColumn("reliability", sys_rel)
            .withColumn("risk_action", F.when(free, action).otherwise("HOLD"))
            .withColumn("risk_reason", F.coalesce(c("_blocked"), approved))
            .withColumn("executed_size", F.when(free, size).otherwise(F.lit(0.0)))
            .drop("_blocked"))


def cap_proposals(decisions):
    """Payload caps applied before the gate: unsafe inputs force HOLD at zero,
    stale news caps conviction at 60, everything at 80."""
    c = F.col
    active = c("proposed_action") != "HOLD"
    forced = [
        (active & c("tools_degraded"), "HOLD: contexto de ferramentas degradado."),
        (active & c("market_stale"), "HOLD: market data stale."),
        (active & c("untrusted"), "HOLD: instrucao nao confiavel em noticias."),
    ]
    reason = F.lit(None).cast("string")
    for condition, text in reversed(forced):
        reason = F.when(condition, text).otherwise(reason)
    capped = F.least(F.when(active & c("news_stale"), F.least(c("conviction"), F.lit(60.0)))
                     .otherwise(c("conviction")), F.lit(80.0))
    out = decisions.withColumn("_forced", reason)
    return (out.withColumn("conviction", F.when(c("_forced").isNotNull(), F.lit(0.0)).otherwise(capped))
            .withColumn("proposed_action", F.when(c("_forced").isNotNull(), "HOLD").otherwise(c("proposed_action")))
            .withColumn("cap_reason", c("_forced")).drop("_forced"))
