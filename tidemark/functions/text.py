"""Text scanning, tokens, hashes and rendered texts as columns."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lexicon and instruction-like patterns the scan must agree on.
NEGATIVE_TERMS = (
    "ban", "crash", "hack", "investigacao", "liquidacao", "liquidacoes", "panic", "panico",
    "proibicao", "queda", "regulador", "saidas", "suspende",
)
NEWS_PATTERNS = (
    r"\bignore (all |any )?(previous|prior|system) instructions?\b",
    r"\b(disregard|override) (the )?(previous|prior|system) instructions?\b",
    r"\b(system prompt|developer message)\b",
    r"\b(retorne|return|responda|respond) (apenas |only )?(buy|sell|hold)\b",
    r"\b(fin(j|ja)|end) (as )?(instrucoes|instructions)\b",
)
#: Words of which every match of a pattern holds one; texts without them are not searched.
HINTS = {
    NEWS_PATTERNS[0]: ("instruction",),
    NEWS_PATTERNS[1]: ("instruction",),
    NEWS_PATTERNS[2]: ("system prompt", "developer message"),
    NEWS_PATTERNS[3]: ("return", "retorne", "respond"),
    NEWS_PATTERNS[4]: ("instrucoes", "instructions"),
}
CHUNK_PATTERNS = (
    r"(?s)\bignore\b.{0,80}\b(previous|prior|all|as)\b.{0,80}\b(instruction|instructions|instru)",
    r"(?s)\b(disregard|override)\b.{0,80}\b(instruction|instructions|system|policy)",
    r"(?s)\b(recomende|recommend)\b.{0,40}\b(buy|sell|hold|comprar|vender)\b",
)
REDACTED = "[REMOVED: instruction-like untrusted headline]"
#: Fixed values.
BLOCKED_FLAGS = ("prompt_injection_suspected", "secret_suspected")
BLOCKED_PREFIXES = (
    ".agents/", ".git/", "backend/backups/", "backend/logs/", "backend/reports/",
    "desktop/dist/", "desktop/node_modules/", "node_modules/",
)
BLOCKED_NAMES = (".env", ".env.local", ".env.production")
BLOCKED_SUFFIXES = (".key", ".pem", ".p12", ".pfx")
#: Fixed values.
STOPWORDS = ("para", "com", "uma", "das", "dos", "the", "and", "from", "que", "por", "btc")
#: Fixed values.
GENERIC_HOLD = (
    "noticias confusas", "notícias confusas", "indicadores neutros", "mercado confuso",
    "rsi neutro", "sem direcao clara", "sem direção clara",
)

def _unmarked(value: str) -> str:
    out = unicodedata.normalize("NFKD", value)
    for mark in filter(unicodedata.combining, set(out)):
        out = out.replace(mark, "")
    return out


@F.pandas_udf(T.StringType())
def fold_unicode(text: pd.Series) -> pd.Series:
    """Case folding plus full compatibility decomposition without marks."""
    return text.map(lambda v: None if v is None else _unmarked(v.casefold()))


@F.pandas_udf(T.StringType())
def ascii_unicode(text: pd.Series) -> pd.Series:
    """The ASCII characters of the full compatibility decomposition, in lower case."""
    return text.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().lower())


def _beyond_ascii(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7F]"), text)


def fold_text(text: Column) -> Column:
    """Folded text of headlines; only texts with a character beyond ASCII leave the JVM."""
    return F.coalesce(fold_unicode(_beyond_ascii(text)), F.lower(text))


def fold_ascii(text: Column) -> Column:
    """Folded text of search hits: what has no ASCII form is dropped, blanks are single."""
    plain = F.coalesce(ascii_unicode(_beyond_ascii(text)), F.lower(text))
    return F.trim(F.regexp_replace(plain, r"[\s\x1C-\x1F]+", " "))


def matched_patterns(folded: Column, patterns=NEWS_PATTERNS) -> Column:
    """Indexes (0-based) of the patterns found, in order."""
    hits = F.array(*[F.when(folded.rlike(p), F.lit(i)) for i, p in enumerate(patterns)])
    return F.filter(hits, lambda x: x.isNotNull())


def looks_like_instruction(folded: Column, patterns=NEWS_PATTERNS) -> Column:
    found = F.lit(False)
    for p in patterns:
        hints = [folded.contains(word) for word in HINTS.get(p, ())]
        found = found | (reduce(or_, hints) & folded.rlike(p) if hints else folded.rlike(p))
    return found


def redact(headline: Column, folded: Column) -> Column:
    return F.when(looks_like_instruction(folded), F.lit(REDACTED)).otherwise(headline)


def negative_terms(folded: Column, lexicon=NEGATIVE_TERMS) -> Column:
    """Sorted lexicon terms that occur as whole tokens."""
    tokens = F.split(folded, "[^a-z0-9]+")
    return F.array_sort(F.array_intersect(F.array(*[F.lit(t) for t in lexicon]), tokens))


def query_tokens(query: Column, stopwords=STOPWORDS) -> Column:
    """Distinct words of three letters or more, without underscores or stop words."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"([\p{L}\p{N}]{3,})"), F.lit(1))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in stopwords]))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def containment(text: Column, tokens: Column) -> Column:
    """Share of tokens that occur anywhere in the text, 4 decimals."""
    low = F.lower(text)
    hits = F.size(F.filter(tokens, lambda t: F.contains(low, t)))
    return F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise(F.round(hits / F.size(tokens), 4))


def headline_key(source: Column, headline: Column) -> Column:
    return F.md5(F.concat(source, F.lit("|"), headline))


def document_key(source_type: Column, source: Column, title: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", source_type, source, title, text), 256)


def drawdown_key(asset: Column, peak: Column, trough: Column, severity: Column) -> Column:
    return F.sha2(F.concat_ws("|", asset, F.lit("DRAWDOWN"), peak.cast("string"),
                              trough.cast("string"), severity), 256)


def blocked_path(path: Column) -> Column:
    clean = F.lower(F.regexp_replace(F.translate(path, "\\", "/"), r"^[./]+", ""))
    name = F.element_at(F.split(clean, "/"), -1)
    out = name.isin(*BLOCKED_NAMES)
    for prefix in BLOCKED_PREFIXES:
        out = out | clean.startswith(prefix)
    for suffix in BLOCKED_SUFFIXES:
        out = out | name.endswith(suffix)
    return out


def reason_class(reason: Column, model_text: Column) -> Column:
    """One of ten classes, first match wins."""
    r = F.coalesce(reason, F.lit(""))
    both = F.lower(F.concat(r, F.lit(" "), F.coalesce(model_text, F.lit(""))))
    failure = both.contains("llm technical failure") | both.contains("system api error") \
        | both.contains("validation failed")
    return (F.when(r.startswith("Directional Gate"), "directional_gate")
            .when(r.startswith("Cooldown"), "cooldown")
            .when(F.lower(r).contains("stale"), "stale_data")
            .when(failure, "llm_technical_failure")
            .when(r.startswith("LLM sugeriu acao invalida"), "invalid_llm_action")
            .when(r.startswith("LLM sugeriu"), "llm_hold")
            .when(r.startswith("Aprovado"), "approved")
            .when(r.contains("Confianca Hibrida") | r.contains("Conviccao"), "confidence")
            .otherwise("other"))


def specific_hold_reason() -> Column:
    """Hold text from the payload columns (market, news, risk, then technical state)."""
    c = F.col
    terms = F.concat_ws(", ", F.slice(c("matched_terms"), 1, 3))
    terms = F.when(terms == "", "red flag").otherwise(terms)
    age = lambda name: F.coalesce(c(name).cast("string"), F.lit("None"))
    return (F.when(c("market_stale"), F.concat(F.lit("HOLD: market data stale ("), age("kline_age"), F.lit("s).")))
            .when(c("news_stale"), F.concat(F.lit("HOLD: noticias stale ("), age("news_age"), F.lit("s).")))
            .when(c("red_flag"), F.concat(F.lit("HOLD: news risk "), c("risk_level"), F.lit(" ("), terms, F.lit(").")))
            .otherwise(F.concat(F.lit("HOLD: RSI "), F.coalesce(c("rsi_status"), F.lit("UNKNOWN")),
                                F.lit("; MACD "), F.coalesce(c("macd_status"), F.lit("UNKNOWN")),
                                F.lit("; sem alinhamento direcional."))))


def is_generic_hold(action: Column, reasoning: Column) -> Column:
    squeezed = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(reasoning)), r"\.+$", ""), r"\s+", " "))
    return (action == "HOLD") & squeezed.isin(*GENERIC_HOLD)


def retrieval_query(rsi_status: Column, rsi: Column, macd_status: Column, macd: Column, atr: Column,
                    market_stale: Column, news_stale: Column, risk_level: Column, exposure: Column,
                    terms: Column, headlines: Column) -> Column:
    """Query text of a decision snapshot, parts joined by `` | ``."""
    s = lambda col, other="": F.coalesce(col.cast("string"), F.lit(other))
    parts = F.array(
        F.lit("BTC BRL decision review"),
        F.concat(F.lit("RSI "), s(rsi_status, "UNKNOWN"), F.lit(" "), s(rsi)),
        F.concat(F.lit("MACD "), s(macd_status, "UNKNOWN"), F.lit(" "), s(macd)),
        F.concat(F.lit("ATR "), s(atr)),
        F.concat(F.lit("market stale "), F.initcap(s(market_stale, "None"))),
        F.concat(F.lit("news stale "), F.initcap(s(news_stale, "None"))),
        F.concat(F.lit("news risk "), s(risk_level, "UNKNOWN")),
        F.concat(F.lit("exposure "), s(exposure)),
    )
    tail = F.concat(F.coalesce(terms, F.array().cast("array<string>")),
                    F.transform(F.slice(F.coalesce(headlines, F.array().cast("array<string>")), 1, 3),
                                lambda h: F.substring(h, 1, 160)))
    return F.concat_ws(" | ", F.filter(F.concat(parts, tail), lambda p: F.trim(p) != ""))


def case_text(**cols: Column) -> Column:
    """Document text of one audited decision; keys are the labelled fields."""
    s = lambda name: F.coalesce(cols[name].cast("string"), F.lit("None"))
    flag = lambda name: F.initcap(s(name))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("trade_log "), s("log_id"), F.lit(": LLM "), s("llm_action"), F.lit(" final "), s("action")),
        F.concat(F.lit("timestamp: "), s("ts")),
        F.concat(F.lit("llm_reasoning: "), s("llm_reasoning")),
        F.concat(F.lit("llm_decision_brief: "), F.coalesce(cols["brief"], F.lit(""))),
        F.concat(F.lit("risk_reasoning: "), s("reason")),
        F.concat(F.lit("technical: price="), s("price"), F.lit(" RSI="), s("rsi"), F.lit(" "), s("rsi_status"),
                 F.lit(" MACD="), s("macd"), F.lit(" "), s("macd_status"), F.lit(" ATR="), s("atr")),
        F.concat(F.lit("data_health: kline_age="), s("kline_age"), F.lit(" news_age="), s("news_age"),
                 F.lit(" market_stale="), flag("market_stale"), F.lit(" news_stale="), flag("news_stale")),
        F.concat(F.lit("news_risk: level="), s("risk_level"), F.lit(" red_flag="), flag("red_flag"),
                 F.lit(" terms=["), F.concat_ws(", ", F.transform(cols["terms"], lambda t: F.concat(F.lit("'"), t, F.lit("'")))),
                 F.lit("]")),
        F.concat(F.lit("portfolio: exposure="), s("exposure"), F.lit(" drawdown="), flag("drawdown")),
    )


def unwrap_fence(raw: Column) -> Column:
    """Body of a response that is one whole JSON code fence, else the trimmed text."""
    body = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", ""))
    pattern = r"(?is)^```(?:json)?\s*\r?\n(.*?)\r?\n```$"
    inner = F.regexp_extract(body, pattern, 1)
    return F.when(body.rlike(pattern), F.trim(inner)).otherwise(body)


def pick_enum(value: Column, allowed, default: str = "UNKNOWN") -> Column:
    clean = F.upper(F.trim(F.coalesce(F.nullif(value, F.lit("")), F.lit(default))))
    return F.when(clean.isin(*allowed), clean).otherwise(F.lit(default))


def bounded_number(value: Column, low: float, high: float, digits: int) -> Column:
    """Rounded number inside [low, high]; text that is no finite number gives null."""
    number = value.try_cast("double")
    kept = F.when(~F.isnan(number), F.round(number, digits))
    return F.when(kept.between(low, high), kept)


def strict_bool(text: Column) -> Column:
    """Accept true/false/1/0 in any case, null otherwise."""
    clean = F.lower(F.trim(text.cast("string")))
    return F.when(clean.isin("true", "1"), True).when(clean.isin("false", "0"), False)
