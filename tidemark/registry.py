"""Named extension points: rule baselines and analysis tools."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import signals


class Registry(Mapping):
    """Names bound to column factories or other entries; a name is taken once."""

    def __init__(self, **items: Callable[[], Column]):
        self._items = dict(items)

    def register(self, name: str, factory: Callable[[], Column], replace: bool = False) -> None:
        if name in self._items and not replace:
            raise ValueError(f"{name} is already registered")
        self._items[name] = factory

    def __getitem__(self, name: str):
        return self._items[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._items)

    def __len__(self) -> int:
        return len(self._items)


def baseline_columns(momentum: str = "return_60m_pct", rsi: str = "rsi_14", macd: str = "macd_hist_pct",
                     spread: str = "ema_9_21_spread_pct") -> dict[str, Callable[[], Column]]:
    """The four rule baselines over the named feature columns."""
    return {
        "always_hold": lambda: F.lit("HOLD"),
        "momentum": lambda: signals.momentum(F.col(momentum)),
        "trend_confirmation": lambda: signals.trend_confirmation(F.col(spread), F.col(macd)),
        "rsi_mean_reversion": lambda: signals.rsi_reversion(F.col(rsi)),
    }


BASELINES = Registry(**baseline_columns())
