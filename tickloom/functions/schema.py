"""Column names of a tick table; every operator takes them as a parameter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TickSchema:
    symbol: str = "symbol"
    ts: str = "ts"
    price: str = "price"
    volume: str = "volume"
    volatility: str = "volatility"
    order_key: str = "order_key"

    def order(self) -> WindowSpec:
        """Rows of a symbol in time; the order key makes the order total."""
        return Window.partitionBy(self.symbol).orderBy(self.ts, self.order_key)

    def reverse(self) -> WindowSpec:
        """The same rows from the last to the first."""
        return Window.partitionBy(self.symbol).orderBy(F.desc(self.ts), F.desc(self.order_key))


TICKS = TickSchema()
