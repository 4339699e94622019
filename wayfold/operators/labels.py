"""What two trips must share to be compared: a vertex, or a vertex and a bin of charge."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class VertexLabel:
    def bin(self, state: dict) -> int:
        return 0

    def column(self, state: dict) -> Column:
        return F.lit(0)


@dataclass
class SocBins:
    """The first bin that is at least the charge in percent, else the last."""

    bins: list[float] = field(default_factory=lambda: [float(b) for b in range(10, 101, 10)])

    def bin(self, state: dict) -> int:
        percent = state["trip_soc"] * 100.0
        return next((i for i, b in enumerate(self.bins) if b >= percent), len(self.bins) - 1)

    def column(self, state: dict) -> Column:
        percent = state["trip_soc"] * 100.0
        made = F.lit(len(self.bins) - 1)
        for i, b in reversed(list(enumerate(self.bins))):
            made = F.when(F.lit(float(b)) >= percent, F.lit(i)).otherwise(made)
        return made
