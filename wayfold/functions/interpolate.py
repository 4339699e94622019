"""Interpolation over regular grids, as Column expressions."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def linspace(low: float, high: float, bins: int) -> list[float]:
    return [low + (high - low) * i / (bins - 1) for i in range(bins)] if bins > 1 else [low]


def interpolate(values: list[float], axes: list[tuple[float, float, int]], at: list[Column]) -> Column:
    """The n-linear blend of ``values`` (the last axis fastest) at a point; outside the grid as at its edge.

    ``axes`` has (low, high, bins) for each dimension. The grid is one constant of the plan, so the whole is one expression.
    """
    grid = F.from_json(F.lit(json.dumps(list(map(float, values)))), "array<double>")
    strides = [1]
    for _, _, bins in reversed(axes[1:]):
        strides.insert(0, strides[0] * bins)
    cells, parts = [], []
    for (low, high, bins), x in zip(axes, at, strict=True):
        place = (F.least(F.greatest(x.cast("double"), F.lit(float(low))), F.lit(float(high))) - low) / ((high - low) / (bins - 1))
        cell = F.least(F.floor(place), F.lit(bins - 2)).cast("int")
        cells.append(cell)
        parts.append(place - cell)
    total = None
    for corner in itertools.product((0, 1), repeat=len(axes)):
        index, weight = F.lit(1), F.lit(1.0)
        for k, up in enumerate(corner):
            index = index + (cells[k] + up) * strides[k]
            weight = weight * (parts[k] if up else 1 - parts[k])
        term = F.element_at(grid, index) * weight
        total = term if total is None else total + term
    return total


def interpolate_point(values: list[float], axes: list[tuple[float, float, int]], at: list[float]) -> float:
    """The same for one point on the driver or in a kernel."""
    strides = [1]
    for _, _, bins in reversed(axes[1:]):
        strides.insert(0, strides[0] * bins)
    cells, parts = [], []
    for (low, high, bins), x in zip(axes, at, strict=True):
        place = (min(max(x, low), high) - low) / ((high - low) / (bins - 1))
        cells.append(min(int(place), bins - 2))
        parts.append(place - cells[-1])
    return sum(
        values[sum((cells[k] + up) * strides[k] for k, up in enumerate(corner))] * _product(parts[k] if up else 1 - parts[k] for k, up in enumerate(corner))
        for corner in itertools.product((0, 1), repeat=len(axes))
    )


def _product(values) -> float:
    made = 1.0
    for v in values:
        made *= v
    return made
