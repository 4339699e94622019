"""Geometry as Column expressions: distances, bearings, lines, polygons, well-known text and bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RADIUS_M = 6_371_000.0
LINE = "array<struct<x:float,y:float>>"
LINE_TYPE = T.ArrayType(T.StructType([T.StructField("x", T.FloatType()), T.StructField("y", T.FloatType())]))


def haversine_m(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Great-circle metres between lon/lat points; null for points outside +-180, +-90."""
    dlat, dlon = F.radians(y1 - y0), F.radians(x1 - x0)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(y0)) * F.cos(F.radians(y1)) * F.pow(F.sin(dlon / 2), 2)
    valid = (F.abs(x0) <= 180) & (F.abs(x1) <= 180) & (F.abs(y0) <= 90) & (F.abs(y1) <= 90)
    return F.when(valid, 2 * RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))


def bearing(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Compass bearing in whole degrees, 0 to 359, from the first point to the second."""
    lat0, lat1, dlon = F.radians(y0), F.radians(y1), F.radians(x1 - x0)
    angle = F.atan2(F.sin(dlon) * F.cos(lat1), F.cos(lat0) * F.sin(lat1) - F.sin(lat0) * F.cos(lat1) * F.cos(dlon))
    return F.pmod(F.degrees(angle) + 360, F.lit(360.0)).cast("int")


def line_bearings(line: Column) -> tuple[Column, Column]:
    """Bearings of a line's first and last segment."""
    n = F.size(line)
    ends = lambda i, j: bearing(*(F.element_at(line, k)[c].cast("double") for k in (i, j) for c in ("x", "y")))
    return ends(F.lit(1), F.lit(2)), ends(n - 1, n)


def points_of_wkt(wkt: Column) -> Column:
    """The points of a LINESTRING as an array; null if the text is none."""
    body = F.regexp_extract(F.trim(wkt), r"(?i)^LINESTRING\s*(?:Z\s*)?\(([^()]*)\)$", 1)
    point = lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("float").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("float").alias("y"))
    return F.when(body != "", F.transform(F.split(body, ","), point))


def line_wkt(points: Column) -> Column:
    """WKT of a line of points."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def multiline_wkt(lines: Column) -> Column:
    one = lambda line: F.concat(F.lit("("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
    return F.concat(F.lit("MULTILINESTRING ("), F.array_join(F.transform(lines, one), ", "), F.lit(")"))


def concat_lines(lines: Column) -> Column:
    """The points of all lines, one after the other; joints stay doubled."""
    return F.flatten(lines)


@F.pandas_udf(T.BinaryType())
def line_wkb(points: pd.Series) -> pd.Series:
    """Little-endian WKB of a line."""
    return points.map(lambda ps: None if ps is None else struct.pack("<BII", 1, 2, len(ps)) + b"".join(struct.pack("<dd", p["x"], p["y"]) for p in ps))


def multiline_hex(lines: Column) -> Column:
    """Little-endian WKB of a MULTILINESTRING from an array of its lines' WKB, both as hexadecimal text."""
    n = F.lpad(F.hex(F.size(lines)), 8, "0")
    return F.concat(F.lit("0105000000"), *(F.substring(n, at, 2) for at in (7, 5, 3, 1)), F.array_join(lines, ""))


@F.pandas_udf(LINE_TYPE)
def points_of_wkb(wkb: pd.Series) -> pd.Series:
    """The points of a WKB LINESTRING of either byte order; null if the bytes are none."""

    def parse(data: bytes | None):
        if data is None or len(data) < 9:
            return None
        order = "<" if data[0] else ">"
        kind, n = struct.unpack_from(order + "II", data, 1)
        if kind != 2 or len(data) < 9 + 16 * n:
            return None
        values = struct.unpack_from(f"{order}{2 * n}d", data, 9)
        return [{"x": values[i], "y": values[i + 1]} for i in range(0, 2 * n, 2)]

    return wkb.map(parse)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a ring of points (even-odd rule); one on the ring itself does not."""
    n = F.size(ring)
    ends = lambda i: (F.element_at(ring, i + 1), F.element_at(ring, F.pmod(i + 1, n) + 1))

    def crosses(i: Column) -> Column:
        a, b = ends(i)
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"]
        return F.coalesce((spans & (x < at)).cast("int"), F.lit(0))

    def touches(i: Column) -> Column:
        a, b = ends(i)
        along = x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        return along & ((b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"]))

    sides = F.sequence(F.lit(0), n - 1)
    hits = F.aggregate(sides, F.lit(0), lambda acc, i: acc + crosses(i))
    return (n >= 3) & (hits % 2 == 1) & ~F.exists(sides, touches)


def ring_box(ring: Column) -> list[Column]:
    """min x, min y, max x, max y."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def _clip(subject: list[tuple[float, float]], clip: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Sutherland-Hodgman clipping by a convex ring."""
    area2 = sum(clip[i][0] * clip[(i + 1) % len(clip)][1] - clip[(i + 1) % len(clip)][0] * clip[i][1] for i in range(len(clip)))
    ring = clip if area2 > 0 else clip[::-1]
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        side = lambda p, ax=ax, ay=ay, bx=bx, by=by: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
        out = []
        for p, q in zip(subject, subject[1:] + subject[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                k = sp / (sp - sq)
                out.append((p[0] + k * (q[0] - p[0]), p[1] + k * (q[1] - p[1])))
        subject = out
        if not subject:
            return []
    return subject


@F.pandas_udf(T.DoubleType())
def overlap_area(ring: pd.Series, convex: pd.Series) -> pd.Series:
    """Area of the part of ``ring`` inside the convex ring."""

    def area(a, b) -> float:
        made = _clip([(p["x"], p["y"]) for p in a], [(p["x"], p["y"]) for p in b])
        return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(made, made[1:] + made[:1], strict=True))) / 2 if made else 0.0

    return pd.Series([area(a, b) for a, b in zip(ring, convex, strict=True)])


def with_cells(df: DataFrame, x: str, y: str, size: float, cell: str = "cell") -> DataFrame:
    """Adds the grid cell of a point."""
    return df.withColumn(cell, F.struct(F.floor(F.col(x) / size).alias("i"), F.floor(F.col(y) / size).alias("j")))
