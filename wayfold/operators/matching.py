"""Map matching: the vertex or edge that a point means. Distances are squared planar degrees, as the index compares them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine_m
from wayfold.functions.units import convert
from wayfold.operators.graph import KEY, Network
from wayfold.plans.scratch import materialise


def cell_size(objects: DataFrame, per_cell: float = 2.0) -> float:
    """A cell's side in degrees, for about so many objects (x, y) in a cell."""
    r = objects.agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    if not r["n"]:
        return 1.0
    return max(1e-9, float(((max(r["w"], 1e-6) * max(r["h"], 1e-6)) * per_cell / r["n"]) ** 0.5))


def nearest(points: DataFrame, boxes: DataFrame, keys: list[str], size: float | None = None, rounds: int = 64) -> DataFrame:
    """For each point (point_id, x, y) the nearest box (keys, x0, y0, x1, y1); equal distances go to the smallest keys.

    Boxes lie in the cells that they cover. A point looks at the cells around it; if what it finds is farther away than the
    cells reach, it looks again with twice the reach. Of boxes in one place only that with the smallest keys can be an answer,
    however many there are, and points in one place have one. Where boxes overlap much, a cell keeps the smallest of those that
    cover it, and of the others those with smaller keys: no other is an answer for any point (see ``_uncovered``). Returns
    point_id, the keys, and d2.
    """
    place = ["x0", "y0", "x1", "y1"]
    types = boxes.select(*keys).schema
    firsts = boxes.filter(" AND ".join(f"{c} IS NOT NULL" for c in place)).groupBy(*place).agg(F.min(F.struct(*keys)).alias("k"))
    boxes = materialise(firsts.select(*(F.col(f"k.{k}").alias(k) for k in keys), *place), "boxes")
    crowded = False
    if size is None:  # a box should lie in some cells only
        fine = cell_size(boxes.select(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")))
        mean = boxes.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 0.0
        size, crowded = max(fine, float(mean) / 4), mean > fine
    edge = lambda c: F.floor(F.col(c) / size)
    cells = boxes.withColumn("i", F.explode(F.sequence(edge("x0"), edge("x1")))).withColumn("j", F.explode(F.sequence(edge("y0"), edge("y1"))))
    cells = materialise(_uncovered(boxes, cells, keys, size) if crowded else cells.select(*keys, *place, "i", "j"), "cells")
    around = cells.agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1")).first()
    if around["i0"] is None:
        return points.select("point_id", *[F.lit(None).cast(types[k].dataType).alias(k) for k in keys], F.lit(0.0).alias("d2")).limit(0)
    placed = points.select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    # In cells that much covers, what a point's own cell holds is mostly enough.
    left, done, reach = materialise(placed.select("x", "y").distinct(), "points"), None, 0 if crowded else 1
    far = lambda lo, v, hi: F.greatest(F.col(lo) - F.col(v), F.lit(0.0), F.col(v) - F.col(hi))
    for _ in range(rounds):
        # Cells that hold no box need not be asked for.
        span = lambda v, lo, hi, reach=reach: F.sequence(F.greatest(F.floor(F.col(v) / size) - reach, F.lit(lo)), F.least(F.floor(F.col(v) / size) + reach, F.lit(hi)))
        some = lambda v, lo, hi, reach=reach: (F.floor(F.col(v) / size) + reach >= lo) & (F.floor(F.col(v) / size) - reach <= hi)
        asked = left.filter(some("x", around["i0"], around["i1"]) & some("y", around["j0"], around["j1"]))
        asked = asked.withColumn("i", F.explode(span("x", around["i0"], around["i1"]))).withColumn("j", F.explode(span("y", around["j0"], around["j1"])))
        met = asked.join(cells, ["i", "j"]).withColumn("d2", F.pow(far("x0", "x", "x1"), 2) + F.pow(far("y0", "y", "y1"), 2))
        best = met.groupBy("x", "y").agg(F.min(F.struct("d2", *keys)).alias("m"))
        # What lies outside the cells looked at is at least so far away.
        rim = F.least(F.col("x") - (F.floor(F.col("x") / size) - reach) * size, (F.floor(F.col("x") / size) + reach + 1) * size - F.col("x"), F.col("y") - (F.floor(F.col("y") / size) - reach) * size, (F.floor(F.col("y") / size) + reach + 1) * size - F.col("y"))
        whole = (F.floor(F.col("x") / size) - reach <= around["i0"]) & (F.floor(F.col("x") / size) + reach >= around["i1"]) & (F.floor(F.col("y") / size) - reach <= around["j0"]) & (F.floor(F.col("y") / size) + reach >= around["j1"])
        told = materialise(left.join(best, ["x", "y"], "left").withColumn("sure", F.col("m").isNotNull() & ((F.col("m.d2") < rim * rim) | whole)), "told")
        found = told.filter("sure").select("x", "y", *[F.col(f"m.{k}").alias(k) for k in keys], F.col("m.d2").alias("d2"))
        done = found if done is None else done.unionByName(found)
        left = materialise(told.filter("NOT sure").select("x", "y"), "points")
        if left.isEmpty():
            return placed.join(done, ["x", "y"]).select("point_id", *keys, "d2")
        reach = max(1, 2 * reach)
    raise RuntimeError("points far from all objects: give a larger cell size")


def _uncovered(boxes: DataFrame, cells: DataFrame, keys: list[str], size: float) -> DataFrame:
    """The rows of ``cells`` (a box in a cell) that may be answers.

    A box that covers a cell is as near to any point as whatever of another box lies in the cell; so there the other is no
    answer if its keys are greater. Cells end where the boxes' extent does. Only one row a cell is exchanged for it.
    """
    ends = boxes.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).first()
    slack = size * 1e-3  # a cell is taken to be a little larger than it is, whatever is lost in rounding
    over = lambda at, lo, hi: (F.col(lo) <= F.greatest(F.col(at) * size - slack, F.lit(ends[lo]))) & (F.col(hi) >= F.least((F.col(at) + 1) * size + slack, F.lit(ends[hi])))
    mine = F.struct(*keys)
    full = cells.filter(over("i", "x0", "x1") & over("j", "y0", "y1"))
    least = materialise(full.groupBy("i", "j").agg(F.min(mine).alias("cover")), "covers")
    kept = cells.join(F.broadcast(least.select(F.col("i").alias("ci"), F.col("j").alias("cj"), "cover")), (F.col("i") == F.col("ci")) & (F.col("j") == F.col("cj")), "left")
    return kept.filter(F.col("cover").isNull() | (mine <= F.col("cover"))).select(*keys, "x0", "y0", "x1", "y1", "i", "j")


def vertex_boxes(vertices: DataFrame) -> DataFrame:
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return vertices.select("vertex_id", x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"))


def edge_boxes(lines: DataFrame) -> DataFrame:
    """The boxes of lines (edge_list_id, edge_id, line)."""
    xs, ys = F.transform("line", lambda p: p["x"].cast("double")), F.transform("line", lambda p: p["y"].cast("double"))
    return lines.select(*KEY, F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def nearest_vertex(points: DataFrame, network: Network, size: float | None = None) -> DataFrame:
    """point_id, vertex_id, d2"""
    return nearest(points, vertex_boxes(network.vertices), ["vertex_id"], size)


def nearest_edge(points: DataFrame, lines: DataFrame, size: float | None = None) -> DataFrame:
    """point_id, edge_list_id, edge_id, d2: by the distance to the line's bounding box."""
    return nearest(points, edge_boxes(lines), list(KEY), size)


def within_tolerance(x: Column, y: Column, corner_x: Column, corner_y: Column, tolerance: float, unit: str = "meters") -> Column:
    """Whether the box's lower corner is nearer than the tolerance."""
    return haversine_m(x, y, corner_x, corner_y) < convert(tolerance, "distance", unit, "meters")


def match_tolerance(points: DataFrame, matches: DataFrame, boxes: DataFrame, keys: list[str], tolerance: float, unit: str = "meters") -> DataFrame:
    """Matches with ``error`` set where the box is not within the tolerance."""
    joined = matches.join(points.select("point_id", "x", "y"), "point_id").join(boxes.select(*keys, "x0", "y0"), keys)
    ok = within_tolerance(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), tolerance, unit)
    return joined.select("point_id", *keys, "d2", F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"nothing within {tolerance} {unit}")).alias("error"))


def matchable(network: Network, valid_edges: DataFrame | None, side: str) -> DataFrame:
    """Vertices that a trip may start from (origin: a valid edge leaves) or end at (destination: a valid edge arrives)."""
    edges = network.edges if valid_edges is None else valid_edges
    return edges.select(F.col("src" if side == "origin" else "dst").alias("vertex_id")).distinct()


def match_by_point(points: DataFrame, network: Network, side: str, valid_edges: DataFrame | None = None, tolerance: float | None = None, unit: str = "meters", compat_tolerance: bool = False) -> DataFrame:
    """point_id, vertex_id, error: the nearest vertex with a valid edge, within the tolerance.

    ``compat_tolerance`` keeps the ones at or beyond the tolerance instead.
    """
    usable = network.vertices.join(matchable(network, valid_edges, side), "vertex_id", "left_semi")
    found = nearest(points, vertex_boxes(usable), ["vertex_id"])
    joined = points.select("point_id", "x", "y").join(found, "point_id", "left").join(usable.select("vertex_id", F.col("x").alias("vx"), F.col("y").alias("vy")), "vertex_id", "left")
    error = F.when(F.col("vertex_id").isNull(), F.lit("no vertex"))
    if tolerance is not None:
        ok = F.coalesce(within_tolerance(F.col("x"), F.col("y"), F.col("vx"), F.col("vy"), tolerance, unit), F.lit(False))
        error = F.coalesce(error, F.when(ok if compat_tolerance else ~ok, F.lit(f"nothing within {tolerance} {unit}")))
    return joined.select("point_id", F.when(error.isNull(), F.col("vertex_id")).alias("vertex_id"), error.alias("error"))


def match_by_vertex(rows: DataFrame, network: Network, side: str, valid_edges: DataFrame | None = None) -> DataFrame:
    """(point_id, vertex_id) -> with ``error`` for vertices without a valid edge on that side."""
    ok = matchable(network, valid_edges, side).select(F.col("vertex_id").alias("__ok"))
    joined = rows.join(ok, F.col("vertex_id") == F.col("__ok"), "left")
    return joined.select("point_id", "vertex_id", F.when(F.col("__ok").isNull(), F.lit(f"vertex cannot be a {side}")).alias("error"))


def match_by_edge(rows: DataFrame, network: Network, valid_edges: DataFrame | None = None) -> DataFrame:
    """(point_id, edge_list_id, edge_id) -> with ends and ``error`` for edges that are not valid."""
    edges = (network.edges if valid_edges is None else valid_edges).select(*KEY, "src", "dst")
    joined = rows.join(edges, KEY, "left")
    return joined.select("point_id", *KEY, "src", "dst", F.when(F.col("src").isNull(), F.lit("edge is not there or not valid")).alias("error"))


def match_requests(requests: DataFrame, network: Network, order: tuple[str, ...] = ("point", "vertex", "edge"), valid_edges: DataFrame | None = None, tolerance: float | None = None, unit: str = "meters", destination_required: bool = False) -> DataFrame:
    """Adds origin, destination (vertices), the edges of edge-oriented requests, and ``error``.

    ``requests`` has typed columns, null where a request lacks them: query_id, and for origin and destination ``*_x``, ``*_y``,
    ``*_vertex``, ``*_edge_list``, ``*_edge``. For each side the first of ``order`` that gives a match is taken. Of an origin
    edge its end is the vertex, of a destination edge its start.
    """
    out = requests
    for side in ("origin", "destination"):
        found = []
        if "point" in order:
            points = requests.select(F.col("query_id").alias("point_id"), F.col(f"{side}_x").alias("x"), F.col(f"{side}_y").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
            found.append(match_by_point(points, network, side, valid_edges, tolerance, unit).select("point_id", F.col("vertex_id").alias("v"), F.lit(None).cast("int").alias("l"), F.lit(None).cast("long").alias("e"), F.col("error").alias("why"), F.lit(order.index("point")).alias("rank")))
        if "vertex" in order:
            rows = requests.select(F.col("query_id").alias("point_id"), F.col(f"{side}_vertex").alias("vertex_id")).filter("vertex_id IS NOT NULL")
            found.append(match_by_vertex(rows, network, side, valid_edges).select("point_id", F.when(F.col("error").isNull(), F.col("vertex_id")).alias("v"), F.lit(None).cast("int").alias("l"), F.lit(None).cast("long").alias("e"), F.col("error").alias("why"), F.lit(order.index("vertex")).alias("rank")))
        if "edge" in order:
            rows = requests.select(F.col("query_id").alias("point_id"), F.coalesce(F.col(f"{side}_edge_list"), F.lit(0)).cast("int").alias("edge_list_id"), F.col(f"{side}_edge").alias("edge_id")).filter("edge_id IS NOT NULL")
            found.append(match_by_edge(rows, network, valid_edges).select("point_id", F.when(F.col("error").isNull(), F.col("dst" if side == "origin" else "src")).alias("v"), F.col("edge_list_id").alias("l"), F.col("edge_id").alias("e"), F.col("error").alias("why"), F.lit(order.index("edge")).alias("rank")))
        tried = found[0]
        for f in found[1:]:
            tried = tried.unionByName(f)
        best = tried.groupBy("point_id").agg(F.min(F.struct(F.col("v").isNull(), "rank", "v", "l", "e", "why")).alias("m"))
        out = out.join(best, F.col("query_id") == F.col("point_id"), "left").drop("point_id")
        needed = side == "origin" or destination_required
        why = F.coalesce(F.when(F.col("m.v").isNull(), F.col("m.why")), F.when(F.lit(needed) & F.col("m.v").isNull(), F.lit(f"no {side}")))
        out = out.withColumn(side, F.col("m.v")).withColumn(f"{side}_matched_list", F.col("m.l")).withColumn(f"{side}_matched_edge", F.col("m.e"))
        out = out.withColumn("error", F.coalesce(F.col("error"), why) if "error" in out.columns else why).drop("m")
    return out


def lines_of(rows: DataFrame, lines: DataFrame, order: str = "row") -> DataFrame:
    """The lines of (row, edge_list_id, edge_id), one for each row, in its place; a missing line is null."""
    return rows.join(lines, KEY, "left").select(order, *KEY, "line")
