"""Routes out of search trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.plans.scratch import materialise

#: What names a label in a tree.
LABEL = ["query_id", "vertex_id", "bin", "label"]


def leaves(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """The cheapest label at each request's vertex: targets (query_id, vertex_id)."""
    at = tree.join(targets.select("query_id", "vertex_id"), ["query_id", "vertex_id"])
    return at.groupBy("query_id", "vertex_id").agg(F.min(F.struct("g", "bin", "label")).alias("m")).select("query_id", "vertex_id", "m.bin", "m.label", "m.g")


def labels_at(tree: DataFrame, vertices: DataFrame) -> DataFrame:
    """All labels of the tree at the vertices (vertex_id)."""
    return tree.join(vertices.select("vertex_id"), "vertex_id", "left_semi")


def parents(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """The tree's rows for the parents of labels (query_id, vertex_id, bin); a root has none."""
    up = tree.join(labels.select("query_id", "vertex_id", "bin"), ["query_id", "vertex_id", "bin"], "left_semi").filter("parent_vertex IS NOT NULL")
    keys = up.select("query_id", F.col("parent_vertex").alias("vertex_id"), F.col("parent_bin").alias("bin"), F.col("parent_label").alias("label")).distinct()
    return tree.join(keys, LABEL, "left_semi")


def backtrack(tree: DataFrame, targets: DataFrame, depth: int | None = None, direction: str = "forward") -> DataFrame:
    """The edges from the root to each target (query_id, vertex_id), or the last ``depth`` of them, with their position.

    query_id, target, pos, edge_list_id, edge_id, from_vertex, to_vertex, g, objective_cost, total_cost, state. A target that is
    the root has no rows. Forward, positions run from the root on; in reverse, from the leaf. By pointer doubling: the labels
    known to be on a route take those twice as far up in each step, so a route needs as many joins as its length has binary
    digits. Trees whose parents run in a circle are an error.
    """
    wanted = targets.select("query_id").distinct()
    mine = materialise(tree.join(wanted, "query_id", "left_semi"), "wanted")
    now = leaves(mine, targets).select("query_id", F.col("vertex_id").alias("target"), "vertex_id", "bin", "label")
    found = materialise(now, "on-route")
    jumps = mine.filter("edge_id IS NOT NULL").select(*LABEL, F.col("parent_vertex").alias("up_vertex"), F.col("parent_bin").alias("up_bin"), F.col("parent_label").alias("up_label"))
    deepest = found.join(mine, LABEL).agg(F.max("depth")).first()[0] or 0
    reach, most = 1, deepest if depth is None else min(depth - 1, deepest)
    while reach <= most:
        jumps = materialise(jumps, "jumps")
        above = found.join(jumps, LABEL).select("query_id", "target", F.col("up_vertex").alias("vertex_id"), F.col("up_bin").alias("bin"), F.col("up_label").alias("label"))
        found = materialise(found.unionByName(above), "on-route", found)
        up = jumps.select(F.col("query_id").alias("q"), F.col("vertex_id").alias("v"), F.col("bin").alias("b"), F.col("label").alias("l"), F.col("up_vertex").alias("v2"), F.col("up_bin").alias("b2"), F.col("up_label").alias("l2"))
        met = jumps.join(up, (F.col("query_id") == F.col("q")) & (F.col("up_vertex") == F.col("v")) & (F.col("up_bin") == F.col("b")) & (F.col("up_label") == F.col("l")))
        jumps = met.select(*LABEL, F.col("v2").alias("up_vertex"), F.col("b2").alias("up_bin"), F.col("l2").alias("up_label"))
        reach *= 2
    rows = materialise(found.join(mine.filter("edge_id IS NOT NULL"), LABEL), "routes")
    last = rows.groupBy("query_id", "target").agg(F.max("depth").alias("most"), F.count("*").alias("n"))
    if depth is not None:  # the doubling may have gone further up
        rows = rows.join(last.drop("n"), ["query_id", "target"]).filter(F.col("depth") > F.col("most") - depth).drop("most")
    elif not last.filter("n <> most").isEmpty():
        raise ValueError("the tree has a circle")
    if depth is not None or direction == "reverse":
        last = rows.groupBy("query_id", "target").agg(F.max("depth").alias("most"))
        rows = rows.join(last, ["query_id", "target"])
        pos = F.col("most") - F.col("depth") if direction == "reverse" else F.col("depth") - F.col("most") + (F.lit(depth) if depth is not None else F.col("most")) - 1
        if direction == "forward":
            least = rows.groupBy("query_id", "target").agg(F.min("depth").alias("least"))
            rows, pos = rows.join(least, ["query_id", "target"]), F.col("depth") - F.col("least")
    else:
        pos = F.col("depth") - 1
    ends = ("parent_vertex", "vertex_id") if direction == "forward" else ("vertex_id", "parent_vertex")
    return rows.select("query_id", "target", pos.cast("int").alias("pos"), "edge_list_id", "edge_id", F.col(ends[0]).alias("from_vertex"), F.col(ends[1]).alias("to_vertex"), "g", "objective_cost", "total_cost", "state")


def routes(tree: DataFrame, requests: DataFrame, direction: str = "forward") -> DataFrame:
    """The route of each request with a destination, as rows of edges, with route_idx 0."""
    targets = requests.filter("destination IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("destination").cast("long").alias("vertex_id"))
    return backtrack(tree, targets, direction=direction).drop("target").withColumn("route_idx", F.lit(0))


def edge_lists(rows: DataFrame) -> DataFrame:
    """query_id, route_idx, edges (array of edge ids in order), cost, total."""
    grouped = rows.groupBy("query_id", "route_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "edge_list_id", "edge_id"))).alias("e"), F.sum("objective_cost").alias("objective_cost"), F.sum("total_cost").alias("total_cost"))
    return grouped.select("query_id", "route_idx", F.transform("e", lambda x: x["edge_id"]).alias("edges"), F.transform("e", lambda x: x["edge_list_id"]).alias("edge_lists"), "objective_cost", "total_cost")


def has_loop(rows: DataFrame) -> DataFrame:
    """(query_id, route_idx, loop): whether two edges of a route start at one vertex."""
    return rows.groupBy("query_id", "route_idx").agg((F.count_distinct("from_vertex") < F.count("*")).alias("loop"))
