"""Road networks as two DataFrames, and what can be asked of them.

vertices: vertex_id long, x float, y float. edges: edge_list_id int, edge_id long, src long, dst long, distance_m double, and
any number of attribute columns joined on (edge_list_id, edge_id).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geo import LINE
from wayfold.plans.scratch import materialise, scratch_dir, written

KEY = ["edge_list_id", "edge_id"]


class NetworkError(ValueError):
    """A network whose parts do not fit together."""


@dataclass
class Network:
    vertices: DataFrame
    edges: DataFrame
    turn_restrictions: DataFrame | None = None
    notes: dict = field(default_factory=dict)

    # -- checks and attributes ------------------------------------------------------------------------------------------
    def bad_references(self) -> DataFrame:
        """Edges whose end is no vertex: edge_list_id, edge_id, side, vertex_id."""
        ends = self.edges.select(*KEY, F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("vertex_id")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("vertex_id")))).alias("e")).select(*KEY, "e.side", "e.vertex_id")
        return ends.join(self.vertices.select("vertex_id"), "vertex_id", "left_anti").select(*KEY, "side", "vertex_id")

    def validated(self) -> Network:
        """The network itself; an error that names the first five bad references if there are any."""
        bad = self.bad_references().orderBy(*KEY, "side").limit(5).collect()
        if bad:
            raise NetworkError("edges without a vertex: " + ", ".join(f"list {r['edge_list_id']} edge {r['edge_id']} {r['side']} {r['vertex_id']}" for r in bad))
        return self

    def dense(self, rows: DataFrame, key: str) -> bool:
        """Whether ids run from 0 to n-1, as files that are aligned by line need."""
        r = rows.agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.count_distinct(key).alias("d")).first()
        return r["n"] == 0 or (r["lo"] == 0 and r["hi"] == r["n"] - 1 and r["d"] == r["n"])

    def with_attribute(self, table: DataFrame, name: str, edge_list_id: int | None = None, required: bool = True) -> Network:
        """Joins a table of (edge_id[, edge_list_id], value...) to the edges; a missing edge is an error if ``required``."""
        keys = KEY if "edge_list_id" in table.columns else ["edge_id"]
        side = table.withColumnRenamed("value", name) if "value" in table.columns else table
        joined = self.edges.join(side, keys, "left")
        if required:
            test = F.col(name).isNull()
            if edge_list_id is not None:
                test = test & (F.col("edge_list_id") == edge_list_id)
            missing = joined.filter(test).select(*KEY).limit(1).collect()
            if missing:
                raise NetworkError(f"no {name} for edge {missing[0]['edge_id']} of list {missing[0]['edge_list_id']}")
        return Network(self.vertices, joined, self.turn_restrictions, self.notes)

    def cached(self, buckets: int | None = None) -> Network:
        """The wide edges, with both ends' places, written once.

        With ``buckets`` they are a table bucketed by ``src``: a search's rounds then join them without an exchange of edges.
        """
        wide = self.wide_edges()
        if buckets is None:
            if wide is self.edges and written(wide):
                return self
            return Network(self.vertices, materialise(wide, "edges"), self.turn_restrictions, self.notes)
        spark, name = wide.sparkSession, f"wayfold_edges_{uuid.uuid4().hex}"
        wide.repartition(buckets, "src").write.bucketBy(buckets, "src").sortBy("src").option("path", f"{scratch_dir(spark)}/wayfold/{name}").saveAsTable(name)
        return Network(self.vertices, spark.table(name), self.turn_restrictions, self.notes)

    def wide_edges(self) -> DataFrame:
        if "src_x" in self.edges.columns:
            return self.edges
        end = lambda side: self.vertices.select(F.col("vertex_id").alias(side), F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y"))
        return self.edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")

    # -- lookups --------------------------------------------------------------------------------------------------------
    def edge(self, edge_list_id: int, edge_id: int) -> DataFrame:
        return self.edges.filter((F.col("edge_list_id") == edge_list_id) & (F.col("edge_id") == edge_id))

    def vertex(self, vertex_id: int) -> DataFrame:
        return self.vertices.filter(F.col("vertex_id") == vertex_id)

    def require_edge(self, edge_list_id: int, edge_id: int):
        row = self.edge(edge_list_id, edge_id).first()
        if row is None:
            raise NetworkError(f"no edge {edge_id} in list {edge_list_id}")
        return row

    def require_vertex(self, vertex_id: int):
        row = self.vertex(vertex_id).first()
        if row is None:
            raise NetworkError(f"no vertex {vertex_id}")
        return row

    def counts(self) -> DataFrame:
        """n_vertices, n_edges, n_edge_lists in one row."""
        edges = self.edges.agg(F.count("*").alias("n_edges"), F.count_distinct("edge_list_id").alias("n_edge_lists"))
        return self.vertices.agg(F.count("*").alias("n_vertices")).join(F.broadcast(edges))

    def edge_ids(self) -> DataFrame:
        return self.edges.select(*KEY)

    def vertex_ids(self) -> DataFrame:
        return self.vertices.select("vertex_id")

    def incident(self, vertices: DataFrame, direction: str = "forward") -> DataFrame:
        """Edges out of (forward) or into (reverse) each of the vertices (vertex_id), with the vertex they lead to."""
        near, far = ("src", "dst") if direction == "forward" else ("dst", "src")
        return vertices.select(F.col("vertex_id").alias("at")).join(self.edges, F.col("at") == F.col(near)).select(F.col("at").alias("vertex_id"), *KEY, F.col(far).alias("adjacent"), "distance_m")

    def out_edges(self, vertices: DataFrame) -> DataFrame:
        return self.incident(vertices, "forward")

    def in_edges(self, vertices: DataFrame) -> DataFrame:
        return self.incident(vertices, "reverse")

    def endpoints(self) -> DataFrame:
        return self.edges.select(*KEY, "src", "dst")

    def triplets(self) -> DataFrame:
        """Each edge with the places of both ends."""
        return self.wide_edges().select(*KEY, "src", "src_x", "src_y", "dst", "dst_x", "dst_y", "distance_m")

    def incident_triplets(self, vertices: DataFrame, direction: str = "forward") -> DataFrame:
        return self.incident(vertices, direction).select("vertex_id", *KEY).join(self.triplets(), KEY)

    def degrees(self) -> DataFrame:
        """vertex_id, out_degree, in_degree for every vertex."""
        out = self.edges.groupBy(F.col("src").alias("vertex_id")).agg(F.count("*").alias("out_degree"))
        into = self.edges.groupBy(F.col("dst").alias("vertex_id")).agg(F.count("*").alias("in_degree"))
        return self.vertices.select("vertex_id").join(out, "vertex_id", "left").join(into, "vertex_id", "left").na.fill(0, ["out_degree", "in_degree"])

    def straight_lines(self) -> DataFrame:
        """A two-point line for each edge."""
        point = lambda side: F.struct(F.col(f"{side}_x").cast("float").alias("x"), F.col(f"{side}_y").cast("float").alias("y"))
        return self.wide_edges().select(*KEY, F.array(point("src"), point("dst")).cast(LINE).alias("line"))


def strong_components(network: Network, rounds: int = 200) -> DataFrame:
    """(vertex_id, component): vertices that reach each other, named by the smallest of them.

    Forward colours (the least vertex that reaches a vertex) are spread first; within a colour, what reaches its root
    backward is one component and leaves. Vertices without an edge in or out of what is left leave at once.
    """
    left = materialise(network.vertices.select("vertex_id"), "scc")
    edges = materialise(network.edges.select("src", "dst").filter("src <> dst").distinct(), "scc-edges")
    done = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        if edges.isEmpty():
            alone = left.select("vertex_id", F.col("vertex_id").alias("component"))
            done = alone if done is None else done.unionByName(alone)
            break
        colours = _spread(left.select("vertex_id", F.col("vertex_id").alias("colour")), edges)
        colour = lambda side, name: colours.select(F.col("vertex_id").alias(side), F.col("colour").alias(name))
        inside = materialise(edges.join(colour("src", "cs"), "src").join(colour("dst", "cd"), "dst").filter("cs = cd").select("src", "dst"), "scc-inside")
        reached = _reach_back(colours.filter("vertex_id = colour"), colours, inside)
        found = reached.select("vertex_id", F.col("colour").alias("component"))
        done = found if done is None else done.unionByName(found)
        left = materialise(left.join(reached, "vertex_id", "left_anti"), "scc")
        gone = reached.select("vertex_id")
        edges = materialise(inside.join(gone.withColumnRenamed("vertex_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("vertex_id", "dst"), "dst", "left_anti"), "scc-edges")
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    if done is None:
        done = network.vertices.select("vertex_id", F.col("vertex_id").alias("component")).limit(0)
    least = done.groupBy("component").agg(F.min("vertex_id").alias("name"))
    return done.join(least, "component").select("vertex_id", F.col("name").alias("component"))


def _spread(colours: DataFrame, edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """The least colour that reaches each vertex. Only what changed goes on to the next round."""
    colours = materialise(colours.withColumn("fresh", F.lit(True)), "colours")
    for _ in range(rounds):
        sent = colours.filter("fresh").join(edges, F.col("vertex_id") == F.col("src")).groupBy("dst").agg(F.min("colour").alias("got"))
        colours = materialise(colours.join(sent, F.col("vertex_id") == F.col("dst"), "left").select("vertex_id", F.least("colour", F.coalesce("got", "colour")).alias("colour"), F.coalesce(F.col("got") < F.col("colour"), F.lit(False)).alias("fresh")), "colours", colours)
        if colours.filter("fresh").isEmpty():
            return colours.select("vertex_id", "colour")
    raise RuntimeError("colours did not settle")


def _reach_back(roots: DataFrame, colours: DataFrame, inside: DataFrame, rounds: int = 10_000) -> DataFrame:
    """What reaches its colour's root over edges within the colour, with the colour."""
    reached = materialise(roots.select("vertex_id", "colour"), "reached")
    fresh = reached
    for _ in range(rounds):
        back = inside.join(fresh, F.col("dst") == F.col("vertex_id")).select(F.col("src").alias("vertex_id"), "colour").distinct()
        fresh = materialise(back.join(reached, "vertex_id", "left_anti"), "fresh")
        if fresh.isEmpty():
            return reached
        reached = materialise(reached.unionByName(fresh), "reached", reached)
    raise RuntimeError("reachability did not settle")


def largest_component(components: DataFrame) -> DataFrame:
    """The vertices of the largest component; of equal ones that with the smallest name."""
    best = components.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return components.join(F.broadcast(best.select("component")), "component").select("vertex_id", "component")
