"""Alternative routes: Yen's k shortest, single-via paths, and when routes are alike."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.graph import Network
from wayfold.plans.paths import backtrack, routes
from wayfold.plans.scratch import materialise, spread
from wayfold.plans.search import Setup, trees


@dataclass(frozen=True)
class Similarity:
    """accept_all (nothing is alike), edge_id_cosine or distance_weighted_cosine, alike from ``threshold`` on."""

    kind: str = "accept_all"
    threshold: float = 1.0


def cosine(a: DataFrame, b: DataFrame, keys: list[str], weighted: bool = False) -> DataFrame:
    """keys + similarity between the edge sets of routes in ``a`` and ``b`` (keys, edge_list_id, edge_id, distance_m)."""
    w, none = (F.col("distance_m").cast("double") if weighted else F.lit(1.0)), F.lit(None).cast("double")
    one = lambda df, wa, wb: df.select(*keys, "edge_list_id", "edge_id", wa.alias("wa"), wb.alias("wb"))
    # One exchange, by the routes' keys: their edges and the routes themselves are put together in the same task.
    both = spread(one(a, w, none).unionByName(one(b, none, w)), *keys, tag="edge-sets")
    joined = both.groupBy(*keys, "edge_list_id", "edge_id").agg(F.first("wa", True).alias("wa"), F.first("wb", True).alias("wb"))
    wa, wb = F.coalesce("wa", F.lit(0.0)), F.coalesce("wb", F.lit(0.0))
    norm = F.sqrt(F.sum(wa * wa)) * F.sqrt(F.sum(wb * wb))
    return joined.groupBy(*keys).agg(F.coalesce(F.sum(wa * wb) / F.when(norm > 0, norm), F.lit(0.0)).alias("similarity"))


def same_route(a: Column, b: Column) -> Column:
    """Whether two arrays of edge ids are the same route."""
    return (F.size(a) == F.size(b)) & (a == b)


def _alike(a: list[tuple], b: list[tuple], kind: str) -> float:
    """Similarity of two routes of (edge list, edge, metres)."""
    weighted = kind == "distance_weighted_cosine"
    wa, wb = ({(e[0], e[1]): e[2] if weighted else 1.0 for e in r} for r in (a, b))
    dot = sum(w * wb.get(k, 0.0) for k, w in wa.items())
    norm = (sum(w * w for w in wa.values()) * sum(w * w for w in wb.values())) ** 0.5
    return dot / norm if norm else 0.0


def choose(candidates: DataFrame, k: int, similarity: Similarity, schema: str) -> DataFrame:
    """The first k routes of each request, in order, that are not like one chosen before. ``candidates``: query_id, rank,
    cost, edges (array of structs edge_list_id, edge_id, distance_m); a request's candidates are few and decided together."""
    kind, threshold = similarity.kind, similarity.threshold

    def pick(group):
        group = group.sort_values("rank")
        kept, rows = [], []
        for i, row in group.iterrows():
            edges = [(e["edge_list_id"], e["edge_id"], e["distance_m"]) for e in row["edges"]]
            if len(kept) < k and not any(edges == x or (kind != "accept_all" and _alike(edges, x, kind) >= threshold) for x in kept):
                kept.append(edges)
                rows.append(i)
        out = group.loc[rows].copy()
        out["route_idx"] = range(len(rows))
        return out

    return candidates.groupBy("query_id").applyInPandas(pick, schema)


#: Via-vertices of a request in one round: its candidates are decided together.
MOST_VIAS = 4096
CANDIDATE = "query_id long, rank int, cost double, edges array<struct<edge_list_id:int,edge_id:long,distance_m:double>>"


def single_via(network: Network, requests: DataFrame, setup: Setup, k: int = 3, similarity: Similarity = Similarity("edge_id_cosine", 0.8), candidates: int = 50) -> DataFrame:
    """Up to k routes of each request by way of a vertex, in order of cost: query_id, route_idx, cost, edges.

    Trees from the origin and to the destination meet in the via-vertices, which are taken by cost: the ``candidates`` cheapest
    first, then for requests that still lack routes twice as many a round (at most ``MOST_VIAS`` each), until none are left.
    Routes with a loop are left out, and the others are taken in order unless alike.
    """
    forward = trees(network, requests.withColumn("destination", F.lit(None).cast("long")), replace(setup, direction="forward"))
    back = trees(network, requests.select("query_id", F.col("destination").alias("origin"), F.lit(None).cast("long").alias("destination")), replace(setup, direction="reverse"))
    meet = forward.select("query_id", "vertex_id", F.col("g").alias("gf")).join(back.select("query_id", "vertex_id", F.col("g").alias("gb")), ["query_id", "vertex_id"])
    order = Window.partitionBy("query_id").orderBy("cost", "vertex_id")
    vias = materialise(meet.withColumn("cost", F.round(F.col("gf") + F.col("gb"), 9)).withColumn("rank", F.row_number().over(order)), "vias")
    lengths, columns = network.edges.select("edge_list_id", "edge_id", "distance_m"), ["query_id", "rank", "cost", "edges"]
    accepted, lacking, seen, size = None, vias.select("query_id").distinct(), 0, candidates
    while True:
        via = materialise(vias.filter((F.col("rank") > seen) & (F.col("rank") <= seen + size)).join(lacking, "query_id", "left_semi"), "via")
        if via.isEmpty():
            break
        first = backtrack(forward, via).withColumn("half", F.lit(0))
        second = backtrack(back, via, direction="reverse").withColumn("half", F.lit(1))
        rows = first.unionByName(second).join(lengths, ["edge_list_id", "edge_id"])
        whole = rows.groupBy("query_id", "target").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("half", "pos", "edge_list_id", "edge_id", "distance_m"))), lambda x: F.struct(x["edge_list_id"], x["edge_id"], x["distance_m"])).alias("edges"),
            (F.count_distinct("from_vertex") < F.count("*")).alias("loop"),
        )
        made = whole.filter("NOT loop").join(via, (whole["query_id"] == via["query_id"]) & (whole["target"] == via["vertex_id"])).select(whole["query_id"], F.col("rank").cast("int").alias("rank"), "cost", "edges")
        # Equal routes by way of several vertices are one candidate; what was accepted before comes first again.
        made = made.groupBy("query_id", "edges").agg(F.min(F.struct("rank", "cost")).alias("m")).select("query_id", "m.rank", "m.cost", "edges")
        pool = made if accepted is None else accepted.select(*columns).unionByName(made)
        accepted = materialise(choose(pool, k, similarity, f"{CANDIDATE}, route_idx int"), "accepted", accepted)
        full = accepted.groupBy("query_id").count().filter(F.col("count") >= k)
        lacking = lacking.join(full, "query_id", "left_anti")
        lacking = materialise(lacking, "lacking")
        seen, size = seen + size, min(2 * size, max(candidates, MOST_VIAS))
    empty = "query_id long, route_idx int, cost double, edges array<struct<edge_list_id:int,edge_id:long,distance_m:double>>"
    return requests.sparkSession.createDataFrame([], empty) if accepted is None else accepted.select("query_id", "route_idx", "cost", "edges")


@dataclass(frozen=True)
class KspLimit:
    """exact (until k routes), max_iteration (so many rounds), or factor (k times so many rounds)."""

    kind: str = "exact"
    value: int = 0

    def rounds(self, k: int) -> int:
        return {"exact": 1 << 30, "max_iteration": self.value, "factor": k * self.value}[self.kind]


def yens(network: Network, requests: DataFrame, setup: Setup, k: int = 3, similarity: Similarity = Similarity(), limit: KspLimit = KspLimit()) -> DataFrame:
    """Up to k loopless routes of each request in order of cost (ties by edge ids): query_id, route_idx, cost, edges.

    All requests go on together: a round cuts the accepted routes' next edges at every spur of the last accepted route, and
    answers all spurs of the batch in one search. Spurs without a way give nothing. With a similarity, a request goes on until
    k of its routes are not alike, no route is left, or the limit is reached. For models whose cost does not depend on the path.
    """
    if setup.history:
        raise ValueError("the costs depend on the path's history")
    keep = ["query_id", "pos", "edge_list_id", "edge_id", "from_vertex", "to_vertex", "objective_cost"]
    asked = materialise(requests.select("query_id", "origin", "destination").filter("destination IS NOT NULL"), "asked")
    route_of = lambda rows: rows.groupBy("query_id", "spur").agg(F.sort_array(F.collect_list(F.struct("pos", "edge_list_id", "edge_id", "from_vertex", "to_vertex", "objective_cost"))).alias("edges"), F.round(F.sum("objective_cost"), 9).alias("cost"))
    best = routes(trees(network, asked, setup, ways=True), asked).select(*keep).withColumn("spur", F.lit(0))
    accepted = materialise(route_of(best).select("query_id", F.lit(0).alias("route_idx"), "cost", "edges"), "accepted")
    length = network.edges.select("edge_list_id", "edge_id", "distance_m")

    def chosen() -> DataFrame:
        slim = accepted.select("query_id", F.col("route_idx").alias("rank"), "cost", "edges")
        rows = slim.select("query_id", "rank", "cost", F.posexplode("edges").alias("pos", "e")).select("query_id", "rank", "cost", "pos", "e.edge_list_id", "e.edge_id").join(length, ["edge_list_id", "edge_id"])
        full = rows.groupBy("query_id", "rank", "cost").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "edge_list_id", "edge_id", "distance_m"))), lambda x: F.struct(x["edge_list_id"], x["edge_id"], x["distance_m"])).alias("edges"))
        return choose(full.select("query_id", F.col("rank").cast("int").alias("rank"), "cost", "edges"), k, similarity, f"{CANDIDATE}, route_idx int").select("query_id", "route_idx", "cost", "edges")

    waiting, lacking, number = None, asked.select("query_id"), 0
    while number < limit.rounds(k) and (number < k - 1 or similarity.kind != "accept_all"):
        number += 1
        if number >= k:
            # k routes are there; only requests with alike ones among them go on.
            lacking = materialise(lacking.join(chosen().groupBy("query_id").count().filter(F.col("count") >= k), "query_id", "left_anti"), "lacking")
            if lacking.isEmpty():
                break
        last = accepted.filter(F.col("route_idx") == number - 1).join(lacking, "query_id", "left_semi")
        spurs = last.select("query_id", F.col("edges").alias("own"), F.posexplode("edges").alias("spur", "at")).select("query_id", "spur", F.col("at.from_vertex").alias("origin"), F.slice("own", F.lit(1), F.col("spur")).alias("root"))
        ids = lambda c: F.transform(c, lambda e: F.struct(e["edge_list_id"], e["edge_id"]))
        spurs = spurs.join(asked.select("query_id", "destination"), "query_id")
        # A number for each spur: rows of a written table, so that it stays the same.
        spurs = materialise(materialise(spurs, "spurs").withColumn("spur_id", F.monotonically_increasing_id()), "spurs")
        shared = spurs.join(accepted.select("query_id", F.col("edges").alias("other")), "query_id").filter(ids(F.slice("other", F.lit(1), F.col("spur"))) == ids("root"))
        cut_next = shared.filter(F.size("other") > F.col("spur")).select(F.col("spur_id").alias("query_id"), F.element_at("other", F.col("spur") + 1)["edge_list_id"].alias("edge_list_id"), F.element_at("other", F.col("spur") + 1)["edge_id"].alias("edge_id"))
        on_root = spurs.select("spur_id", F.explode("root").alias("e")).select(F.col("spur_id").alias("query_id"), F.col("e.from_vertex").alias("dst"))
        cut_root = on_root.join(network.edges.select("edge_list_id", "edge_id", "dst"), "dst").select("query_id", "edge_list_id", "edge_id")
        cut = materialise(cut_next.unionByName(cut_root).distinct(), "cut")
        tasks = spurs.select(F.col("spur_id").alias("query_id"), "origin", "destination")
        found = routes(trees(network, tasks, setup, cut, ways=True), tasks).select(*keep)
        tails = found.join(spurs.select("spur_id", F.col("query_id").alias("request"), "spur"), F.col("query_id") == F.col("spur_id")).select(F.col("request").alias("query_id"), "spur", (F.col("pos") + F.col("spur")).cast("int").alias("pos"), "edge_list_id", "edge_id", "from_vertex", "to_vertex", "objective_cost")
        heads = spurs.select("query_id", "spur", F.posexplode("root").alias("p", "e")).select("query_id", "spur", F.col("p").alias("pos"), "e.edge_list_id", "e.edge_id", "e.from_vertex", "e.to_vertex", "e.objective_cost")
        reached = tails.select("query_id", "spur").distinct()
        new = route_of(heads.join(reached, ["query_id", "spur"], "left_semi").unionByName(tails)).select("query_id", "cost", "edges")
        waiting = materialise((new if waiting is None else waiting.unionByName(new)).dropDuplicates(["query_id", "edges"]).join(accepted.select("query_id", "edges"), ["query_id", "edges"], "left_anti").select("query_id", "cost", "edges"), "waiting")
        order = Window.partitionBy("query_id").orderBy("cost", ids("edges"))
        took = waiting.join(lacking, "query_id", "left_semi").withColumn("rank", F.row_number().over(order)).filter("rank = 1").select("query_id", F.lit(number).alias("route_idx"), "cost", "edges")
        before = accepted
        accepted = materialise(before.unionByName(took), "accepted")
        if accepted.filter(F.col("route_idx") == number).isEmpty():
            break
    return chosen()


def with_end_edges(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds the origin and destination edges of edge-oriented requests around each route, at no cost and in the state there.

    ``requests``: query_id, origin, destination, origin_list, origin_edge, destination_list, destination_edge; an edge is null
    where that end is a vertex. A route of no edges between them is these edges alone; from an edge to itself there is nothing.
    """
    state = "state" in rows.columns
    kept = ["query_id", "route_idx", "pos", "edge_list_id", "edge_id", "objective_cost", "total_cost", *(["state"] if state else [])]
    span = rows.groupBy("query_id", "route_idx").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), *([F.min_by("state", "pos").alias("s_origin"), F.max_by("state", "pos").alias("s_destination")] if state else []))
    itself = F.col("origin_edge").eqNullSafe(F.col("destination_edge")) & F.col("origin_list").eqNullSafe(F.col("destination_list"))
    around = requests.filter(~itself).join(span, "query_id", "left").filter("lo IS NOT NULL OR origin = destination")
    end = lambda side, pos: around.filter(F.col(f"{side}_edge").isNotNull()).select("query_id", F.coalesce("route_idx", F.lit(0)).alias("route_idx"), pos.cast("int").alias("pos"), F.coalesce(f"{side}_list", F.lit(0)).cast("int").alias("edge_list_id"), F.col(f"{side}_edge").alias("edge_id"), F.lit(0.0).alias("objective_cost"), F.lit(0.0).alias("total_cost"), *([F.col(f"s_{side}").alias("state")] if state else []))
    return rows.select(*kept).unionByName(end("origin", F.coalesce(F.col("lo"), F.lit(0)) - 1)).unionByName(end("destination", F.coalesce(F.col("hi"), F.lit(-1)) + 1))


def between_end_edges(found: DataFrame, requests: DataFrame) -> DataFrame:
    """The same for alternative routes (query_id, route_idx, cost, edges as an array)."""
    one = lambda side: F.when(F.col(f"{side}_edge").isNotNull(), F.array(F.struct(F.coalesce(f"{side}_list", F.lit(0)).cast("int").alias("edge_list_id"), F.col(f"{side}_edge").alias("edge_id"), F.lit(0.0).alias("distance_m")))).otherwise(F.array().cast("array<struct<edge_list_id:int,edge_id:bigint,distance_m:double>>"))
    ends = requests.select("query_id", one("origin").alias("first"), one("destination").alias("last"))
    return found.join(ends, "query_id").select("query_id", "route_idx", "cost", F.concat("first", "edges", "last").alias("edges"))


def edge_oriented(network: Network, requests: DataFrame) -> DataFrame:
    """Requests from edge to edge as requests from vertex to vertex: from the first edge's end to the last edge's start.

    ``requests``: query_id, origin_list, origin_edge, destination_list, destination_edge (null for a tree). From an edge to
    itself there is nothing to do: origin and destination are the same vertex.
    """
    e = network.edges.select("edge_list_id", "edge_id", "src", "dst")
    first = e.select(F.col("edge_list_id").alias("origin_list"), F.col("edge_id").alias("origin_edge"), F.col("dst").alias("origin"))
    last = e.select(F.col("edge_list_id").alias("destination_list"), F.col("edge_id").alias("destination_edge"), F.col("src").alias("destination"))
    out = requests.join(first, ["origin_list", "origin_edge"]).join(last, ["destination_list", "destination_edge"], "left")
    same = (F.col("origin_list") == F.col("destination_list")) & (F.col("origin_edge") == F.col("destination_edge"))
    return out.withColumn("destination", F.when(same, F.col("origin")).otherwise(F.col("destination"))).select("query_id", "origin", "destination", "origin_list", "origin_edge", "destination_list", "destination_edge")
