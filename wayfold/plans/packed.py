"""The relational search's labels, worked out in tasks over packed arrays of all edges.

The steps of a search are numbered once: a table of blocks, each with the steps out of some labels as bytes. Some tasks get a
copy of all blocks by a shuffle and share the requests; each request is then rounds over arrays, with the same labels, ties and
bounds as the relational rounds. Where the arrays would be larger than ``ARRAY_BYTES``, or a label is more than a vertex and a
heading, there is no answer here and the relational rounds are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.plans.scratch import discard, materialise

#: Bytes of arrays that a task may hold.
ARRAY_BYTES = 640 << 20
#: Steps that all copies together may have; there is one copy at least.
COPIED = 128_000_000
#: Steps in a block.
BLOCK = 500_000
#: Steps looked at in one go.
CHUNK = 1 << 22
#: Requests up to which they are dealt in turn.
IN_TURN = 100_000


class Graph:
    """Steps by the label they leave from: those of label ``i`` are from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, to: np.ndarray, costs: list, lists, edges):
        only = _absent(keys, to)
        self.keys = np.concatenate([keys, only])
        self.counts = np.concatenate([counts, np.zeros(len(only), dtype=np.int64)])
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.order = np.argsort(self.keys, kind="stable")
        self.sorted = self.keys[self.order]
        self.to = np.empty(len(to), dtype=np.int32)
        table = _table(self.keys)
        for at in range(0, len(to), CHUNK):
            part = to[at : at + CHUNK]
            self.to[at : at + CHUNK] = self.at(part) if table is None else table[part]
        self.costs, self.lists, self.edges = costs, lists, edges

    def at(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys, -1 for those that are no label here."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        near = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return np.where(self.sorted[near] == keys, self.order[near], -1)

    def cost(self, weights: list | None) -> np.ndarray:
        """What each step costs, infinite where it may not be taken."""
        if weights is None:
            return self.costs[0]
        made = np.zeros(len(self.to))
        for part, weight in zip(self.costs, weights, strict=True):
            if weight is not None:
                made += part * weight
        made[~(made < np.inf)] = np.inf
        return made

    def steps(self, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(labels, how many steps each has, the steps), not many at once."""
        ends = np.cumsum(self.counts[labels])
        if len(ends) and ends[-1]:
            cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(CHUNK, ends[-1], CHUNK)), [len(labels)]]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = labels[lo:hi]
                n = self.counts[part]
                upto = np.cumsum(n)
                yield part, n, np.repeat(self.first[part] - (upto - n), n) + np.arange(upto[-1])


def _table(keys: np.ndarray) -> np.ndarray | None:
    """Numbers by key, if keys are dense enough."""
    if not len(keys) or keys.min() < 0 or keys.max() > 8 * len(keys) + 1024:
        return None
    table = np.full(int(keys.max()) + 1, -1, dtype=np.int32)
    table[keys] = np.arange(len(keys), dtype=np.int32)
    return table


def _absent(keys: np.ndarray, to: np.ndarray) -> np.ndarray:
    """What is in ``to`` and not in ``keys``."""
    found = [np.unique(to[at : at + CHUNK]) for at in range(0, len(to), CHUNK)]
    return np.setdiff1d(np.concatenate(found), keys) if found else np.zeros(0, dtype=np.int64)


def labelled(graph: Graph, cost: np.ndarray, origin: int, goals: np.ndarray | None, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """(least cost, the round that found it) by label; ``near``: what costs more than a way to the goal may be left out."""
    n = len(graph.keys)
    g, new, number = np.full(n, np.inf), np.full(n, np.inf), 0
    rounds = np.zeros(n, dtype=np.int32)
    g[origin] = 0.0
    front = np.array([origin])
    while len(front):
        number += 1
        bound = g[goals].min() if goals is not None and len(goals) else np.inf
        # A label that costs as much as a way already found leads nowhere better.
        front = front[g[front] < bound] if bound < np.inf else front
        met, count = [], 0
        for part, n_steps, at in graph.steps(front):
            reached, to = np.repeat(g[part], n_steps) + cost[at], graph.to[at].astype(np.int64)
            better = reached < g[to]
            if near and bound < np.inf:
                better &= reached <= bound
            to = to[better]
            np.minimum.at(new, to, reached[better])
            met.append(to)
            count += len(to)
        if not count:
            break
        front = np.flatnonzero(new < np.inf) if count > n // 16 else np.unique(np.concatenate(met))
        g[front], rounds[front], new[front] = new[front], number, np.inf
    return g, rounds


def explained(graph: Graph, cost: np.ndarray, origin: int, g: np.ndarray, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, step, depth) by label: the least step that explains each cost; -1 where there is none, depth 0 at the root."""
    found, froms, tos = [], [], []
    for part, n_steps, at in graph.steps(np.flatnonzero(g < np.inf)):
        frm, to = np.repeat(part, n_steps), graph.to[at].astype(np.int64)
        # Along (cost, round) a parent is always less, so that steps that cost next to nothing cannot run in a circle.
        fits = (g[frm] + cost[at] == g[to]) & (g[to] < np.inf) & (rounds[to] > 0) & ((g[frm] < g[to]) | (rounds[frm] < rounds[to]))
        found.append(at[fits])
        froms.append(frm[fits])
        tos.append(to[fits])
    parent, step, depth = (np.full(len(g), -1, dtype=np.int64) for _ in range(3))
    depth[origin] = 0
    if not found:
        return parent, step, depth
    at, frm, to = np.concatenate(found), np.concatenate(froms), np.concatenate(tos)
    order = np.lexsort((graph.keys[frm], graph.edges[at], *([] if np.isscalar(graph.lists) else [graph.lists[at]]), to))
    order = order[np.concatenate([[True], to[order][1:] != to[order][:-1]])] if len(order) else order
    parent[to[order]], step[to[order]] = frm[order], at[order]
    kids = to[order][np.argsort(frm[order], kind="stable")]
    ups, level = parent[kids], np.array([origin])
    while len(level):
        lo, hi = np.searchsorted(ups, level), np.searchsorted(ups, level, side="right")
        n = hi - lo
        upto = np.cumsum(n)
        below = kids[np.repeat(lo - (upto - n), n) + np.arange(upto[-1])]
        depth[below] = np.repeat(depth[level], n) + 1
        level = below
    return parent, step, depth


def _answer(graph: Graph, request: dict, span: int, least: int, explain: bool, ways: bool) -> pa.RecordBatch:
    """A request's labels as rows."""
    names = ["query_id", "key", "g", "depth", *(["edge_list_id", "edge_id", "parent_key"] if explain else [])]

    def rows(key, g, depth, lists=None, edges=None, parents=None) -> pa.RecordBatch:
        n = len(key)
        columns = [pa.array(np.full(n, request["query_id"], dtype=np.int64)), pa.array(key), pa.array(g), pa.array(depth.astype(np.int32))]
        if explain:
            columns += [pa.array(c.astype(kind), mask=depth == 0) for c, kind in ((lists, np.int32), (edges, np.int64), (parents, np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    origin = int(graph.at(np.array([request["origin_key"]]))[0])
    if origin < 0:
        one = np.zeros(1, dtype=np.int64)
        return rows(np.array([request["origin_key"]]), np.zeros(1), one, one, one, one)
    goals = None
    if request["destination"] is not None:
        goals = np.flatnonzero(graph.keys // span == request["destination"] - least)
    cost, cut = graph.cost(request["weights"]), []
    for key, in_list, edge in request["cut"] or []:
        label = int(graph.at(np.array([key]))[0])
        if label >= 0:
            lo, hi = graph.first[label], graph.first[label + 1]
            same = graph.edges[lo:hi] == edge
            if not np.isscalar(graph.lists):
                same &= graph.lists[lo:hi] == in_list
            cut += (lo + np.flatnonzero(same)).tolist()
    saved = cost[cut]
    cost[cut] = np.inf
    g, rounds = labelled(graph, cost, origin, goals, ways)
    if not explain:
        at = np.flatnonzero(g < np.inf)
        return rows(graph.keys[at], g[at], np.zeros(len(at)))
    parent, step, depth = explained(graph, cost, origin, g, rounds)
    cost[cut] = saved
    if ways and goals is not None:
        on, now = np.zeros(len(g), dtype=bool), goals[depth[goals] > 0]
        on[origin] = True
        while len(now):
            on[now] = True
            now = np.unique(parent[now])
            now = now[~on[now]]
        at = np.flatnonzero(on)
    else:
        at = np.flatnonzero(depth >= 0)
    lists = np.full(len(at), graph.lists) if np.isscalar(graph.lists) else graph.lists[step[at]] if len(graph.lists) else step[at]
    edges = graph.edges[step[at]] if len(graph.edges) else step[at]
    return rows(graph.keys[at], g[at], depth[at], lists, edges, graph.keys[parent[at]])


def _ways_to_deal(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` a number that a shuffle by it brings there."""
    where = F.pmod(F.hash("id"), F.lit(parts))
    found, most = [], 64 * parts
    while len(found) < parts:
        found = spark.range(0, most, 1, 1).groupBy(where.alias("part")).agg(F.min("id").alias("id")).orderBy("part").collect()
        most *= 2
    return [r["id"] for r in found]


def searched(steps, vertices: DataFrame, requests: DataFrame, cut: DataFrame | None, explain: bool, ways: bool) -> DataFrame | None:
    """(query_id, vertex_id, came_heading if steps have it, g, depth, and if ``explain`` key, parent_key, edge_list_id, edge_id,
    parent_vertex and p_came_heading) of every label, or None if the arrays would be too large. ``ways``: of requests with a destination only the
    labels on the best ways to it."""
    spark, turning = requests.sparkSession, steps.turning
    if steps.setup.turns:
        return None
    edges = steps.edges if steps.test is None or turning else steps.edges.filter(steps.test)
    asked = requests.select(F.col("query_id").cast("long").alias("query_id"), F.col("origin").cast("long").alias("vertex_id"), F.col("destination").cast("long").alias("destination"), *(["weights"] if steps.weights else []))
    asked = materialise(asked.join(vertices.select("vertex_id"), "vertex_id", "left_semi"), "asked")
    least, span, h0 = 0, 1, 0
    rows = edges
    if turning:
        heads = steps.named(edges)
        ends = edges.select(F.col(steps.near).alias("n"), *heads)
        seen = ends.agg(F.min(F.least("n", "vertex_id")).alias("v0"), F.max(F.greatest("n", "vertex_id")).alias("v1"), F.min("came_heading").alias("h0"), F.max("came_heading").alias("h1")).first()
        own = asked.agg(F.min("vertex_id").alias("v0"), F.max("vertex_id").alias("v1")).first()
        lo, hi = ([x for x in (seen[c], own[c]) if x is not None] for c in ("v0", "v1"))
        if not lo:
            return None
        least, h0 = min(lo), seen["h0"] or 0
        span = (seen["h1"] or 0) - h0 + 2
        if (max(hi) - least + 1) * span >= 1 << 62:
            return None
        labels = ends.select("vertex_id", "came_heading").unionByName(asked.select("vertex_id", F.lit(None).cast("int").alias("came_heading"))).distinct()
        labels = materialise(labels.withColumnRenamed("vertex_id", "from_vertex"), "from-labels")
        per = labels.groupBy("from_vertex").agg(F.count("*").alias("a")).join(edges.groupBy(F.col(steps.near).alias("from_vertex")).agg(F.count("*").alias("b")), "from_vertex")
        if (per.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0) * 12 > ARRAY_BYTES:
            return None
        rows = labels.join(edges, F.col("from_vertex") == F.col(steps.near))
        rows = rows if steps.test is None else rows.filter(steps.test)
    key = lambda vertex, heading: (F.col(vertex).cast("long") - F.lit(least)) * F.lit(span) + F.coalesce(heading - F.lit(h0) + 1, F.lit(0)) if turning else F.col(vertex).cast("long")
    to = steps.named(rows)
    none = F.lit(None).cast("int")
    costs = [c.cast("double") for c in steps.parts] if steps.weights else [steps.objective.cast("double")]
    names = [f"c{i}" for i in range(len(costs))]
    ids = [F.col("edge_list_id").cast("int").alias("list"), F.col("edge_id").cast("long").alias("edge")] if explain or cut is not None else []
    # A missing cost is a step that may not be taken.
    all_steps = rows.select(key(steps.near, F.col("came_heading") if turning else none).alias("f"), key(steps.far, to[-1] if turning else none).alias("t"), *(F.coalesce(c, F.lit(float("nan"))).alias(x) for c, x in zip(costs, names, strict=True)), *ids)
    if not steps.weights:
        all_steps = all_steps.filter("c0 < double('Infinity')")
    told = all_steps.agg(F.count("*").alias("n"), *(F.min(x).alias(f"lo_{x}") for x in names), *(F.max(x).alias(f"hi_{x}") for x in names), *([F.min("list").alias("lo_list"), F.max("list").alias("hi_list")] if ids else [])).first()
    n = told["n"]
    # What is the same for all steps is not copied.
    same = {x: told[f"lo_{x}"] for x in [*names, *(["list"] if ids else [])] if steps.weights + (x == "list") and n and told[f"lo_{x}"] == told[f"hi_{x}"]}
    sent = [x for x in [*names, *(["list", "edge"] if ids else [])] if x not in same]
    width = {**dict.fromkeys(names, 8), "list": 4, "edge": 8}
    if n * (4 + sum(width[x] for x in sent) + (8 if steps.weights else 0)) > ARRAY_BYTES:
        return None
    kinds = {**dict.fromkeys(names, np.float64), "list": np.int32, "edge": np.int64}
    binary = ["keys", "counts", "to", *sent]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = [b for b in batches if b.num_rows]
        if taken:
            table = pa.Table.from_batches(taken)
            column = lambda x: table.column(x).to_numpy()
            f = column("f")
            order = np.argsort(f, kind="stable")
            keys, counts = np.unique(f, return_counts=True)
            made = [keys, counts.astype(np.int64), column("t")[order], *(column(x).astype(kinds[x])[order] for x in sent)]
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()) for m in made], names=binary)

    columns = ["f", "t", *sent]
    parts = max(spark.sparkContext.defaultParallelism, -(-n // BLOCK)) if n > BLOCK else 1
    blocks = materialise(all_steps.select(*columns).repartition(parts, "f").mapInArrow(pack, ", ".join(f"{x} binary" for x in binary)), "packed")
    n_asked = asked.count()
    slots = max(1, min(n_asked, spark.sparkContext.defaultParallelism, COPIED // max(n, 1)))
    to_slot = F.array(*[F.lit(x).cast("long") for x in _ways_to_deal(spark, slots)])
    turn = F.row_number().over(Window.orderBy("query_id")) if n_asked <= IN_TURN else F.pmod(F.xxhash64("query_id"), F.lit(slots))
    weights = F.array(*[F.try_element_at(F.col("weights"), F.lit(x)) for x in steps.part_names]) if steps.weights else F.lit(None).cast("array<double>")
    if cut is None:
        cuts = asked.select("query_id").limit(0).withColumn("cut", F.lit(None).cast("array<struct<k:bigint,l:int,e:bigint>>"))
    else:
        places = cut.join(steps.edges.select("edge_list_id", "edge_id", steps.near), ["edge_list_id", "edge_id"])
        if turning:  # a step is cut from whatever heading its vertex was reached
            places = places.join(labels, F.col(steps.near) == F.col("from_vertex"))
        at = key(steps.near, F.col("came_heading") if turning else none)
        cuts = places.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.collect_set(F.struct(at.alias("k"), F.col("edge_list_id").cast("int").alias("l"), F.col("edge_id").cast("long").alias("e"))).alias("cut"))
    wanted = asked.join(cuts, "query_id", "left").select(
        F.element_at(to_slot, (F.pmod(turn, F.lit(slots)) + 1).cast("int")).alias("slot"), "query_id", "destination", key("vertex_id", none).alias("origin_key"), weights.alias("weights"), "cut", *(F.lit(None).cast("binary").alias(x) for x in binary)
    )
    empty = [F.lit(None).cast(t).alias(c) for c, t in wanted.dtypes[1:6]]
    copies = blocks.select(F.explode(to_slot).alias("slot"), *empty, *binary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, mine, filled, slot = [], [], [], 0, set()
        arrays = {x: np.empty(n, dtype=kinds[x]) for x in sent}
        to = np.empty(n, dtype=np.int64)
        for batch in batches:
            slot.update(batch.column("slot").unique().to_pylist())
            asks = batch.filter(pc.is_valid(batch.column("query_id")))
            mine += asks.select(["query_id", "destination", "origin_key", "weights", "cut"]).to_pylist()
            blocks = [batch.column(x) for x in binary]
            for i in np.flatnonzero(batch.column("keys").is_valid().to_numpy(zero_copy_only=False)).tolist():
                cells = [np.frombuffer(c[i].as_buffer(), dtype=k) for c, k in zip(blocks, [np.int64, np.int64, np.int64, *(kinds[x] for x in sent)], strict=True)]
                keys.append(cells[0].copy())
                counts.append(cells[1].copy())
                upto = filled + len(cells[2])
                to[filled:upto] = cells[2]
                for x, cell in zip(sent, cells[3:], strict=True):
                    arrays[x][filled:upto] = cell
                filled = upto
        if not mine:
            return
        if len(slot) != 1 or filled != n:
            raise RuntimeError(f"{filled} of {n} steps for {len(slot)} shares of the requests")
        none = np.zeros(0, dtype=np.int64)
        graph = Graph(np.concatenate([none, *keys]), np.concatenate([none, *counts]), to, [arrays.get(x, same.get(x)) for x in names], arrays.get("list", same.get("list")), arrays.get("edge"))
        del to
        for request in mine:
            request["cut"] = [(c["k"], c["l"], c["e"]) for c in request["cut"] or []]
            yield _answer(graph, request, span, least, explain, ways)

    schema = "query_id long, key long, g double, depth int" + (", edge_list_id int, edge_id long, parent_key long" if explain else "")
    spread = copies.unionByName(wanted).repartition(slots, "slot")
    made = materialise(spread.mapInArrow(run, schema), "searched")
    discard(blocks)
    vertex = lambda k: (F.expr(f"({k} - pmod({k}, {span}L)) div {span}L") + F.lit(least)).cast("long")

    def heading(k: str) -> Column:
        h = F.pmod(F.col(k), F.lit(span))
        return F.when(h > 0, (h - 1 + F.lit(h0)).cast("int"))

    out = [F.col("query_id"), vertex("key").alias("vertex_id"), *([heading("key").alias("came_heading")] if turning else []), F.col("g"), F.col("depth")]
    if explain:
        out += [F.col("key"), F.col("parent_key"), F.col("edge_list_id"), F.col("edge_id"), vertex("parent_key").alias("parent_vertex"), *([heading("parent_key").alias("p_came_heading")] if turning else [])]
    return made.select(*out)


def summed(tree: DataFrame, features: list[str], sums: dict[str, tuple[bool, float]]) -> DataFrame:
    """The tree (rows with key, parent_key, way and the state of their own edge alone) with depths and states from the root on.

    ``sums``: for each accumulated feature whether the least counts, and what it starts from.
    """
    names = {f: f"sum_{i}" for i, f in enumerate(features)}
    flat = tree.withColumns({names[f]: F.col(f"state.`{f}`") for f in features}).drop("state")  # no type within a type: those tell what may be null

    def add(rows: pa.Table) -> pa.Table:
        key, way = rows["key"].to_numpy(), rows["way"].to_numpy()
        order = np.argsort(key, kind="stable")
        up = order[np.minimum(np.searchsorted(key[order], pc.fill_null(rows["parent_key"], 0).to_numpy()), len(key) - 1)]
        by_way = np.argsort(way, kind="stable")
        first = np.searchsorted(way[by_way], np.arange(way.max() + 2))
        for f, (least, start) in sums.items():
            s = rows[names[f]].to_numpy().copy()
            for lo, hi in zip(first[1:-1], first[2:], strict=True):
                at = by_way[lo:hi]
                s[at] = np.minimum(s[at], s[up[at]]) if least else s[at] + s[up[at]] - start
            rows = rows.set_column(rows.column_names.index(names[f]), names[f], pa.array(s, pa.float64(), from_pandas=True))
        return rows

    made = flat.groupBy("query_id").applyInArrow(add, flat.schema) if sums else flat
    state = F.struct(*[F.col(names[f]).alias(f) for f in features])
    columns = [c for c in tree.columns if c not in ("key", "parent_key", "way", "depth", "state")]
    return made.select(*columns, F.col("way").alias("depth"), state.alias("state"))
