"""Searches: what is asked (``Setup``), and how it is answered.

* ``relax``: one plan for all requests of a batch, each with weights of its own if it has a column of them. What a step costs
  follows from its edge, and for turns from the edge before it; so a round joins the frontier with the edges and keeps the
  least sum for each label, in numbers alone. Only labels that got better are written, and only they go on. When nothing gets
  better, each label's last edge is the one that explains its cost, and depths and states are added up along the tree by
  pointer doubling, in as many joins as the depth has binary digits.
  Where the edges fit into a task as packed arrays and no limit ends the search, the rounds are taken over these (``packed``).
* ``kernel``: label-setting search for one request in a task, over arrays of the network that reach the task by a shuffle. It
  settles labels in order of cost, which is what searches are defined by whose state is cut off (batteries, charging).

``search`` takes the kernel where the state is cut off, else the relational search. ``answered`` also tells which requests
ended early without a route.
"""

from __future__ import annotations

import copy
import functools
import heapq
import math
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.constraints import Combined, Constraint, TurnRestriction
from wayfold.operators.cost import CostModel
from wayfold.operators.graph import Network
from wayfold.operators.labels import VertexLabel
from wayfold.operators.models import Columns, Feature, Numbers, TraversalModel, features_of, ordered, step
from wayfold.plans.packed import searched, summed
from wayfold.plans.scratch import materialise

#: Bytes of edge arrays that one kernel may hold.
KERNEL_BYTES = 512 << 20
#: Bytes of edge arrays from which on kernels get only the edges that their requests can reach.
WHOLE_BYTES = 64 << 20
#: Bytes that a label takes in a search, for limits on memory.
LABEL_BYTES = 128
#: Labels of a request up to which its tree is added up in one task.
SUMMED = 4_000_000
#: Rounds after which a search's labels are written as one table.
COMPACT = 4


class SearchError(RuntimeError):
    """A search that could not be carried out."""


@dataclass
class Limits:
    """When a search ends early. None: never. ``strict``: ending early is an error for requests with a destination that have no
    route yet. ``every``: the clock is looked at after so many labels of a request only, so that small searches do not depend on
    how fast the machine is."""

    rounds: int | None = None
    labels: int | None = None
    seconds: float | None = None
    strict: bool = True
    every: int = 1

    @classmethod
    def of(cls, spec: dict) -> Limits:
        """From configuration: type iterations, solution_size, query_runtime (HH:MM:SS), memory or combined."""
        kind = spec["type"]
        if kind == "iterations":
            return cls(rounds=int(spec["limit"]))
        if kind == "solution_size":
            return cls(labels=int(spec["limit"]))
        if kind == "query_runtime":
            h, m, s = spec["limit"].split(":")
            return cls(seconds=int(h) * 3600 + int(m) * 60 + float(s), every=max(1, int(spec.get("frequency") or 1)))
        if kind == "memory":  # in megabytes, as the labels that fill it
            return cls(labels=max(1, int(float(spec["limit"]) * (1 << 20) / LABEL_BYTES)))
        if kind == "combined":
            parts = [cls.of(m) for m in spec["models"]]
            least = lambda name: min((v for p in parts if (v := getattr(p, name)) is not None), default=None)
            return cls(least("rounds"), least("labels"), least("seconds"), every=min((p.every for p in parts if p.seconds is not None), default=1))
        raise SearchError(f"unknown termination type '{kind}'")

    @property
    def bounded(self) -> bool:
        return self.rounds is not None or self.labels is not None or self.seconds is not None

    def over(self, labels: DataFrame, rounds: int, seconds: float) -> tuple[str, DataFrame] | None:
        """(why, requests (query_id) that end here) of a batch: labels are counted for each request."""
        if why := Limits(self.rounds).reached(rounds, 0, seconds):
            return why, labels.select("query_id").distinct()
        late = Limits(seconds=self.seconds).reached(rounds, 0, seconds)
        for why, least in ((late, self.every if late else None), (f"{self.labels} labels", self.labels)):
            if least is not None:
                full = labels.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("query_id")
                if not full.isEmpty():
                    return why, full
        return None

    def reached(self, rounds: int, labels: int, seconds: float) -> str | None:
        """Why a search that has come so far ends, if it does."""
        told = [
            f"{rounds} of {self.rounds} iterations" if self.rounds is not None and rounds >= self.rounds else "",
            f"{labels} of {self.labels} labels" if self.labels is not None and labels >= self.labels else "",
            f"{seconds:.1f} of {self.seconds} seconds" if self.seconds is not None and seconds >= self.seconds else "",
        ]
        return ", ".join(t for t in told if t) or None


@dataclass
class Setup:
    """Everything of a search but its requests."""

    models: list[TraversalModel]
    cost: CostModel
    constraint: Constraint = field(default_factory=Combined)
    label: Any = field(default_factory=VertexLabel)
    limits: Limits = field(default_factory=Limits)
    direction: str = "forward"
    q: dict = field(default_factory=dict)
    initial: dict[str, float] = field(default_factory=dict)
    heuristic: bool = False

    def __post_init__(self) -> None:
        self.models = ordered(self.models)
        self.features: list[Feature] = features_of(self.models, self.initial)
        self.cost = (self.cost.for_requests(self.features) if self.cost.own_weights else self.cost).checked(self.features)
        if not isinstance(self.constraint, Combined):
            self.constraint = Combined([self.constraint])

    @property
    def history(self) -> bool:
        return self.constraint.history or any(m.history for m in self.models)

    @property
    def clamped(self) -> bool:
        """Whether a step depends on more than its edge and the edge before it."""
        return any(p.history and not p.by_edge for p in [*self.constraint.parts, *self.models])

    @property
    def turns(self) -> list[TurnRestriction]:
        return [p for p in self.constraint.parts if isinstance(p, TurnRestriction)]

    def state_type(self) -> str:
        return "struct<" + ",".join(f"`{f.name}`:double" for f in self.features) + ">"

    def start(self) -> dict[str, float]:
        return {f.name: float(f.initial) for f in self.features}


TREE = "query_id long, vertex_id long, bin int, label string, g double, objective_cost double, total_cost double, edge_list_id int, edge_id long, parent_vertex long, parent_bin int, parent_label string, depth int, state {state}"
#: What names a label in a tree. ``label`` is the edge by which it was reached where turns are restricted, the heading on it
#: where they are only delayed, else empty.
LABEL = ["query_id", "vertex_id", "bin", "label"]
ERRORS = "query_id long, error string"


def search(network: Network, requests: DataFrame, setup: Setup, engine: str = "auto") -> DataFrame:
    """The search trees of requests (query_id, origin, destination or null): a row for each label that was reached.

    The root has no edge. With a destination, the tree holds at least all labels on the best way to it; unreachable ones are
    absent. Equal costs are decided by (edge_list_id, edge_id) in the relational search. A request that ends early without a
    route is an error here; see ``answered``.
    """
    return _or_raise(*answered(network, requests, setup, engine))


def answered(network: Network, requests: DataFrame, setup: Setup, engine: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(trees, errors): errors (query_id, error) for requests with a destination that ended early without a route."""
    auto = engine == "auto"
    if auto:
        engine = "kernel" if setup.clamped else "relax"
    return _kernel(network, requests, setup, KERNEL_BYTES) if engine == "kernel" else _relax(network, requests, setup, arrays=auto)


def relax(network: Network, requests: DataFrame, setup: Setup, cut: DataFrame | None = None) -> DataFrame:
    """``cut``: rows of (query_id, edge_list_id, edge_id) that a request may not use."""
    return _or_raise(*_relax(network, requests, setup, cut))


def trees(network: Network, requests: DataFrame, setup: Setup, cut: DataFrame | None = None, ways: bool = False) -> DataFrame:
    """``relax``, over packed arrays if they fit into a task. ``ways``: of a request with a destination nothing is asked for but
    the best way to it, so that the rest of its tree may be absent."""
    return _or_raise(*_relax(network, requests, setup, cut, ways=ways, arrays=True))


def least_costs(network: Network, requests: DataFrame, setup: Setup) -> DataFrame:
    """(query_id, vertex_id, g): the relational search for costs alone; no label's last edge is looked for, nothing is added up."""
    labels = _or_raise(*_relax(network, requests, setup, explain=False, arrays=True))
    return labels.groupBy("query_id", "vertex_id").agg(F.min("g").alias("g")) if setup.history else labels.select("query_id", "vertex_id", "g")


def kernel(network: Network, requests: DataFrame, setup: Setup, most: int = KERNEL_BYTES) -> DataFrame:
    """Above ``most`` bytes, setups whose state is not cut off are answered by the relational search."""
    return _or_raise(*_kernel(network, requests, setup, most, rounds=True))


def _or_raise(tree: DataFrame, errors: DataFrame) -> DataFrame:
    if row := errors.first():
        raise SearchError(f"request {row['query_id']}: {row['error']}")
    return tree


def _near_far(direction: str) -> tuple[str, str]:
    return ("src", "dst") if direction == "forward" else ("dst", "src")


class Nearby:
    """The edges at the vertices that a search has reached, in tables of their own. All edges are read only for vertices that no
    request had reached before, so that rounds among known vertices cost what the part of the network they are in costs."""

    def __init__(self, edges: DataFrame, near: str):
        self.all, self.near = edges, near
        self.reads = 0
        self.parts: list[tuple[int, DataFrame, DataFrame]] = []  # (vertices, they, their edges), the larger ones first

    def edges(self, vertices: DataFrame) -> DataFrame:
        """The edges at all vertices (vertex_id) asked for so far."""
        new = vertices.select("vertex_id").distinct()
        for _, known, _ in self.parts:
            new = new.join(known, "vertex_id", "left_anti")
        new = materialise(new, "new-vertices")
        if n := new.count():
            self.reads += 1
            found = self.all.join(new.withColumnRenamed("vertex_id", self.near), self.near, "left_semi")
            self.parts.append((n, new, materialise(found, "nearby")))
            while len(self.parts) > 1 and self.parts[-2][0] < 2 * self.parts[-1][0]:  # as many tables as the count has digits
                (n, new, found), (m, *last) = self.parts[-2:]
                merged = [materialise(a.unionByName(b), tag, a) for a, b, tag in zip((new, found), last, ("new-vertices", "nearby"), strict=True)]
                self.parts[-2:] = [(n + m, *merged)]
        return functools.reduce(DataFrame.unionByName, [e for _, _, e in self.parts]) if self.parts else self.all.limit(0)


class Steps:
    """The steps of a relational search: rows of labels (query_id, vertex_id, label, g and what turns need) meet edges."""

    def __init__(self, network: Network, requests: DataFrame, setup: Setup, cut: DataFrame | None):
        self.setup, self.cut, self.turning = setup, cut, setup.history
        self.near, self.far = _near_far(setup.direction)
        self.edges = setup.constraint.prefilter(network.wide_edges())
        self.weights = setup.cost.own_weights
        # What a label carries beside its cost: with restricted turns, the edge it came by; with delays alone, its heading.
        self.carried = (["came_list", "came_edge"] if setup.turns else []) + (["came_heading"] if self.turning else [])
        start = {f.name: F.lit(float(v)) for f, v in zip(setup.features, setup.start().values(), strict=True)}
        own = {"prev_departure_heading": F.col("came_heading") if self.turning else F.lit(None).cast("int")}
        edge = {c: F.col(c) for c in [*self.edges.columns, *(["weights"] if self.weights else [])]} | own
        after = step(Columns, setup.models, setup.features, edge, start, setup.q)
        self.objective, self.total = setup.cost.costs(Columns, setup.features, start, after, edge)
        parts = setup.cost.parts(Columns, setup.features, start, after, edge)
        self.part_names, self.parts = list(parts), list(parts.values())
        self.state = F.struct(*[after[f.name].cast("double").alias(f.name) for f in setup.features])
        self.test = setup.constraint.allows(Columns, edge, start)
        self.own = requests.select(F.col("query_id").cast("long").alias("wq"), "weights") if self.weights else None
        if not self.turning:  # a step costs the same from wherever it is taken: worked out once
            parts = [] if self.weights else [self.objective.alias("__objective")]
            self.edges = self.edges.withColumns({"__objective": self.objective}) if parts else self.edges
        self.nearby = Nearby(self.edges, self.near)

    def reach(self, labels: DataFrame) -> None:
        """From here on, steps are taken at the labels' vertices too."""
        self.edges = self.nearby.edges(labels)

    def met(self, labels: DataFrame) -> DataFrame:
        """Labels (``g`` and names with ``from_``) with each edge that they may take, and the cost of it."""
        rows = labels.join(self.edges, F.col("from_vertex") == F.col(self.near))
        if self.cut is not None:
            rows = rows.join(self.cut, ["query_id", "edge_list_id", "edge_id"], "left_anti")
        for turn in self.setup.turns:
            pairs = turn.pairs.select(F.col("prev_edge_id").alias("came_edge"), F.col("next_edge_id").alias("edge_id"))
            rows = rows.join(pairs, ["came_edge", "edge_id"], "left_anti")
        if self.weights:
            rows = rows.join(self.own, F.col("query_id") == F.col("wq"), "left")
        if self.test is not None:
            rows = rows.filter(self.test)
        if self.turning or self.weights:
            rows = rows.withColumn("__objective", self.objective)
        return rows.filter((F.col("__objective") < math.inf) & F.col("__objective").isNotNull()).withColumn("reached_g", F.col("g") + F.col("__objective"))

    def taken(self, rows: DataFrame) -> DataFrame:
        """Rows that name the edge they took (and what they carried), with it and its cost."""
        rows = rows.join(self.edges, ["edge_list_id", "edge_id"])
        if self.weights:
            rows = rows.join(self.own, F.col("query_id") == F.col("wq"), "left")
        return rows.withColumn("__objective", self.objective) if self.turning or self.weights else rows

    def named(self, rows: DataFrame) -> list[Column]:
        """The label that a step leads to."""
        if not self.turning:
            return [F.col(self.far).alias("vertex_id")]
        out = F.col("arrival_heading") if "departure_heading" not in rows.columns else F.coalesce("departure_heading", "arrival_heading")
        heading = out if "arrival_heading" in rows.columns else F.lit(None)
        by_edge = [F.col("edge_list_id").cast("int").alias("came_list"), F.col("edge_id").alias("came_edge")] if self.setup.turns else []
        return [F.col(self.far).alias("vertex_id"), *by_edge, heading.cast("int").alias("came_heading")]


def _relax(network: Network, requests: DataFrame, setup: Setup, cut: DataFrame | None = None, explain: bool = True, ways: bool = False, arrays: bool = False) -> tuple[DataFrame, DataFrame]:
    import time

    if setup.clamped:
        raise SearchError("the state of these models is cut off: use the kernel")
    spark, began = requests.sparkSession, time.monotonic()
    steps = Steps(network, requests, setup, cut)
    names = ["query_id", "vertex_id", *steps.carried]
    if arrays and not setup.limits.bounded and (found := searched(steps, network.vertices, requests, cut, explain, ways)) is not None:
        return _tree_of(found, steps, setup) if explain else found.select(*names, "g"), spark.createDataFrame([], ERRORS)
    asked = requests.select(F.col("query_id").cast("long").alias("query_id"), F.col("origin").cast("long").alias("vertex_id"), F.col("destination").cast("long").alias("destination"))
    root = asked.join(network.vertices.select("vertex_id"), "vertex_id", "left_semi").select("query_id", "vertex_id", *(F.lit(None).cast("int" if c != "came_edge" else "long").alias(c) for c in steps.carried), F.lit(0.0).alias("g"), F.lit(0).alias("round"))
    targets = materialise(asked.filter("destination IS NOT NULL").select(F.col("query_id").alias("tq"), F.col("destination").alias("tv")), "targets")
    has_targets = not targets.isEmpty()
    known = fresh = materialise(root, "labels")
    before_goal, parts, ended, every = None, 0, None, root
    for number in range(1, 1_000_000):
        frontier = fresh
        steps.reach(fresh)
        if has_targets:
            # A label that costs as much as a way already found leads nowhere better; nor does one whose straight way would.
            bounds = known.join(targets, (F.col("query_id") == F.col("tq")) & (F.col("vertex_id") == F.col("tv"))).groupBy("tq").agg(F.min("g").alias("bound"))
            frontier = frontier.join(bounds, F.col("query_id") == F.col("tq"), "left").drop("tq")
            least = F.col("g")
            if setup.heuristic:
                if before_goal is None:
                    before_goal = _to_goal(network, targets, setup)
                frontier, least = before_goal(frontier)
            frontier = frontier.filter(F.col("bound").isNull() | (least < F.col("bound")))
        rows = steps.met(frontier.select("query_id", F.col("vertex_id").alias("from_vertex"), *steps.carried, "g"))
        # What is carried is that of the edge just taken from here on.
        new = rows.select("query_id", *steps.named(rows), F.col("reached_g").alias("g"), F.lit(None).cast("double").alias("old"))
        # One exchange: steps are put together by label in each task before it, with what is known of the label.
        both = new.unionByName(known.select(*names, "g", F.col("g").alias("old")))
        better = both.groupBy(*names).agg(F.min("g").alias("g"), F.min("old").alias("old")).filter("old IS NULL OR g < old").select(*names, "g", F.lit(number).alias("round"))
        fresh = materialise(better, "fresh")
        if fresh.isEmpty():
            break
        parts += 1
        known, every = known.unionByName(fresh), every.unionByName(fresh)
        if parts >= COMPACT:  # labels written several times are put together now and then
            known, parts = materialise(_least(known, names), "labels"), 0
        if setup.limits.bounded and (over := setup.limits.over(_least(known, names), number, time.monotonic() - began)):
            why, full = over
            full = materialise(full.withColumn("why", F.lit(why)), "ended")
            ended = full if ended is None else materialise(ended.unionByName(full.join(ended, "query_id", "left_anti")), "ended")
            fresh = materialise(fresh.join(full, "query_id", "left_anti"), "fresh")
            if fresh.isEmpty():
                break
    labels = materialise(_least(known, names), "labels")
    if explain:
        steps.reach(labels)
    # Of a search that ended early, some labels' parents got better after them: they are explained by what those were.
    tree = _explained(labels, labels if ended is None else every, names, steps, setup) if explain else labels
    if ended is None or not setup.limits.strict or not has_targets:
        return tree, spark.createDataFrame([], ERRORS)
    without = targets.join(labels.select(F.col("query_id").alias("tq"), F.col("vertex_id").alias("tv")).distinct(), ["tq", "tv"], "left_anti")
    return tree, without.join(ended, F.col("tq") == F.col("query_id")).select("query_id", F.concat(F.lit("search ended early: "), "why").alias("error"))


def _least(labels: DataFrame, names: list[str]) -> DataFrame:
    """Each label once, with its least cost and the round that found it."""
    return labels.groupBy(*names).agg(F.min("g").alias("g"), F.min_by("round", "g").alias("round"))


def _to_goal(network: Network, targets: DataFrame, setup: Setup):
    """A function that adds to labels the cost that a straight way to their goal would have: never more than the real one."""
    place = lambda side: network.vertices.select(F.col("vertex_id").alias(f"{side}_v"), F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y"))
    goals = materialise(targets.join(place("dst"), F.col("tv") == F.col("dst_v")).select(F.col("tq").alias("goal_q"), "dst_x", "dst_y"), "goals")
    start = {f.name: F.lit(float(f.initial)) for f in setup.features}
    pair = {c: F.col(c) for c in ("src_x", "src_y", "dst_x", "dst_y")}
    after = step(Columns, setup.models, setup.features, pair, start, setup.q, estimate=True)
    bound = setup.cost.costs(Columns, setup.features, start, after)[0]

    def add(labels: DataFrame) -> tuple[DataFrame, Column]:
        rows = labels.join(place("src"), F.col("vertex_id") == F.col("src_v")).join(goals, F.col("query_id") == F.col("goal_q"), "left")
        return rows, F.col("g") + F.coalesce(bound, F.lit(0.0)) * (1 - 1e-9)

    return add


def _explained(labels: DataFrame, sources: DataFrame, names: list[str], steps: Steps, setup: Setup) -> DataFrame:
    """The tree of the final labels: the edge from one of ``sources`` that explains each cost, and states added up."""
    text = F.concat_ws(":", *(steps.carried[:2])) if steps.turning else F.lit("")
    parents = sources.select("query_id", F.col("vertex_id").alias("from_vertex"), text.alias("parent_label"), *steps.carried, "g", F.col("round").alias("from_round"))
    rows = steps.met(parents)
    # Only names travel; what a step did is worked out again for those that are chosen.
    before = [F.col(c).alias(f"p_{c}") for c in steps.carried]
    taken = rows.select("query_id", *steps.named(rows), *before, "reached_g", F.col("g").alias("from_g"), "from_round", F.col("from_vertex").alias("parent_vertex"), "parent_label", "edge_list_id", "edge_id")
    ends = labels.select(*(F.col(c).alias(f"l_{c}") for c in [*names, "g", "round"]))
    same = (F.col("query_id") == F.col("l_query_id")) & (F.col("vertex_id") == F.col("l_vertex_id")) & (F.col("reached_g") == F.col("l_g"))
    for c in steps.carried:
        same = same & F.col(c).eqNullSafe(F.col(f"l_{c}"))
    # Along (cost, round) a parent is always less, so that steps that cost next to nothing cannot run in a circle.
    fits = taken.join(ends, same).filter("l_round > 0 AND (from_g < l_g OR from_round < l_round)")
    chosen = fits.groupBy("query_id", "vertex_id", *steps.carried, F.col("l_g").alias("g")).agg(F.min(F.struct("edge_list_id", "edge_id", "parent_vertex", "parent_label", *(f"p_{c}" for c in steps.carried))).alias("s"))
    label = text.alias("label")
    chosen = chosen.select("query_id", "vertex_id", label, "g", "s.edge_list_id", "s.edge_id", "s.parent_vertex", "s.parent_label", *(F.col(f"s.p_{c}").alias(c) for c in steps.carried))
    return _grown(chosen, labels.filter("round = 0").select("query_id", "vertex_id", label, "g"), steps, setup)


def _tree_of(found: DataFrame, steps: Steps, setup: Setup) -> DataFrame:
    """The tree of labels whose parents are known."""
    text = lambda side: (F.concat_ws(":", *(f"{side}{c}" for c in steps.carried)) if steps.turning else F.lit("")).alias("parent_label" if side else "label")
    found = found.withColumn("way", F.col("depth"))
    known = ["key", "parent_key", "way"] if (found.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0) <= SUMMED else []
    chosen = found.filter("depth > 0").select("query_id", "vertex_id", text(""), "g", "edge_list_id", "edge_id", "parent_vertex", text("p_"), *(F.col(f"p_{c}").alias(c) for c in steps.carried), *known)
    return _grown(chosen, found.filter("depth = 0").select("query_id", "vertex_id", text(""), "g", *known), steps, setup, known)


def _grown(chosen: DataFrame, roots: DataFrame, steps: Steps, setup: Setup, known: list[str] = ()) -> DataFrame:
    """The tree of labels with the edge, the parent and what the parent carried, and of the roots. ``known``: columns that name
    labels and parents by numbers and tell depths, by which each request's tree is added up in a task."""
    done = steps.taken(chosen)
    start = F.struct(*[F.lit(v).alias(k) for k, v in setup.start().items()])
    key = [F.col("query_id"), F.col("vertex_id"), F.lit(0).alias("bin"), F.col("label"), F.col("g")]
    grown = done.select(*key, F.col("__objective").alias("objective_cost"), steps.total.alias("total_cost"), F.col("edge_list_id").cast("int").alias("edge_list_id"), "edge_id", "parent_vertex", F.lit(0).alias("parent_bin"), "parent_label", F.lit(1).alias("depth"), steps.state.alias("state"), *known)
    none = lambda kind: F.lit(None).cast(kind)
    root = roots.select(*key, F.lit(0.0).alias("objective_cost"), F.lit(0.0).alias("total_cost"), none("int").alias("edge_list_id"), none("long").alias("edge_id"), none("long").alias("parent_vertex"), none("int").alias("parent_bin"), none("string").alias("parent_label"), F.lit(0).alias("depth"), start.alias("state"), *known)
    if known:
        sums = {f.name: (f.least, setup.start()[f.name]) for f in setup.features if f.accumulator}
        return materialise(summed(grown.unionByName(root), [f.name for f in setup.features], sums), "tree")
    tree = materialise(grown.unionByName(root), "tree")
    return added_up(tree, setup)


def added_up(tree: DataFrame, setup: Setup) -> DataFrame:
    """The tree with depths and states from the root on, where each row has those of its own edge alone."""
    sums = [f for f in setup.features if f.accumulator]
    start = setup.start()
    far = lambda f, a, b: F.least(a, b) if f.least else a + b - F.lit(start[f.name])
    # (label, depth, sums): up to the label ``up``, which is null at the root.
    now = materialise(tree.select(*LABEL, F.col("parent_vertex").alias("up_vertex"), F.col("parent_bin").alias("up_bin"), F.col("parent_label").alias("up_label"), "depth", *(F.col(f"state.{f.name}").alias(f"s_{k}") for k, f in enumerate(sums))), "jumps")
    for _ in range(64):
        if now.filter("up_vertex IS NOT NULL").isEmpty():
            break
        ends = now.select(F.col("query_id").alias("q"), F.col("vertex_id").alias("v"), F.col("bin").alias("b"), F.col("label").alias("l"), F.col("up_vertex").alias("v2"), F.col("up_bin").alias("b2"), F.col("up_label").alias("l2"), F.col("depth").alias("d2"), *(F.col(f"s_{k}").alias(f"t_{k}") for k in range(len(sums))))
        met = now.join(ends, (F.col("query_id") == F.col("q")) & (F.col("up_vertex") == F.col("v")) & (F.col("up_bin") == F.col("b")) & (F.col("up_label") == F.col("l")), "left")
        whole = [F.when(F.col("q").isNull(), F.col(f"s_{k}")).otherwise(far(f, F.col(f"s_{k}"), F.col(f"t_{k}"))).alias(f"s_{k}") for k, f in enumerate(sums)]
        now = materialise(met.select(*LABEL, F.col("v2").alias("up_vertex"), F.col("b2").alias("up_bin"), F.col("l2").alias("up_label"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), *whole), "jumps", now)
    else:
        raise SearchError("the tree has a circle")
    state = F.struct(*[(F.col(f"s_{sums.index(f)}") if f in sums else F.col(f"state.{f.name}")).alias(f.name) for f in setup.features])
    columns = [c for c in tree.columns if c not in ("depth", "state")]
    both = tree.drop("depth").join(now.select(*LABEL, "depth", *(f"s_{k}" for k in range(len(sums)))), LABEL)
    return both.select(*columns, "depth", state.alias("state"))


# -- kernel -----------------------------------------------------------------------------------------------------------------


class Arrays:
    """A network's edges by the vertex they leave from, as arrays."""

    def __init__(self, rows: pd.DataFrame, near: str):
        rows = rows.sort_values([near, "edge_list_id", "edge_id"], kind="stable").reset_index(drop=True)
        self.columns = {c: rows[c].to_numpy() for c in rows.columns}
        self.lists: dict[str, list] = {}
        self.ids, starts = np.unique(rows[near].to_numpy(), return_index=True)
        self.first = dict(zip(self.ids.tolist(), starts.tolist(), strict=True))
        self.last = dict(zip(self.ids.tolist(), np.append(starts[1:], len(rows)).tolist(), strict=True))

    def values(self, name: str) -> list:
        """A column as Python values, nulls as None; made when it is first asked for."""
        if name not in self.lists:
            column = self.columns[name]
            made = column.tolist()
            self.lists[name] = [None if v != v else v for v in made] if column.dtype.kind in "fO" else made
        return self.lists[name]


class Edge:
    """The edge at ``at``, read column by column; ``own`` has what a search adds to it."""

    __slots__ = ("arrays", "at", "own")

    def __init__(self, arrays: Arrays):
        self.arrays, self.at, self.own = arrays, 0, {}

    def __getitem__(self, name: str):
        return self.own[name] if name in self.own else self.arrays.values(name)[self.at]

    def get(self, name: str):
        return self[name] if name in self.own or name in self.arrays.columns else None


def solve(arrays: Arrays, setup: Setup, origin: int, destination: int | None, turns: set[tuple[int, int]], place: dict | None = None) -> dict:
    """{(vertex, bin): (g, objective, total, edge list, edge, parent vertex, parent bin, depth, state)} for one request."""
    import time

    far = _near_far(setup.direction)[1]
    start = setup.start()
    root = (origin, setup.label.bin(start))
    best = {root: (0.0, 0.0, 0.0, None, None, None, None, 0, start)}
    heading: dict = {root: None}
    queue, settled, count, began, now = [(0.0, 0, root)], set(), 1, time.monotonic(), 0.0
    edge = Edge(arrays)

    def bound(vertex: int) -> float:
        if place is None or destination is None:
            return 0.0
        a, b = place[vertex], place[destination]
        pair = {"src_x": a[0], "src_y": a[1], "dst_x": b[0], "dst_y": b[1]}
        after = step(Numbers, setup.models, setup.features, pair, start, setup.q, estimate=True)
        return setup.cost.costs(Numbers, setup.features, start, after)[0]

    while queue:
        if len(settled) % max(1024, setup.limits.every) == 0:
            now = time.monotonic() - began
        if why := setup.limits.reached(len(settled), len(best), now):
            if setup.limits.strict and destination is not None and not any(v == destination for v, _ in best):
                raise SearchError(f"search ended early: {why}")
            break
        _, _, at = heapq.heappop(queue)
        if at in settled:
            continue
        settled.add(at)
        if at[0] == destination:
            break
        row = best[at]
        edge.own["prev_departure_heading"] = heading[at]
        for i in range(arrays.first.get(at[0], 0), arrays.last.get(at[0], 0)):
            edge.at = i
            if row[4] is not None and turns and (row[4], edge["edge_id"]) in turns:
                continue
            if setup.constraint.allows(Numbers, edge, row[8]) is False:
                continue
            state = step(Numbers, setup.models, setup.features, edge, row[8], setup.q)
            objective, total = setup.cost.costs(Numbers, setup.features, row[8], state, edge)
            if objective is None or not objective < math.inf:
                continue
            to = (edge[far], setup.label.bin(state))
            g = row[0] + objective
            if to not in best or g < best[to][0]:
                best[to] = (g, objective, total, edge["edge_list_id"], edge["edge_id"], at[0], at[1], row[7] + 1, state)
                out = edge.get("departure_heading")
                heading[to] = edge.get("arrival_heading") if out is None else out
                settled.discard(to)
                count += 1
                heapq.heappush(queue, (g + bound(to[0]), count, to))
    return best


class Reads(dict):
    """Columns of an edge by name; remembers which were asked for."""

    def __init__(self, columns: list[str]):
        super().__init__({c: F.col(c) for c in columns})
        self.asked: set[str] = set()

    def __getitem__(self, name: str):
        self.asked.add(name)
        return super().__getitem__(name)

    def get(self, name: str, default=None):
        self.asked.add(name)
        return super().get(name, default)


def _looked_at(edges: DataFrame, setup: Setup) -> list[str]:
    """The columns of the edges that a search with this setup reads."""
    reads = Reads([*edges.columns, "weights", "prev_departure_heading"])
    start = {f.name: F.lit(float(f.initial)) for f in setup.features}
    after = step(Columns, setup.models, setup.features, reads, start, setup.q)
    setup.cost.costs(Columns, setup.features, start, after, reads)
    setup.constraint.allows(Columns, reads, start)
    always = {"edge_list_id", "edge_id", "src", "dst", "departure_heading", "arrival_heading", *(("src_x", "src_y", "dst_x", "dst_y") if setup.heuristic else ())}
    return [c for c in edges.columns if c in always | reads.asked]


def _reachable(edges: DataFrame, requests: DataFrame, direction: str) -> DataFrame:
    """The edges that can be reached from the requests' origins."""
    near, far = _near_far(direction)
    nearby, now = Nearby(edges, near), materialise(requests.select(F.col("origin").cast("long").alias("vertex_id")).distinct(), "reached")
    while True:
        before = nearby.reads
        found = nearby.edges(now)
        if nearby.reads == before:
            return found
        now = found.select(F.col(far).alias("vertex_id"))


def _kernel(network: Network, requests: DataFrame, setup: Setup, most: int, whole: int | None = None, rounds: bool = False) -> tuple[DataFrame, DataFrame]:
    """A copy of the edges goes to each task by a shuffle and is turned into arrays there: of the columns that the search reads
    and, where all edges would take more than ``whole`` bytes, of the edges that can be reached from an origin."""
    spark = requests.sparkSession
    edges = setup.constraint.prefilter(network.wide_edges())
    edges = edges.select(*_looked_at(edges, setup))
    n = edges.count()
    if n * 8 * len(edges.columns) > most and rounds and not setup.clamped:
        return _relax(network, requests, setup, arrays=True)  # the same answers, without a copy of all edges' columns in a task
    if n * 8 * len(edges.columns) > min(most, WHOLE_BYTES if whole is None else whole):
        edges = _reachable(edges, requests, setup.direction)
        n = edges.count()
    if n * 8 * len(edges.columns) > most:
        raise SearchError(f"{n} edges are too many for a kernel of {most} bytes")
    turns = set().union(*(t.kernel_pairs() for t in setup.turns)) if setup.turns else set()
    rest = spark.sparkContext.broadcast((_without_frames(setup), turns))
    names, columns = [f.name for f in setup.features], [x.split()[0] for x in TREE.split(", ")]
    near, heuristic = _near_far(setup.direction)[0], setup.heuristic

    def run(asked: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        setup, turns = rest.value
        arrays, place = Arrays(edges.drop(columns="slot"), near), None
        if heuristic:
            place = {v: (x, y) for side in ("src", "dst") for v, x, y in zip(edges[side], edges[f"{side}_x"], edges[f"{side}_y"], strict=True)}
        rows = []
        for query_id, origin, destination, weights in zip(asked["query_id"], asked["origin"], asked["destination"], asked["weights"], strict=True):
            mine = copy.copy(setup)
            if setup.cost.own_weights:
                mine.cost = replace(setup.cost, weights={k: w for k, w in dict(weights).items() if k in setup.cost.weights}, own_weights=False)
            try:
                tree = solve(arrays, mine, int(origin), None if pd.isna(destination) else int(destination), turns, place)
                rows += [(query_id, v, b, "", *row[:7], None if row[4] is None else "", row[7], {k: float(row[8][k]) for k in names}, None) for (v, b), row in tree.items()]
            except SearchError as e:
                rows.append((query_id, *[None] * (len(columns) - 1), str(e)))
        return pd.DataFrame(rows, columns=[*columns, "error"], dtype=object)

    # The requests are few, but each of them is much work: a group for each of some tasks.
    slots = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), requests.count()))
    weights = F.col("weights") if setup.cost.own_weights else F.lit(None).cast("map<string,double>").alias("weights")
    asked = requests.select(F.col("query_id").cast("long").alias("query_id"), "origin", "destination", weights, F.pmod(F.xxhash64(F.col("query_id").cast("long")), F.lit(slots)).cast("int").alias("slot"))
    copies = edges.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    made = asked.groupBy("slot").cogroup(copies.groupBy("slot")).applyInPandas(run, f"{TREE.format(state=setup.state_type())}, error string")
    made = materialise(made, "kernel")
    return made.filter("error IS NULL").drop("error"), made.filter("error IS NOT NULL").select("query_id", "error")


def _without_frames(setup: Setup) -> Setup:
    """The setup with what kernels need only: constraints on steps, not the DataFrames of those already applied."""
    bare = copy.copy(setup)
    bare.constraint = Combined([p for p in setup.constraint.parts if not any(isinstance(v, DataFrame) for v in vars(p).values())])
    return bare
