"""The application: a configuration, a network, and batches of requests."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.units import convert
from wayfold.operators import output, shaping
from wayfold.operators.cost import CostModel, Rate, with_network_costs
from wayfold.operators.graph import Network
from wayfold.operators.matching import match_requests
from wayfold.operators.models import Speed, fastest_mph
from wayfold.plans.ksp import KspLimit, Similarity, between_end_edges, single_via, with_end_edges, yens
from wayfold.plans.paths import routes
from wayfold.plans.scratch import materialise
from wayfold.plans.search import Limits, Setup, answered
from wayfold.registry import Registry, default_registry
from wayfold.sources import config as cfg
from wayfold.sources import files
from wayfold.sources.sinks import sink_of

REQUEST = "origin_x double, origin_y double, destination_x double, destination_y double, origin_vertex long, destination_vertex long, origin_edge_list int, origin_edge long, destination_edge_list int, destination_edge long"


class App:
    """Runs requests over one network. Models are made for each group of requests that share their parameters; requests that
    differ in their ends and weights only share one search."""

    def __init__(self, spark: SparkSession, config: dict, network: Network, registry: Registry | None = None, **context):
        self.spark, self.config, self.registry = spark, config, registry or default_registry()
        self.network, self.context = network.cached(config.get("edge_buckets")), context

    @classmethod
    def from_config_file(cls, spark: SparkSession, path: str | Path, registry: Registry | None = None, **context) -> App:
        return cls.from_dict(spark, cfg.load(path), registry, **context)

    @classmethod
    def from_dict(cls, spark: SparkSession, config: dict, registry: Registry | None = None, **context) -> App:
        """``context`` has what models need beside files: ``vehicles`` (a VehicleLibrary), ``uuids``."""
        config = cfg.merge(cfg.DEFAULTS, config)
        graph = cfg.section(config, "graph")
        lists = cfg.one_or_many(graph.get("edge_list_input_files") or graph.get("edge_list_input_file") or [e["input_file"] for e in cfg.one_or_many(graph.get("edge_list", []))])
        network = files.read_network(spark, graph["vertex_list_input_file"], lists)
        for name, spec in config.get("attributes", {}).items():
            network = network.with_attribute(files.read_attribute(spark, spec["input_file"], spec.get("kind", "f64")), name)
        constraint = config.get("constraint", {})
        for part in constraint.get("models", [constraint]):
            if "turn_restriction_input_file" in part:
                context["turn_restrictions"] = files.read_turn_restrictions(spark, part["turn_restriction_input_file"])
            if "vehicle_restriction_input_file" in part:
                from wayfold.operators.constraints import normalised_restrictions

                context["vehicle_restrictions"] = normalised_restrictions(files.read_vehicle_restrictions(spark, part["vehicle_restriction_input_file"]))
        stations = config.get("charging_station_input_file")
        if stations:
            network = files.with_stations(network, files.read_stations(spark, stations, network))
        for kind in ("edge", "vertex"):
            path = config.get("cost", {}).get(f"{kind}_cost_input_file")
            if path:
                network.edges = with_network_costs(network.edges, **{f"{kind}_costs": files.read_network_costs(spark, path, f"{kind}_id")}, name=f"{kind}_cost")
        geometry = config.get("mapping", {}).get("geometry_input_file")
        context["lines"] = files.read_lines_of_edges(spark, geometry, network) if geometry else network.straight_lines()
        return cls(spark, config, network, registry, **context)

    # -- graph getters ----------------------------------------------------------------------------------------------------
    def edge_origin(self, edge_id: int, edge_list_id: int = 0) -> int:
        return self.network.require_edge(edge_list_id, edge_id)["src"]

    def edge_destination(self, edge_id: int, edge_list_id: int = 0) -> int:
        return self.network.require_edge(edge_list_id, edge_id)["dst"]

    def edge_distance(self, edge_id: int, edge_list_id: int = 0, unit: str = "meters") -> float:
        return convert(self.network.require_edge(edge_list_id, edge_id)["distance_m"], "distance", "meters", unit)

    def out_edge_ids(self, vertex_id: int) -> list[int]:
        return [r["edge_id"] for r in self.network.edges.filter(F.col("src") == vertex_id).orderBy("edge_list_id", "edge_id").collect()]

    def in_edge_ids(self, vertex_id: int) -> list[int]:
        return [r["edge_id"] for r in self.network.edges.filter(F.col("dst") == vertex_id).orderBy("edge_list_id", "edge_id").collect()]

    # -- runs -------------------------------------------------------------------------------------------------------------
    def setup(self, request: dict, own_weights: bool = False) -> Setup:
        """The models and costs of one request, or of requests with weights of their own in a column."""
        config, context = self.config, self.context | {"q": request}
        traversal = self.registry.build("traversal", config.get("traversal", {"type": "distance"}), context)
        models = traversal if isinstance(traversal, list) else [traversal]
        cost = config.get("cost", {})
        model = CostModel(dict(cost.get("weights", {"trip_distance": 1.0})), {k: Rate.of(v) for k, v in cost.get("vehicle_rates", {"trip_distance": "raw"}).items()}, dict(cost.get("network_rates", {})), bool(cost.get("ignore_unknown_user_provided_weights", False)), own_weights)
        algorithm = config.get("algorithm", {})
        heuristic = algorithm.get("type") in ("a*", "a_star") and bool(algorithm.get("heuristic", False))
        for m in models:
            if heuristic and isinstance(m, Speed) and m.fastest is None:
                m.fastest = fastest_mph(self.network.edges, m.column, m.unit)
        made = Setup(models, model.merged(request.get("weights"), request.get("vehicle_rates")), self.registry.build("constraint", config["constraint"], context), self.registry.build("label", config["label"], context), Limits.of(config["termination"]), q=request, heuristic=heuristic)
        made.initial = shaping.state_overrides(request, {f.name: f.kind for f in made.features})
        made.__post_init__()
        return made

    def run_frame(self, requests: DataFrame) -> DataFrame:
        """(query_id, combo_idx, response) for rows with a JSON text ``request``. Errors are responses too.

        A request keeps its query_id; ``combo_idx`` numbers the combinations that a grid makes of one.
        """
        plugins = [self.registry.build("input", p, self.context) for p in self.config["plugin"]["input_plugins"]]
        shaped = shaping.apply_plugins(requests, plugins)
        combo = F.coalesce("combo_idx", F.lit(0)) if "combo_idx" in shaped.columns else F.lit(0)
        shaped = materialise(shaped.select(F.col("query_id").alias("request_id"), combo.cast("int").alias("combo_idx"), "request", "error"), "shaped")
        # Searches need one number for each; rows of a written table keep theirs.
        rows = materialise(shaped.withColumn("query_id", F.monotonically_increasing_id()), "requests")
        good, bad = rows.filter("error IS NULL").select("query_id", "request", "error"), rows.filter("error IS NOT NULL").select("query_id", "request", "error")
        typed = good.select("query_id", "request", F.from_json("request", REQUEST).alias("r")).select("query_id", "request", "r.*")
        mapping = self.config["mapping"]
        tolerance = mapping.get("tolerance") or {}
        matched = materialise(match_requests(typed, self.network, tuple(cfg.one_or_many(mapping["matching_type"])), None, tolerance.get("distance"), tolerance.get("unit", "meters"), not mapping.get("queries_without_destinations", True)), "matched")
        parts = [output.responses(bad), output.responses(matched.filter("error IS NOT NULL").select("query_id", "request", "error"))]
        ready = matched.filter("error IS NULL")
        # Requests that differ in their ends and weights only share one plan; the groups are as many as there are different
        # other parameters. Alternative routes are searched for with the weights of a group.
        alone = "" if self.config["algorithm"].get("type") in ("yens", "single_via_paths") else "|^weights$"
        rest = F.to_json(F.map_filter(F.from_json("request", "map<string,string>"), lambda k, v: ~k.rlike("^(origin|destination)_(x|y|vertex|edge|edge_list|name)$" + alone)))
        own = F.from_json(F.get_json_object("request", "$.weights"), "map<string,double>") if alone else F.lit(None).cast("map<string,double>")
        grouped = materialise(ready.withColumn("parameters", rest).withColumn("own", own), "grouped")
        for row in grouped.groupBy("parameters").agg(F.first("request").alias("request"), F.count("own").alias("n_own")).toLocalIterator():
            group = grouped.filter(F.col("parameters").eqNullSafe(F.lit(row["parameters"])))
            try:
                request = json.loads(row["request"])
                if row["n_own"]:
                    request.pop("weights", None)
                    setup = self.setup(request, own_weights=True)
                    weighted = materialise(group.withColumn("weights", shaping.merged_map(self.config.get("cost", {}).get("weights", {"trip_distance": 1.0}), F.col("own"))).withColumn("wrong", setup.cost.weights_error(F.col("weights"), setup.features)), "weighted")
                    parts.append(output.responses(weighted.filter("wrong IS NOT NULL").select("query_id", "request", F.col("wrong").alias("error"))))
                    parts.append(self._answer(weighted.filter("wrong IS NULL"), request, setup))
                else:
                    parts.append(self._answer(group, request, self.setup(request)))
            except (ValueError, RuntimeError) as e:
                parts.append(output.responses(group.select("query_id", "request", F.lit(str(e)).alias("error"))))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.join(rows.select("query_id", "request_id", "combo_idx"), "query_id").select(F.col("request_id").alias("query_id"), "combo_idx", "response")

    def _answer(self, group: DataFrame, request: dict, setup: Setup) -> DataFrame:
        began, algorithm = time.monotonic(), self.config["algorithm"]
        ends = group.select("query_id", "origin", "destination", *(["weights"] if setup.cost.own_weights else []))
        edges = group.select("query_id", "origin", "destination", *(F.col(f"{side}_matched_{part}").alias(f"{side}_{part}") for side in ("origin", "destination") for part in ("list", "edge")))
        kind = algorithm.get("type")
        outputs = [self.registry.build("output", p, self.context) for p in self.config["plugin"]["output_plugins"]] or [("summary", {}), ("traversal", {"route": "edge_id"})]
        if kind in ("yens", "single_via_paths"):
            k = int(request.get("k", algorithm.get("k", 1)))
            spec = algorithm.get("similarity", {})
            alike = Similarity(spec.get("type", "accept_all"), spec.get("threshold", 1.0))
            if kind == "yens":
                limit = algorithm.get("termination", {"type": "exact"})
                found = yens(self.network, ends, setup, k, alike, KspLimit(limit["type"], int(limit.get("max", limit.get("factor", 0)))))
            else:
                found = single_via(self.network, ends, setup, k, alike)
            each = between_end_edges(found, edges).select("query_id", "route_idx", F.to_json(F.struct("cost", "edges")).alias("route"))
            return output.responses(group.select("query_id", "request", F.lit(None).cast("string").alias("error")), output.by_cardinality(each))
        trees, early = answered(self.network, ends, setup)
        tree = materialise(trees, "tree")
        plain = materialise(routes(tree, ends), "routes")
        made = group.select("query_id", "request", "origin", "destination")
        lost = made.join(plain.select("query_id").distinct().withColumn("__found", F.lit(True)), "query_id", "left").join(early.withColumnRenamed("error", "__early"), "query_id", "left")
        error = F.coalesce("__early", F.when(F.col("destination").isNotNull() & F.col("__found").isNull() & (F.col("origin") != F.col("destination")), F.lit("no path")))
        rows = lost.select("query_id", "request", error.alias("error"))
        way = plain
        if not edges.filter("origin_edge IS NOT NULL OR destination_edge IS NOT NULL").isEmpty():
            way = materialise(with_end_edges(plain, edges), "routes")
        seconds = time.monotonic() - began
        extra = made.select("query_id", "origin", "destination")
        for name, spec in outputs:
            if name == "summary":
                extra = extra.join(output.run_summary(tree, way, made).withColumn("search_seconds", F.lit(seconds)).join(early.select("query_id", F.col("error").alias("terminated")), "query_id", "left"), "query_id", "left")
                total = output.path_summary(way, setup.features, spec.get("summary_ops"))
                extra = extra.join(total.select("query_id", F.struct(*[c for c in total.columns if c not in ("query_id", "route_idx")]).alias("traversal_summary")), "query_id", "left")
            elif name == "traversal":
                if spec.get("route"):
                    extra = extra.join(output.by_cardinality(output.route_output(way, spec["route"], setup.features, self.context.get("lines"))), "query_id", "left")
                if spec.get("tree"):
                    extra = extra.join(output.tree_output(tree, spec["tree"], setup.features, self.context.get("lines")), "query_id", "left")
            elif name == "uuid":
                extra = output.with_uuids(extra, self.context["uuids"])
        return output.responses(rows, extra)

    def run(self, queries: dict | list[dict]) -> dict | list[dict]:
        """Responses to one request or a list of them, in their order; also written to the configured sink."""
        many = queries if isinstance(queries, list) else [queries]
        rows = self.spark.createDataFrame([(i, json.dumps(q)) for i, q in enumerate(many)], "query_id long, request string")
        made = materialise(self.run_frame(rows), "responses")
        sink_of(self.config.get("response_output_policy")).write(made.drop("combo_idx"))
        if self.config["response_persistence_policy"] == "discard_response_from_memory":
            return []
        out = [json.loads(r["response"]) for r in made.orderBy("query_id", "combo_idx").toLocalIterator()]
        return out if isinstance(queries, list) else out[0]
