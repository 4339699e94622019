"""Sources: network files, attribute files, requests, vehicles' stations, polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.functions.geo import LINE, points_of_wkt
from wayfold.operators.graph import Network, NetworkError
from wayfold.operators.matching import nearest_vertex
from wayfold.plans.scratch import materialise

VERTICES = "vertex_id long, x float, y float"
EDGES = "edge_id long, src_vertex_id long, dst_vertex_id long, distance double"


def read_csv(spark: SparkSession, path: str | list[str], columns: str) -> DataFrame:
    """Typed rows of CSV files with a header, gzip by suffix: columns in any order, others ignored, white space trimmed.

    A value that does not fit its type is an error when it is read.
    """
    wanted = T._parse_datatype_string(columns)
    raw = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = {c.strip(): c for c in raw.columns}
    missing = [f.name for f in wanted.fields if f.name not in named]
    if missing:
        raise NetworkError(f"{path} has no column {missing}")
    return raw.select(*[F.col(f"`{named[f.name]}`").cast(f.dataType).alias(f.name) for f in wanted.fields])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, value): the lines of a file in order, from 0; of a folder, those of its files in the order of their names.

    Splits do not matter: a line's place in its split, after the lines of all splits before it, is its order. Only the splits'
    counts meet in one task.
    """
    at = ["file", "start"]
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    lines = materialise(read, "lines")  # ids are given once
    splits = lines.groupBy(*at).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(F.broadcast(splits.select(*at, "first", before.alias("before"))), at).select((F.col("before") + F.col("id") - F.col("first")).alias("row"), "value")


DECODERS: dict[str, str] = {"string": "string", "u8": "smallint", "f64": "double", "i64": "long", "u64": "long", "bool": "boolean"}


def decode(value: Column, kind: str) -> Column:
    """A trimmed text as a typed value; null if it is none (u8 and u64: also below 0, u8: above 255)."""
    made = F.trim(value).try_cast(DECODERS[kind])
    if kind == "u8":
        return F.when(made.between(0, 255), made)
    return F.when(made >= 0, made) if kind == "u64" else made


def decoded(lines: DataFrame, kind: str, key: str = "edge_id") -> DataFrame:
    """(key, value) of a file of lines; a line that does not decode is an error that names it."""
    out = lines.select(F.col("row").alias(key), decode(F.col("value"), kind).alias("value"), F.col("value").alias("text"))
    bad = out.filter("value IS NULL").limit(1).collect()
    if bad:
        raise NetworkError(f"line {bad[0][key]}: '{bad[0]['text']}' is no {kind}")
    return out.select(key, "value")


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, VERTICES)


def read_edges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The edge lists, numbered in their order. Distances are metres."""
    out = None
    for i, path in enumerate([paths] if isinstance(paths, str) else paths):
        e = read_csv(spark, path, EDGES).select(F.lit(i).alias("edge_list_id"), "edge_id", F.col("src_vertex_id").alias("src"), F.col("dst_vertex_id").alias("dst"), F.col("distance").alias("distance_m"))
        out = e if out is None else out.unionByName(e)
    return out


def read_network(spark: SparkSession, vertices: str, edges: str | list[str], check: bool = True) -> Network:
    made = Network(read_vertices(spark, vertices), read_edges(spark, edges))
    return made.validated() if check else made


def read_attribute(spark: SparkSession, path: str, kind: str, edge_list_id: int = 0) -> DataFrame:
    """(edge_list_id, edge_id, value) of a file with a line for each edge."""
    return decoded(read_lines(spark, path), kind).withColumn("edge_list_id", F.lit(edge_list_id))


def read_sparse(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(edge_id, value)"""
    return read_csv(spark, path, f"edge_id long, value {kind}")


def read_lines_of_edges(spark: SparkSession, path: str, network: Network, edge_list_id: int = 0) -> DataFrame:
    """(edge_list_id, edge_id, line) of a file of WKT lines; as many lines as edges, and all of them LINESTRINGs."""
    lines = read_lines(spark, path).select(F.col("row").alias("edge_id"), points_of_wkt(F.col("value")).cast(LINE).alias("line"))
    r = lines.agg(F.count("*").alias("n"), F.count("line").alias("good")).first()
    n = network.edges.filter(F.col("edge_list_id") == edge_list_id).count()
    if r["n"] != n:
        raise NetworkError(f"{path} has {r['n']} lines for {n} edges")
    if r["good"] != r["n"]:
        raise NetworkError(f"{path} has {r['n'] - r['good']} lines that are no LINESTRING")
    return lines.withColumn("edge_list_id", F.lit(edge_list_id))


def read_headings(spark: SparkSession, path: str) -> DataFrame:
    """(edge_id, arrival_heading, departure_heading) in line order."""
    lines = read_lines(spark, path)
    head = [h.strip() for h in lines.filter("row = 0").first()["value"].split(",")]
    part = lambda name: F.trim(F.try_element_at(F.split("value", ","), F.lit(head.index(name) + 1))).try_cast("smallint") if name in head else F.lit(None).cast("smallint")
    return lines.filter("row > 0 AND trim(value) <> ''").select((F.col("row") - 1).alias("edge_id"), part("arrival_heading").alias("arrival_heading"), F.coalesce(part("departure_heading"), part("arrival_heading")).alias("departure_heading"))


def read_turn_restrictions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "prev_edge_id long, next_edge_id long")


def read_vehicle_restrictions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "edge_id long, name string, value double, operation string, unit string")


def read_network_costs(spark: SparkSession, path: str, key: str = "edge_id") -> DataFrame:
    return read_csv(spark, path, f"{key} long, cost double")


def read_stations(spark: SparkSession, path: str, network: Network) -> DataFrame:
    """Stations at their nearest vertices: vertex_id, power_type (L1, L2, DCFC), power_kw, cost_per_kwh; the last in the file
    counts where several share a vertex."""
    raw = read_csv(spark, path, "power_type string, power_kw double, cost_per_kwh double, x double, y double").withColumn("point_id", F.monotonically_increasing_id())
    raw = raw.withColumn("power_type", F.upper(F.trim("power_type")))
    bad = raw.filter(~F.col("power_type").isin("L1", "L2", "DCFC")).limit(1).collect()
    if bad:
        raise NetworkError(f"unknown power type '{bad[0]['power_type']}'")
    return stations_at_vertices(raw, network)


def stations_at_vertices(stations: DataFrame, network: Network) -> DataFrame:
    at = nearest_vertex(stations.select("point_id", "x", "y"), network)
    last = stations.join(at.select("point_id", "vertex_id"), "point_id").groupBy("vertex_id").agg(F.max_by(F.struct("power_type", "power_kw", "cost_per_kwh"), "point_id").alias("s"))
    return last.select("vertex_id", "s.*")


def with_stations(network: Network, stations: DataFrame) -> Network:
    """Adds station_type and station_kw of each edge's end."""
    side = stations.select(F.col("vertex_id").alias("dst"), F.col("power_type").alias("station_type"), F.col("power_kw").alias("station_kw"))
    return Network(network.vertices, network.wide_edges().join(side, "dst", "left"), network.turn_restrictions, network.notes)


def read_polygons(spark: SparkSession, path: str, prop: str | None = None) -> DataFrame:
    """(order, value as JSON text, ring) of a GeoJSON FeatureCollection; a multi-polygon has a row for each of its polygons.

    The value is the property ``prop``, or all properties as an object. Features without a geometry or the property, and those
    that are no polygons, are errors.
    """
    schema = "type string, features array<struct<type:string,properties:string,geometry:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d")).select(F.posexplode("d.features").alias("order", "f"))
    kind = F.get_json_object("f.geometry", "$.type")
    value = F.col("f.properties") if prop is None else F.to_json(F.try_variant_get(F.try_parse_json("f.properties"), f"$['{prop}']", "variant"))
    rows = rows.select("order", value.alias("value"), kind.alias("kind"), F.get_json_object("f.geometry", "$.coordinates").alias("at"))
    bad = rows.filter("kind IS NULL OR kind NOT IN ('Polygon', 'MultiPolygon') OR value IS NULL").limit(1).collect()
    if bad:
        raise NetworkError(f"feature {bad[0]['order']}: a polygon with the property '{prop}' is needed")
    one = F.from_json("at", "array<array<array<double>>>")
    many = F.from_json("at", "array<array<array<array<double>>>>")
    outer = F.when(F.col("kind") == "Polygon", F.array(one[0])).otherwise(F.transform(many, lambda p: p[0]))
    ring = rows.select("order", "value", F.explode(outer).alias("ring"))
    return ring.select("order", "value", F.transform("ring", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(request) of a JSON file that holds an object or an array of them."""
    text = spark.read.text(path, wholetext=True)
    each = F.when(F.trim("value").startswith("["), F.expr("transform(cast(try_parse_json(value) as array<variant>), v -> to_json(v))")).otherwise(F.array(F.trim("value")))
    return text.select(F.explode(each).alias("request"))


def read_request_lines(spark: SparkSession, path: str) -> DataFrame:
    """(request, error) of newline JSON: a line that is no JSON has an error, the others go on; empty lines are nothing."""
    lines = spark.read.text(path).select(F.trim("value").alias("request")).filter("request <> ''")
    return lines.withColumn("error", F.when(F.expr("try_parse_json(request) IS NULL"), F.lit("not JSON")))
