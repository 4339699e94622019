"""Network files out of map tables that are already there: ids, speeds, grades, headings, stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import line_bearings, line_wkt
from wayfold.functions.text import price_per_kwh


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Ids 0 to n-1 in an order, without one task for all rows: ranges are numbered on their own and offset by counts."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    from wayfold.plans.scratch import materialise

    ranged = materialise(ranged, "ranged")
    counts = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p], total = total, total + counts[p]
    offset = F.element_at(F.create_map(*[x for p, s in starts.items() for x in (F.lit(p), F.lit(s).cast("long"))]), F.col("__part")) if starts else F.lit(0)
    return ranged.withColumn(name, F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1 + offset).drop("__part")


def vertices_of(nodes: DataFrame) -> DataFrame:
    """(vertex_id, osmid, x, y) from (osmid, x, y)."""
    return numbered(nodes.select("osmid", "x", "y"), ["osmid"], "vertex_id").select("vertex_id", "osmid", "x", "y")


def edges_of(links: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges from (u, v, key, length, highway, maxspeed_kph, line): of parallel ones the first, ends as vertex ids."""
    one = links.filter("key = 0")
    end = lambda c, name: vertices.select(F.col("osmid").alias(c), F.col("vertex_id").alias(name))
    joined = one.join(end("u", "src_vertex_id"), "u").join(end("v", "dst_vertex_id"), "v")
    return numbered(joined, ["u", "v"], "edge_id").withColumnRenamed("length", "distance")


def imputed_speeds(edges: DataFrame) -> DataFrame:
    """speed_kph: the tagged one, else its class's mean, else the mean of all."""
    by_class = edges.groupBy("highway").agg(F.avg("maxspeed_kph").alias("__class"))
    overall = edges.agg(F.avg("maxspeed_kph").alias("__all"))
    return edges.join(by_class, "highway", "left").join(F.broadcast(overall)).withColumn("speed_kph", F.coalesce("maxspeed_kph", "__class", "__all")).drop("__class", "__all")


def grades(edges: DataFrame, elevations: DataFrame) -> DataFrame:
    """grade: rise over length between the ends' elevations (vertex_id, elevation_m); 0 for a length of 0."""
    end = lambda side: elevations.select(F.col("vertex_id").alias(f"{side}_vertex_id"), F.col("elevation_m").alias(f"__{side}"))
    joined = edges.join(end("src"), "src_vertex_id", "left").join(end("dst"), "dst_vertex_id", "left")
    return joined.withColumn("grade", F.when(F.col("distance") > 0, (F.col("__dst") - F.col("__src")) / F.col("distance")).otherwise(0.0)).drop("__src", "__dst")


def headings(edges: DataFrame) -> DataFrame:
    """arrival_heading and departure_heading of each line."""
    first, last = line_bearings(F.col("line"))
    return edges.withColumn("arrival_heading", first).withColumn("departure_heading", last)


def write_dataset(vertices: DataFrame, edges: DataFrame, folder: str) -> None:
    """The files that a network is read from, in order of id."""
    vertices.orderBy("vertex_id").select("vertex_id", "x", "y").write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{folder}/vertices")
    ordered = edges.orderBy("edge_id")
    ordered.select("edge_id", "src_vertex_id", "dst_vertex_id", "distance").write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{folder}/edges")
    for name in ("speed_kph", "highway", "grade"):
        if name in edges.columns:
            ordered.select(F.col(name).cast("string")).write.mode("overwrite").option("compression", "gzip").text(f"{folder}/{name}")
    if "line" in edges.columns:
        ordered.select(line_wkt(F.col("line"))).write.mode("overwrite").option("compression", "gzip").text(f"{folder}/geometries")


# Power types and their kW.
POWER = {"L1": 1.8, "L2": 7.2, "DCFC": 150.0}


def station_rows(sites: DataFrame) -> DataFrame:
    """A row for each power type that a site has: x, y, power_type, power_kw, cost_per_kwh from (longitude, latitude,
    ev_level1_num, ev_level2_num, ev_dc_fast_num, ev_pricing)."""
    counts = {"L1": "ev_level1_num", "L2": "ev_level2_num", "DCFC": "ev_dc_fast_num"}
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("power_type"), F.lit(POWER[t]).alias("power_kw"), F.col(c).alias("n")) for t, c in counts.items()]))
    rows = sites.select(F.col("longitude").alias("x"), F.col("latitude").alias("y"), price_per_kwh(F.col("ev_pricing")).alias("cost_per_kwh"), each.alias("p"))
    return rows.filter("p.n > 0").select("x", "y", "p.power_type", "p.power_kw", "cost_per_kwh")


def elevation_tiles(points: DataFrame) -> DataFrame:
    """The different tiles (nXXwYYY) of points (x, y); a point that is not north of the equator and west of Greenwich is an error."""
    tile = F.format_string("n%02dw%03d", F.ceil("y"), F.ceil(-F.col("x")))
    good = (F.col("y") >= 0) & (F.col("x") <= 0)
    return points.select(F.when(good, tile).otherwise(F.raise_error(F.lit("tiles are for points with latitude >= 0 and longitude <= 0"))).alias("tile")).distinct()
