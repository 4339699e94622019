"""A road network and requests made from the driver's part, lineitem and orders tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators.graph import Network
from wayfold.plans.scratch import materialise


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def derived_vertices(part: DataFrame) -> DataFrame:
    x = F.lit(-105.0) + (F.col("p_partkey") * 7919 % 1000) / 1000.0
    y = F.lit(39.0) + (F.col("p_partkey") * 104729 % 1000) / 1000.0
    return part.select(F.col("p_partkey").alias("vertex_id"), x.alias("x"), y.alias("y"))


def derived_edges(lineitem: DataFrame) -> DataFrame:
    """Consecutive parts of an order; metres from quantities, so that costs are whole numbers."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    legs = lineitem.select(
        F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.floor(F.col("l_quantity") * 100).cast("long").alias("metres"),
        F.round(F.col("l_tax") * 100).cast("int").alias("tax"), F.round(F.col("l_discount") * 100).cast("int").alias("discount"), "l_returnflag",
    ).filter("dst IS NOT NULL AND src <> dst")
    edges = legs.groupBy("src", "dst").agg(F.min("metres").alias("metres"), F.min("tax").alias("tax"), F.min("discount").alias("discount"), F.min("l_returnflag").alias("road_class"))
    return edges.select(
        F.lit(0).alias("edge_list_id"), _numbered(edges), "src", "dst", F.col("metres").cast("double").alias("distance_m"), (30 + 10 * F.col("tax")).cast("double").alias("speed_kph"),
        ((F.col("discount") - 5) / 100.0).alias("grade"), "road_class", (F.col("src") * 37 % 360).cast("int").alias("arrival_heading"), (F.col("dst") * 53 % 360).cast("int").alias("departure_heading"),
    )


def _numbered(edges: DataFrame):
    """Edges by (src, dst): an id that needs no order over all rows, as (src, dst) is unique and vertices are below 2 ** 31."""
    return (F.col("src") * F.lit(1 << 31) + F.col("dst")).alias("edge_id")


def derived_network(spark: SparkSession, sf_dir: str) -> Network:
    part, lineitem = tables(spark, sf_dir, "part", "lineitem")
    vertices, edges = derived_vertices(part), derived_edges(lineitem)
    known = vertices.select("vertex_id")
    edges = edges.join(known.withColumnRenamed("vertex_id", "src"), "src", "left_semi").join(known.withColumnRenamed("vertex_id", "dst"), "dst", "left_semi")
    return Network(vertices, materialise(Network(vertices, edges).wide_edges(), "network"))


def derived_requests(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    """query_id, origin, destination from the orders with the smallest keys."""
    orders, part = tables(spark, sf_dir, "orders", "part")
    v = part.agg(F.count("*").alias("v"))
    ends = orders.join(F.broadcast(v)).select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % F.col("v")).alias("origin"), (F.col("o_orderkey") * 31 % F.col("v")).alias("destination"))
    return ends.filter("origin <> destination").orderBy("query_id").limit(n)
