"""Small networks with known answers."""

from wayfold.operators.cost import CostModel, Rate
from wayfold.operators.graph import Network
from wayfold.operators.models import Distance
from wayfold.plans.search import Setup

EDGES = "edge_list_id int, edge_id long, src long, dst long, distance_m double"
SQUARE = [(0, 1, 10), (1, 0, 10), (1, 2, 2), (2, 1, 2), (2, 3, 1), (3, 2, 1), (3, 0, 2), (0, 3, 2)]
CROSS = [(0, 1, 1), (1, 0, 1), (0, 2, 1), (2, 0, 1), (0, 3, 1), (3, 0, 1), (0, 4, 1), (4, 0, 1), (4, 5, 1)]


def network(spark, rows, places=None, more=None):
    n = max(max(r[0], r[1]) for r in rows) + 1
    vertices = spark.createDataFrame([(i, *(map(float, places[i]) if places else (0.0, 0.0))) for i in range(n)], "vertex_id long, x float, y float")
    edges = spark.createDataFrame([(0, i, s, d, float(k) * 1000, *(more[i] if more else ())) for i, (s, d, k) in enumerate(rows)], EDGES + (", speed_kph double" if more else ""))
    return Network(vertices, edges)


def requests(spark, pairs):
    return spark.createDataFrame([(i, o, d) for i, (o, d) in enumerate(pairs)], "query_id long, origin long, destination long")


def kilometres(**more):
    return Setup([Distance()], CostModel({"trip_distance": 1.0}, {"trip_distance": Rate("distance", 1.0, "kilometers")}), **more)
