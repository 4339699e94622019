"""Shaping of requests: expansion, injection, weights for balancing, and the split of errors from the rest.

Requests are rows with a JSON text column ``request`` (so that unknown keys pass through), ``query_id``, and ``error`` (null
while there is none). A row with an error is left as it is by every later step.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine_m, in_ring

Plugin = Callable[[DataFrame], DataFrame]


def requests_of(df: DataFrame) -> DataFrame:
    """Adds ``query_id`` (if there is none, a number that grows with the rows' places) and ``error``."""
    if "query_id" not in df.columns:
        df = df.withColumn("query_id", F.monotonically_increasing_id())
    return df if "error" in df.columns else df.withColumn("error", F.lit(None).cast("string"))


def json_value(column: Column, path: str) -> Column:
    return F.get_json_object(column, f"$.{path}")


def number(column: Column, path: str) -> Column:
    return json_value(column, path).try_cast("double")


# -- expansion --------------------------------------------------------------------------------------------------------------


def product(choices: list[list]) -> Iterator[tuple]:
    """Every combination, the first place fastest."""
    if not choices:
        yield ()
        return
    for rest in product(choices[1:]):
        for value in choices[0]:
            yield (value, *rest)


def expand_request(text: str) -> list[tuple[str | None, str | None]]:
    """(request, error) for each combination of the arrays under ``grid_search``."""
    try:
        request = json.loads(text)
    except (TypeError, ValueError) as e:
        return [(text, f"not JSON: {e}")]
    if not isinstance(request, dict):
        return [(text, "a request must be an object")]
    grid = request.pop("grid_search", None)
    if grid is None:
        return [(text, None)]
    if "grid_search" in json.dumps(grid):
        return [(text, "grid_search within grid_search")]
    if not isinstance(grid, dict):
        return [(text, "grid_search must be an object")]
    keys = [k for k, v in grid.items() if isinstance(v, list)]
    made = []
    for values in product([grid[k] for k in keys]):
        one = dict(request)
        for key, value in zip(keys, values, strict=True):
            one |= value if isinstance(value, dict) else {key: value}
        made.append((json.dumps(one), None))
    return made


def grid_search(requests: DataFrame) -> DataFrame:
    """One row for each combination, numbered by ``combo_idx``. Requests without a grid have one row, number 0."""

    def expand(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.to_dict("records"):
                made = [(row["request"], row["error"])] if row["error"] is not None else expand_request(row["request"])
                rows += [row | {"request": text, "error": error, "combo_idx": i} for i, (text, error) in enumerate(made)]
            yield pd.DataFrame(rows, columns=[*part.columns, "combo_idx"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInPandas(expand, f"{schema}, combo_idx int")


def grid_columns(df: DataFrame, choices: dict[str, str]) -> DataFrame:
    """The same for typed columns: ``choices`` maps an array column to the column that takes each of its values.

    Columns only: an explode for each array, with ``combo_idx`` in the order of the product, the first key fastest.
    """
    index, stride = F.lit(0), F.lit(1)
    for k, (source, target) in enumerate(choices.items()):
        df = df.select("*", F.posexplode(source).alias(f"__pos{k}", target))
        index = index + F.col(f"__pos{k}") * stride
        stride = stride * F.size(source)
    return df.withColumn("combo_idx", index.cast("int")).drop(*choices, *(f"__pos{k}" for k in range(len(choices))))


# -- injection --------------------------------------------------------------------------------------------------------------

WRITE_MODES = ("overwrite", "append", "fail_if_existing", "ignore")


def write_value(old, value, mode: str, key: str, has: bool):
    """(value to keep, error)."""
    if mode == "overwrite" or not has:
        return value, None
    if mode == "ignore":
        return old, None
    if mode == "fail_if_existing":
        return old, f"'{key}' is there already"
    if isinstance(old, list):
        return old + (value if isinstance(value, list) else [value]), None
    if isinstance(old, dict) and isinstance(value, dict):
        return old | value, None
    return old, f"'{key}' cannot be appended to"


def inject(requests: DataFrame, key: str, value: Column, mode: str = "overwrite") -> DataFrame:
    """Writes a JSON value (a column of JSON text; null: nothing to write) under ``key`` of each request."""
    if mode not in WRITE_MODES:
        raise ValueError(f"unknown write mode '{mode}'")

    @F.pandas_udf("struct<request:string,error:string>")
    def write(texts: pd.Series, values: pd.Series, errors: pd.Series) -> pd.DataFrame:
        out = []
        for text, new, error in zip(texts, values, errors, strict=True):
            if error is not None or new is None:
                out.append((text, error))
                continue
            try:
                request = json.loads(text)
                kept, failed = write_value(request.get(key), json.loads(new), mode, key, key in request)
                out.append((json.dumps(request | {key: kept}) if failed is None else text, failed))
            except (AttributeError, TypeError, ValueError) as e:
                out.append((text, f"not JSON: {e}"))
        return pd.DataFrame(out, columns=["request", "error"])

    made = requests.withColumn("__new", write("request", value, "error"))
    return made.withColumn("request", F.col("__new.request")).withColumn("error", F.col("__new.error")).drop("__new")


def inject_constant(requests: DataFrame, key: str, value, mode: str = "overwrite") -> DataFrame:
    return inject(requests, key, F.lit(json.dumps(value)), mode)


def polygon_hits(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(point_id, order, value) for each polygon that holds a point: points (point_id, x, y), polygons (order, value, ring).

    Polygons are cut into the cells of a grid of their own mean size, so that the join is on cells.
    """
    boxed = polygons.withColumn("xs", F.transform("ring", lambda p: p["x"].cast("double"))).withColumn("ys", F.transform("ring", lambda p: p["y"].cast("double")))
    boxed = boxed.select("order", "value", "ring", F.array_min("xs").alias("x0"), F.array_max("xs").alias("x1"), F.array_min("ys").alias("y0"), F.array_max("ys").alias("y1"))
    size = boxed.agg(F.greatest(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), F.lit(1e-6))).first()[0] or 1.0
    cells = boxed.withColumn("i", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size)))).withColumn("j", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor(F.col("y1") / size))))
    at = points.withColumn("i", F.floor(F.col("x") / size)).withColumn("j", F.floor(F.col("y") / size))
    near = at.join(cells, ["i", "j"]).filter("x >= x0 AND x <= x1 AND y >= y0 AND y <= y1")
    return near.filter(in_ring(F.col("x"), F.col("y"), F.col("ring"))).select("point_id", "order", "value")


def inject_by_polygon(requests: DataFrame, polygons: DataFrame, key: str, side: str = "origin", default=None, mode: str = "overwrite") -> DataFrame:
    """Writes the value of the first polygon that holds the request's ``side``, else ``default``, else nothing."""
    points = requests.select(F.col("query_id").alias("point_id"), number(F.col("request"), f"{side}_x").alias("x"), number(F.col("request"), f"{side}_y").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    first = polygon_hits(points, polygons).groupBy("point_id").agg(F.min_by("value", "order").alias("__value"))
    joined = requests.join(first, F.col("query_id") == F.col("point_id"), "left")
    value = F.col("__value") if default is None else F.coalesce("__value", F.lit(json.dumps(default)))
    return inject(joined, key, value, mode).drop("point_id", "__value")


# -- weights and balancing --------------------------------------------------------------------------------------------------


def weight_haversine(requests: DataFrame, column: str = "query_weight_estimate") -> DataFrame:
    """Kilometres from origin to destination; a request without both is an error."""
    at = [number(F.col("request"), k) for k in ("origin_x", "origin_y", "destination_x", "destination_y")]
    km = haversine_m(*at) / 1000.0
    return requests.withColumn(column, km).withColumn("error", F.coalesce("error", F.when(km.isNull(), F.lit("a distance weight needs an origin and a destination"))))


def weight_numeric(requests: DataFrame, key: str, column: str = "query_weight_estimate") -> DataFrame:
    value = number(F.col("request"), key)
    return requests.withColumn(column, value).withColumn("error", F.coalesce("error", F.when(value.isNull(), F.lit(f"no number under '{key}'"))))


def weight_categorical(requests: DataFrame, key: str, weights: dict[str, float], default: float | None = None, column: str = "query_weight_estimate") -> DataFrame:
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
    found = F.try_element_at(F.create_map(*pairs), json_value(F.col("request"), key))
    found = F.coalesce(found, F.lit(default).cast("double")) if default is not None else found
    return requests.withColumn(column, found).withColumn("error", F.coalesce("error", F.when(found.isNull(), F.lit(f"no weight for '{key}'"))))


def balance(weights: list[float], bins: int) -> list[list[int]]:
    """Each item in turn to the lightest bin, the lowest of equal ones."""
    heap = [(0.0, b) for b in range(bins)]
    made: list[list[int]] = [[] for _ in range(bins)]
    for i, w in enumerate(weights):
        total, b = heapq.heappop(heap)
        made[b].append(i)
        heapq.heappush(heap, (total + w, b))
    return made


def with_bins(requests: DataFrame, bins: int, order: str = "query_id", weight: str = "query_weight_estimate", group: int = 100_000) -> DataFrame:
    """Adds ``bin``: requests go in turn, in the order of ``order`` and their text, to the lightest bin so far.

    The turns are taken within ranges of the order, of about ``group`` requests each, and each range starts with a bin of its
    own as the first of equal ones: up to ``group`` requests that is the sequential assignment, beyond it the bins of each
    range are balanced, and so are their sums. A missing weight counts 1. Every row keeps its bin, whatever repeats or is null.
    """
    value = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight in requests.columns else F.lit(1.0)
    ranges = max(1, -(-requests.count() // group))
    tie = F.xxhash64(*[F.col(c).cast("string") for c in requests.columns])
    keyed = requests.withColumn("__weight", value).withColumn("__tie", tie)
    placed = keyed.repartition(1) if ranges == 1 else keyed.repartitionByRange(ranges, F.col(order), "__tie")
    placed = placed.sortWithinPartitions(order, "__tie").withColumn("__range", F.spark_partition_id())

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heap: list[tuple[float, int]] = []
        for part in parts:
            made = []
            for w, first in zip(part["__weight"], part["__range"], strict=True):
                heap = heap or sorted((0.0, b, (b + int(first)) % bins) for b in range(bins))
                total, turn, b = heapq.heappop(heap)
                made.append(b)
                heapq.heappush(heap, (total + w, turn, b))
            yield part.drop(columns=["__weight", "__tie", "__range"]).assign(bin=pd.Series(made, index=part.index, dtype="int32"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return placed.mapInPandas(assign, f"{schema}, bin int")


# -- plugins ----------------------------------------------------------------------------------------------------------------


def apply_plugins(requests: DataFrame, plugins: list[Plugin]) -> DataFrame:
    """The requests after all plugins, those with an error among them."""
    now = requests_of(requests)
    for plugin in plugins:
        now = plugin(now)
    return now


def run_plugins(requests: DataFrame, plugins: list[Plugin]) -> tuple[DataFrame, DataFrame]:
    """(requests that may go on, responses of those with an error)."""
    now = apply_plugins(requests, plugins)
    failed = now.filter("error IS NOT NULL")
    return now.filter("error IS NULL"), failed.select("query_id", "request", "error")


def debug(requests: DataFrame, log: Callable[[str], None] = print, n: int = 20) -> DataFrame:
    """Logs some requests, and changes nothing."""
    for row in requests.select("request").limit(n).collect():
        log(row["request"])
    return requests


def merged_map(config: dict[str, float], column: Column) -> Column:
    """A map of the configuration's keys with the request's before them."""
    pairs = [x for k, v in config.items() for x in (F.lit(k), F.lit(float(v)))]
    base = F.create_map(*pairs) if pairs else F.from_json(F.lit("{}"), "map<string,double>")
    own = F.coalesce(column, F.from_json(F.lit("{}"), "map<string,double>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)


def state_overrides(request: dict, known: dict[str, str]) -> dict[str, float]:
    """``state_features`` of a request; an unknown name or a value that is no number is an error."""
    made = {}
    for name, spec in (request.get("state_features") or {}).items():
        if name not in known:
            raise ValueError(f"unknown state feature '{name}'")
        if isinstance(spec, dict) and "type" in spec and spec["type"] != known[name]:
            raise ValueError(f"state feature '{name}' is a {known[name]}, not a {spec['type']}")
        value = spec.get("initial") if isinstance(spec, dict) else spec
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"state feature '{name}' needs a number")
        made[name] = float(value)
    return made
