"""Sinks for responses (query_id, response as JSON text): files in several formats, one policy or several."""

from __future__ import annotations

import gzip
import json
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = {"append": "append", "overwrite": "overwrite", "error": "errorifexists"}
TYPES = {"string": "string", "float": "double", "int": "long", "int32": "int", "bool": "boolean"}


class SinkError(ValueError):
    """A sink that cannot write what it is given."""


def path_value(response: Column, path: str) -> Column:
    """The text at a dotted path; null if there is nothing."""
    return F.get_json_object(response, "$." + path)


@dataclass(frozen=True)
class Mapping:
    """How a column comes from a response: a path, the sum of mappings, or an optional mapping."""

    kind: str
    path: str | None = None
    parts: tuple[Mapping, ...] = ()
    dtype: str | None = None

    @classmethod
    def of(cls, spec: Any) -> Mapping:
        if isinstance(spec, str):
            return cls("path", spec)
        if "path" in spec:
            return cls("path", spec["path"], (), spec.get("dtype"))
        if "sum" in spec:
            return cls("sum", None, tuple(cls.of(s) for s in spec["sum"]), spec.get("dtype"))
        if "optional" in spec:
            return cls("optional", None, (cls.of(spec["optional"]),), spec.get("dtype"))
        raise SinkError(f"unknown mapping {spec}")

    def columns(self, response: Column) -> tuple[Column, Column]:
        """(text or null, error or null)."""
        if self.kind == "path":
            value = path_value(response, self.path)
            return value, F.when(value.isNull(), F.lit(f"nothing at '{self.path}'"))
        if self.kind == "optional":
            return self.parts[0].columns(response)[0], F.lit(None).cast("string")
        total, error = F.lit(0.0), F.lit(None).cast("string")
        for part in self.parts:
            text, _ = part.columns(response)
            value = text.try_cast("double")
            total = total + F.coalesce(value, F.lit(0.0))
            error = F.coalesce(error, F.when(text.isNotNull() & value.isNull(), F.concat(F.lit("no number: "), text)))
        return F.when(error.isNull(), total.cast("string")), error


def mapped(responses: DataFrame, mapping: dict[str, Any], sort: bool = False) -> DataFrame:
    """A column for each mapping, in the given order or sorted; ``error`` says which failed (their cells are null)."""
    names = sorted(mapping) if sort else list(mapping)
    values, errors = [], []
    for name in names:
        m = Mapping.of(mapping[name])
        value, error = m.columns(F.col("response"))
        values.append((value.try_cast(TYPES[m.dtype]) if m.dtype else value).alias(name))
        errors.append(F.when(error.isNotNull(), F.concat(F.lit(f"{name}: "), error)))
    return responses.select("query_id", *values, F.nullif(F.concat_ws("; ", *errors), F.lit("")).alias("error"))


@dataclass
class Sink:
    """One policy: none, json (an array in one file), ndjson, csv or parquet; gzip for a path that ends in .gz."""

    kind: str = "none"
    path: str | None = None
    mode: str = "append"
    mapping: dict[str, Any] = field(default_factory=dict)
    sort: bool = False

    def write(self, responses: DataFrame) -> None:
        if self.kind == "none":
            return
        mode, packed = MODES[self.mode], self.path.endswith(".gz")
        if self.kind == "ndjson":
            responses.select(F.col("response").alias("value")).write.mode(mode).option("compression", "gzip" if packed else "none").text(self.path)
        elif self.kind == "csv":
            rows = mapped(responses, self.mapping, self.sort).drop("query_id", "error")
            rows.write.mode(mode).option("header", True).option("compression", "gzip" if packed else "none").csv(self.path)
        elif self.kind == "parquet":
            rows = mapped(responses, self.mapping, self.sort).drop("error") if self.mapping else responses
            rows.write.mode(mode).parquet(self.path)
        elif self.kind == "json":
            self._array(responses)
        else:
            raise SinkError(f"unknown sink '{self.kind}'")

    def _array(self, responses: DataFrame) -> None:
        """An array of indented objects, streamed row by row through the driver."""
        if os.path.exists(self.path) and self.mode == "error":
            raise SinkError(f"{self.path} is there already")
        kept = []
        opened = gzip.open if self.path.endswith(".gz") else open
        if os.path.exists(self.path) and self.mode == "append":
            with opened(self.path, "rt", encoding="utf-8") as f:
                kept = json.load(f)
        with opened(self.path, "wt", encoding="utf-8") as f:
            f.write("[")
            first = True
            for text in [json.dumps(k) for k in kept]:
                f.write(("\n" if first else ",\n") + json.dumps(json.loads(text), indent=2))
                first = False
            for row in responses.select("response").toLocalIterator():
                f.write(("\n" if first else ",\n") + json.dumps(json.loads(row["response"]), indent=2))
                first = False
            f.write("\n]\n")


@dataclass
class Combined:
    sinks: list[Sink] = field(default_factory=list)

    def write(self, responses: DataFrame) -> None:
        """Each policy in turn, over rows that are computed once."""
        kept = responses.persist()
        try:
            for sink in self.sinks:
                sink.write(kept)
        finally:
            kept.unpersist()


def sink_of(spec: dict | list | None):
    if not spec:
        return Sink()
    if isinstance(spec, list) or spec.get("type") == "combined":
        return Combined([sink_of(s) for s in (spec if isinstance(spec, list) else spec["policies"])])
    form = spec.get("format", {})
    kind = spec.get("type", "none")
    if kind == "file":
        name = form.get("type", "json")
        kind = "csv" if name == "csv" else "ndjson" if form.get("newline_delimited") else "json"
    return Sink(kind, spec.get("filename") or spec.get("path"), spec.get("write_mode", "append"), form.get("mapping") or spec.get("mapping", {}), bool(form.get("sorted", spec.get("sorted", False))))


def flattened(df: DataFrame) -> DataFrame:
    """Structs as dotted columns, at any depth: responses as a table."""
    from pyspark.sql import types as T

    def walk(schema: T.StructType, path: str) -> list[Column]:
        out = []
        for f in schema.fields:
            name = f"{path}.{f.name}" if path else f.name
            quoted = ".".join(f"`{p}`" for p in name.split("."))
            out += walk(f.dataType, name) if isinstance(f.dataType, T.StructType) else [F.col(quoted).alias(name)]
        return out

    return df.select(*walk(df.schema, ""))


def tree_features(responses: DataFrame, path: str = "tree") -> DataFrame:
    """(tree_id, edge_id, properties, geometry) of the GeoJSON trees in responses, one row for each feature."""
    features = F.from_json(F.get_json_object("response", f"$.{path}.features"), "array<struct<properties:string,geometry:string>>")
    rows = responses.select(F.col("query_id").alias("tree_id"), F.explode(features).alias("f"))
    return rows.select("tree_id", F.get_json_object("f.properties", "$.edge_id").cast("long").alias("edge_id"), F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry"))
