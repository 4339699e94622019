"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.hot import FEW, join_counted
from wayfold.plans.scratch import materialise


class Forest:
    """Union-find over the nodes it has seen; the smallest node of a set is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (above := self.up.setdefault(root, root)) != root:
            root = above
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def contracted(edges: DataFrame, chunk: int = 2_000_000) -> DataFrame:
    """Each partition's edges as stars (node, smallest node of its set in the partition): never more edges than nodes.

    A partition is taken ``chunk`` edges at a time, so memory is bounded whatever it holds.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(forest: Forest) -> pa.RecordBatch:
            pairs = [(x, root) for x in forest.up if (root := forest.find(x)) != x]
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        forest, seen = Forest(), 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            seen += batch.num_rows
            if seen >= chunk:
                yield flush(forest)
                forest, seen = Forest(), 0
        yield flush(forest)

    return edges.select("a", "b").mapInArrow(stars, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a long, b long): the smallest node that can be reached.

    Large-star and small-star steps in turn until nothing changes: each is a minimum for each node, joined back, so that no
    neighbourhood is gathered in one place; a hub's minimum is sent to its edges and not they to it. Edges are written to the shared folder after each turn; only counts come to the
    driver. An empty edge list has no components; loops and repeated edges change nothing.
    """
    now = materialise(contracted(edges.filter("a <> b")).filter("a <> b").distinct(), "edges")
    before, written, n = None, None, now.count()
    for _ in range(rounds):
        # Large-star: every neighbour greater than a node is linked to the least of the node and its neighbours.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("hub")).agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        if 2 * n > FEW:  # there may be hubs
            least = materialise(least, "least", written)
            written = least
        large = join_counted(both.filter("b > a"), least, [("a", "hub")], "n", total=2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small-star: a node and its lesser neighbours are linked to the least of those.
        lesser = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        small = lesser.groupBy("a").agg(F.min("b").alias("m"))
        linked = lesser.join(small, "a")
        after = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(small.select("a", F.col("m").alias("b"))).distinct()
        now = materialise(after, "edges", now)
        stats = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(stats) == before:
            break
        before, n = tuple(stats), stats[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
