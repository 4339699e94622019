"""Joins of many rows with a table that has one row for each key, where a few keys may hold most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are hot whatever the number of partitions: so many rows are no burden to one task.
FEW = 20_000


def join_counted(rows: DataFrame, table: DataFrame, on: list[tuple[str, str]], n: str, how: str = "inner", total: int | None = None, merge: bool = False) -> DataFrame:
    """``rows`` joined with ``table`` on pairs of columns; ``table`` has each key once, with the number ``n`` of its rows.

    A key with more rows than a quarter of a partition's share is hot. There are fewer hot keys than four times the shuffle
    partitions, whatever the data: they are broadcast and their rows stay where they are. The rest is an ordinary join. Both
    frames are read several times, so they should be written tables. ``how``: inner or left; ``total``: the sum of ``n``, if it is
    known; ``merge``: the rest is not broadcast even if Spark finds it small.
    """
    test = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in on])

    def joined(rows: DataFrame, table: DataFrame) -> DataFrame:
        return rows.join(table.hint("merge") if merge else table, test, how)

    if total is not None and total <= FEW:
        return joined(rows, table)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = table.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    most = max(int(told[0]) // (4 * parts), FEW)
    if told[1] <= most:
        return joined(rows, table)
    hot = table.filter(F.col(n) > most)
    keys = hot.select(*(b for _, b in on))
    rest = rows.join(F.broadcast(keys), test, "left_anti")
    return joined(rest, table.filter(F.col(n) <= most)).unionByName(rows.join(F.broadcast(hot), test))
