"""Tables written once and read back, to cut lineage where every executor can read them.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset (tests, one machine) is a
temporary one made.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []
_paths: dict[int, str] = {}  # by the identity of frames that are alive


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialise(df: DataFrame, tag: str, replaces: DataFrame | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again: computed once, and not lost with an executor.

    ``replaces`` is a frame made here before that nothing but ``df`` needs: its table is deleted, so that a loop keeps one. The
    exchanges of the write are deleted when it has ended, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/wayfold/{tag}-{uuid.uuid4().hex}"
    with _exchanges_end(spark):
        df.write.parquet(path)
    _written.append((spark, path))
    made = spark.read.schema(df.schema).parquet(path)
    _paths[id(made)] = path
    weakref.finalize(made, _paths.pop, id(made), None)
    if replaces is not None:
        discard(replaces)
    return made


def discard(df: DataFrame) -> None:
    """Deletes the table of a frame made here that nothing needs any more."""
    if old := _paths.get(id(df)):
        _delete(df.sparkSession, old)
        _written[:] = [w for w in _written if w[1] != old]


def spread(df: DataFrame, *keys: str, tag: str = "spread", rows: int = 500_000) -> DataFrame:
    """``df``, written, and dealt by ``keys`` (without any: evenly) over as many tasks as leave about ``rows`` to each, so that a
    task's memory does not grow with the table."""
    spark, made = df.sparkSession, materialise(df, tag)
    parts = -(-made.count() // rows)
    cores = spark.sparkContext.defaultParallelism
    if not keys:
        return made.repartition(max(parts, cores))
    return made.repartition(parts, *keys) if parts > cores else made.repartition(*keys)  # the latter may be put together


def written(df: DataFrame) -> bool:
    """Whether ``df`` is a frame that ``materialise`` has made."""
    return id(df) in _paths


@contextlib.contextmanager
def _exchanges_end(spark: SparkSession):
    """While it is open, the shuffle files of an execution go when the execution ends."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Deletes the tables this process has written. Frames that read them are unusable afterwards."""
    global _written
    for owner, path in _written:
        with contextlib.suppress(Exception):
            _delete(spark, path)
    _written = []


@atexit.register
def _clear_at_exit() -> None:
    active = SparkSession.getActiveSession() if _written else None
    if active is not None:
        with contextlib.suppress(Exception):
            clear(active)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps Arrow batches of long texts small: a batch is one unit of Python memory."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
