"""Requests as a stream: newline JSON files that arrive in a folder, answered batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def request_stream(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """(request, error): a line that is no JSON has an error, and the others go on."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder)
    rows = lines.select(F.trim("value").alias("request")).filter("request <> ''")
    return rows.withColumn("error", F.when(F.expr("try_parse_json(request) IS NULL"), F.lit("not JSON")))


def answer_stream(app, stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts answering; responses are appended as Parquet under ``out``, each batch in a folder of its own, so that a batch
    that is done again after a failure replaces what it had written."""

    def answer(batch: DataFrame, number: int) -> None:
        app.run_frame(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
