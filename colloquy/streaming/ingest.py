"""Incremental import of normalised conversations by Structured Streaming.

The reference system imports by hand; this is the same operator over a folder
that fills up. A conversation is taken once by its fingerprint within the
watermark; what came before that is found by the batch anti-join of
``sources.ingest``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "fingerprint string, conversation_id string, source string, title string, imported_at timestamp"


def arrivals(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of conversation rows (JSON lines) as files arrive."""
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", files_per_trigger).json(path)


def once(rows: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each fingerprint once within the watermark, whose state it also bounds."""
    return rows.withWatermark("imported_at", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def hourly(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Imports by source and hour; late rows count until the watermark passes."""
    return rows.withWatermark("imported_at", delay).groupBy(F.window("imported_at", "1 hour"), "source").agg(F.count(F.lit(1)).alias("n"))


def start(rows: DataFrame, path: str, checkpoint: str):
    """Appends to a Parquet table until all present files are taken."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
