"""Answers that arrive in a folder, scored as they come; a restart goes on where the last run ended.

This goes beyond batch resuming: the source remembers which files it has read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sentiment import hint_key, hint_value


def watched(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def running_scores(evidence: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Per window, place and factor: mentions and the mean sentiment, rows later than `late` left out."""
    value = hint_value(hint_key(F.col("hint")))
    return evidence.withWatermark("ts", late).groupBy(F.window("ts", width), "place", "factor").agg(F.count(F.lit(1)).alias("mentions"), F.avg(value).alias("score"))


def appended(stream: DataFrame, target: str, checkpoint: str):
    """Write what is there and stop; each file is read once over all runs."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
