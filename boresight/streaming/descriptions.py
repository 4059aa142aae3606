"""Parsing streams. A description depends on its own row only, so the batch operators run unchanged and need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import anomaly, compliance, parse


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines of files that come into a folder."""
    return spark.readStream.text(path).select(F.trim("value").alias("description")).where("description <> ''")


def enriched(stream: DataFrame, text: str = "description") -> DataFrame:
    """The stream with d, its anomalies and its compliance."""
    return parse.parse(stream, text).withColumn("anomalies", anomaly.detect(F.col("d"))).withColumn("compliance", compliance.check(F.col("d")))


def start(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the stream to Parquet files, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
