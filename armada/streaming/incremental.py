"""Streams: snapshots folded as their files arrive, and events counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from armada.operators.changelog import effective
from armada.sources.datasets import SNAPSHOT


def fold_snapshots(spark: SparkSession, folder: str, log: str, checkpoint: str) -> StreamingQuery:
    """Append the headers of arriving snapshot files to the log table (Parquet), in arrival order, until all are read.

    A batch that is run again writes the same folder anew, so each arrival counts once.
    """
    stream = spark.readStream.schema(SNAPSHOT).option("multiLine", True).json(folder)

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.select("org", "date", "pulled_at", (F.col("source") == "manual").alias("manual"), "total_episodes", "total_hours")
        rows = rows.withColumns({"manual": F.coalesce("manual", F.lit(False)), "seq": F.lit(number).cast("long") * (1 << 40) + F.monotonically_increasing_id()})
        rows.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_log(spark: SparkSession, log: str) -> DataFrame:
    """The snapshots that stand after all arrivals of a log."""
    return effective(spark.read.parquet(log).drop("batch"))


def counts_by_window(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events (ts, event_type) counted in tumbling windows; those later than the watermark are dropped by it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").count()
