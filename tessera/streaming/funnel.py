"""The funnel as a stream of event files. Beyond what the batch metrics need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.metrics import stage_level


def event_stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet events as they arrive; ts becomes a timestamp that watermarks accept."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def stage_windows(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(begin, stage, events, sessions) of each window, final once it is `late` past; sessions are estimated."""
    level = stage_level(F.col("event_name"), F.col("page_name"))
    known = events.withWatermark("ts", late).select("ts", "session_id", level.alias("stage")).where("stage > 0")
    counts = known.groupBy(F.window("ts", width), "stage").agg(F.count("*").alias("events"), F.approx_count_distinct("session_id").alias("sessions"))
    return counts.select(F.col("window.start").alias("begin"), "stage", "events", "sessions")


def furthest_stage(events: DataFrame) -> DataFrame:
    """(session_id, level): each session's furthest stage so far; state is one number a session."""
    return events.groupBy("session_id").agg(F.max(stage_level(F.col("event_name"), F.col("page_name"))).alias("level"))


def run_once(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what has arrived and ends; files and offsets survive a restart."""
    return rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
