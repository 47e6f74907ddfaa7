"""Job events as a stream: the latest state of each key, and counts by window (windows are an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)


def run_to_end(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Runs an aggregating stream over all that is there; the last complete result is kept."""
    out = shared_dir(spark, name)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = df.writeStream.outputMode("complete").option("checkpointLocation", shared_dir(spark, "state")).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def stream_job_state(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user; of equal times the larger id."""
    e = event_stream(spark, d).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"), F.count("*").alias("events"))
    return run_to_end(spark, e.select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.event_type").alias("state"), "events"), "jobs")


def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type with a watermark of one day."""
    e = event_stream(spark, d).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("events"))
    return run_to_end(spark, e.select(F.col("window.start").alias("day"), "event_type", "events"), "daily")


QUERIES = {"stream_job_state": stream_job_state, "stream_daily_counts": stream_daily_counts}
ORACLE = {
    "stream_job_state": "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as state, count(*) as events from events group by user_id",
    "stream_daily_counts": "select date_trunc('day', ts) as day, event_type, count(*) as events from events group by 1, 2",
}
