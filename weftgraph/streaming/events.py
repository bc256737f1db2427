"""Event windows, and streams over files, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import new_path


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events with ``ts`` as a time stamp of the session's zone and a watermark."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if events.isStreaming else out


def tumbling(events: DataFrame, width: str) -> DataFrame:
    """(start, event_type, n, total) by windows of a width."""
    w = timed(events).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    """(start, event_type, n) by overlapping windows."""
    return timed(events).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, end, n) of a user's events less than ``gap`` apart; the end is the last event and the gap."""
    s = timed(events).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_sightings(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return timed(events, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available, with its checkpoint and result in the shared folder, and read it back."""
    spark = df.sparkSession
    path, mark = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", mark).trigger(availableNow=True).outputMode("append").start()
    else:  # each batch's whole result replaces the last

        def keep(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        q = df.writeStream.foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).outputMode("complete").start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def stream_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """(tool, calls, avg_latency_ms) of an event table read as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else folder + "/" + file.replace("events", "event[s]"))
    out = stream.groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), F.round(F.avg("value"), 2).alias("avg_latency_ms"))
    return drained(out, "telemetry", "complete")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
