"""Structured Streaming counterparts of the batch reports, on event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.sources.files import children, drop, is_folder


def read_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream, with ``ts`` as a timestamp that watermarks accept."""
    reader = spark.readStream.schema(schema)
    if not is_folder(spark, path):  # streams read folders
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, width: str = "1 hour", key: str = "event_type", late: str | None = None) -> DataFrame:
    """Counts and sums by window and key; ``late`` is the watermark of a stream."""
    df = df.withWatermark("ts", late) if late else df
    return df.groupBy(F.window("ts", width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), key, "n", "total")


def sliding(df: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str | None = None) -> DataFrame:
    df = df.withWatermark("ts", late) if late else df
    return df.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "n")


def sessions(df: DataFrame, gap: str = "20 minutes", key: str = "user_id", late: str | None = None) -> DataFrame:
    df = df.withWatermark("ts", late) if late else df
    return df.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("session_start"), key, "n", "total")


def distinct_events(df: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once, as long as its repeats come within the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def append_to(df: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], DataFrame] | None = None, mode: str = "append", name: str | None = None):
    """Runs the stream over what is there, appending micro-batches as Parquet; a restarted batch replaces its own folder. In complete mode a batch replaces those before it."""

    def write(batch: DataFrame, n: int) -> None:
        (each(batch, n) if each else batch).write.mode("overwrite").parquet(f"{path}/batch={n}")
        if mode == "complete":
            for old in children(batch.sparkSession, path):
                if not old.endswith(f"/batch={n}"):
                    drop(batch.sparkSession, old)

    writer = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def drain(df: DataFrame, checkpoint: str, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream to its present end and returns the result table, which is read from files beside the state."""
    spark, rows = df.sparkSession, f"{checkpoint}-rows"
    append_to(df, rows, checkpoint, mode=mode, name=name).awaitTermination()
    batches = children(spark, rows)
    return spark.read.schema(df.schema).parquet(*batches) if batches else spark.createDataFrame([], df.schema)
