"""The task queue as a stream: batches of tasks are processed once, and their states written back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(tasks: DataFrame, most: int = 100) -> DataFrame:
    """The next image tasks, by id."""
    return tasks.filter("task_type = 'image' and status = 'pending'").orderBy("id").limit(most)


def outcomes(tasks: DataFrame, images: DataFrame) -> DataFrame:
    """A task whose image is missing fails and counts a retry; others complete."""
    own = images.select(F.col("id").alias("image_id"), F.lit(True).alias("found"))
    joined = tasks.join(own, "image_id", "left")
    return joined.select("id", "image_id", F.when(F.col("found"), "completed").otherwise("failed").alias("status"), (F.col("retry_count") + F.when(F.col("found"), 0).otherwise(1)).alias("retry_count"))


def start(spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files: int = 1, every: str | None = None) -> StreamingQuery:
    """Each new file of ``source`` is a batch; a task is processed once, and its outcome appended to ``target`` by batch number, so that a repeated batch overwrites its own."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        process(df.dropDuplicates(["id"])).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per key and tumbling window, late rows dropped beyond the watermark; for batches and streams alike."""
    own = events.withColumn("_time", F.col(time).cast("timestamp"))
    counted = own.withWatermark("_time", late).groupBy(F.window("_time", window).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")
