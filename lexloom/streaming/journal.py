"""Journals as streams: idempotent append, deduplicated by event id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import shared_dir
from lexloom.streaming.collections import ROCKSDB


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of a folder (or of several, as a glob), or one Parquet file of it, as a stream."""
    reader = spark.readStream.schema(schema)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)


def append_available(events: DataFrame, target: str, checkpoint: str, key: str) -> None:
    """Appends all that is there now and wasn't appended before, each id once, and stops.

    The ids that were taken stand in the stream's state, on the executors' disks and in the checkpoint, dealt out by their hash, so that
    a batch costs its own rows and never reads the target. A batch that runs again after a failure writes its own folder again.
    """
    spark = events.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    kind = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind)
    spark.conf.set(kind, ROCKSDB)
    try:
        fresh = events.where(F.col(key).isNotNull()).dropDuplicates([key])
        q = fresh.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(kind, before)
    q.awaitTermination()


def run_once(spark: SparkSession, source: str, schema, key: str) -> DataFrame:
    """The journal behind a source after one run of the stream."""
    import uuid

    root = f"{shared_dir(spark)}/lexloom-stream-{uuid.uuid4().hex}"
    append_available(read_events(spark, source, schema), f"{root}/data", f"{root}/state", key)
    return spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data").drop("batch")


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "1 hour") -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n"))
