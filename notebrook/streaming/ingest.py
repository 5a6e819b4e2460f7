"""Streaming forms of ingest: counts per time window, and the latest row per key, kept up to date by micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from notebrook.session import ensure_checkpoint_dir


def _settled(out: DataFrame, mode: str, base: str, keys: list[str], version: str | None) -> DataFrame:
    """All input that is there, run to the end. Each batch leaves its rows in a folder of its own, so that a repeated batch replaces
    itself and nothing is rewritten; of each key the row with the highest version counts, where versions are equal or there is none that of
    the latest batch."""
    spark, path = out.sparkSession, f"{base}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*out.schema.fields, StructField("batch", LongType())])
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    rest = [c for c in out.columns if c not in keys and c != version]
    order = [version, "batch"] if version else ["batch"]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("x")).select(*keys, "x.*").drop("batch").select(*out.columns)


def window_counts(spark: SparkSession, source: str, schema, width: str, delay: str = "30 days") -> DataFrame:
    """source is a pattern of files or folders. starts, event_type, n, total per tumbling window, kept up to date by batches. Rows may come up
    to ``delay`` late; what comes later still is left out, as the state of such windows is gone."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(source).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    counts = stream.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    out = counts.select(F.col("w.start").alias("starts"), "event_type", "n", "total")
    return _settled(out, "update", base, ["starts", "event_type"], None)


def latest_rows(spark: SparkSession, source: str, schema, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version of each key over all batches. Each batch is merged when it is read: the stream itself has no state."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    return _settled(spark.readStream.schema(schema).parquet(source), "append", base, keys, version)


def first_deliveries(spark: SparkSession, source: str, schema, keys: list[str], event_time: str, delay: str = "30 days") -> DataFrame:
    """The rows of a stream, each key once, as ``deduplicated`` lets them through."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(source).withColumn(event_time, F.col(event_time).cast("timestamp"))
    return _settled(deduplicated(stream, keys, event_time, delay), "append", base, keys, None)


def deduplicated(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """First deliveries only; state older than the delay is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
