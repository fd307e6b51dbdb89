"""Structured Streaming forms of the replay: arrivals, late labels, last gauges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import write_metric_groups


def arrivals(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files that appear under ``path``, a few per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_event_time(df: DataFrame, column: str = "ts", delay: str = "1 day") -> DataFrame:
    """Watermarks need a timestamp with zone: wall-clock columns are read as UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def daily_counts(events: DataFrame) -> DataFrame:
    """Tumbling days by event type."""
    day = F.window("ts", "1 day")
    return events.groupBy(day.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value")).select(F.col("w.start").alias("day"), "event_type", "n", "max_value")


def late_label_join(predictions: DataFrame, labels: DataFrame, key: str, lag: str) -> DataFrame:
    """Predictions as recorded, joined with labels that come up to ``lag`` later; state is dropped after."""
    return predictions.alias("p").join(labels.alias("y"), _in_time(key, lag), "inner")


def _in_time(key: str, lag: str):
    return (F.col(f"p.{key}") == F.col(f"y.{key}")) & (F.col("y.label_ts") >= F.col("p.ts")) & (F.col("y.label_ts") <= F.col("p.ts") + F.expr(f"INTERVAL {lag}"))


def labels_or_pending(predictions: DataFrame, labels: DataFrame, key: str, lag: str, label: str) -> DataFrame:
    """Every column of ``predictions`` (watermark on ``ts``), the column ``label`` of ``labels`` (watermark on
    ``label_ts``) and ``pending``: a row for each label that comes up to ``lag`` later, or one with 1 and no label.

    A prediction waits in the state of an outer stream-stream join. Once both watermarks are past its
    time plus ``lag`` nothing can come for it any more: it is put out as pending and its state goes. One whose
    time is not over is neither; a restart from the checkpoint takes it up again. State is bounded by the
    rows of ``lag`` plus the watermarks' delay.
    """
    joined = predictions.alias("p").join(labels.alias("y"), _in_time(key, lag), "leftOuter")
    return joined.select("p.*", F.col(f"y.{label}").alias(label), F.col("y.label_ts").isNull().cast("int").alias("pending"))


def last_gauge(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value per key, updated as rows arrive."""
    return events.groupBy(key).agg(F.max_by(value, order).alias("value"), F.max(order).alias("at"))


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there, into a Parquet folder (append) or a memory table."""
    spark = df.sparkSession
    if mode == "append":
        out = f"{checkpoint}/{name}/out"
        df.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/{name}/state").option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(out)
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{checkpoint}/{name}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def replace_groups(metrics: DataFrame, path: str, checkpoint: str) -> None:
    """Each micro-batch of metric rows overwrites the (job, scenario, batch_id) groups it holds and no others, so a
    batch that is run again after a failure leaves the same table."""
    metrics.writeStream.foreachBatch(lambda batch, _: write_metric_groups(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
