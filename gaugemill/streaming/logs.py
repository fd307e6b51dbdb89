"""Log lines shipped from appended files into a table by label and day, and queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a line that become labels.
LABELS = ("batch_id", "scenario", "stage", "status", "level")
#: The labels with few values, which make folders beside the day.
FOLDERS = ("day", "level")
UNPARSED = "unparsed"


def labelled(lines: DataFrame) -> DataFrame:
    """``ts`` (timestamp), the labels, ``line`` as it is and ``day`` of JSON lines in ``value``. Blank lines give no row; one that
    is no JSON keeps its text, has the level ``unparsed`` and neither time nor labels, so nothing is lost."""
    fields = ", ".join(f"{x} string" for x in ("ts", *LABELS))
    r = lines.where(F.trim("value") != "").select(F.from_json("value", fields).alias("r"), F.col("value").alias("line"))
    known = F.col("r.ts").isNotNull() | F.coalesce(*[F.col(f"r.{x}") for x in LABELS]).isNotNull()
    level = F.when(known, F.coalesce("r.level", F.lit("none"))).otherwise(F.lit(UNPARSED))
    rows = r.select(F.col("r.ts").try_cast("timestamp").alias("ts"), *[F.col(f"r.{x}").alias(x) for x in LABELS if x != "level"], level.alias("level"), "line")
    return rows.withColumn("day", F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("none")))


def ship(spark: SparkSession, source: str, out: str, checkpoint: str) -> None:
    """Takes up all files that came under ``source`` since the last call. A file is read once: lines are appended as new files."""
    stream = labelled(spark.readStream.text(source))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy(*FOLDERS).trigger(availableNow=True).start().awaitTermination()


def read(spark: SparkSession, out: str) -> DataFrame:
    columns = ", ".join(["ts timestamp", *[f"{x} string" for x in LABELS if x != "level"], "line string", "day string", "level string"])
    return spark.read.schema(columns).parquet(out)


def matching(logs: DataFrame, start: str | None = None, end: str | None = None, contains: str | None = None, **labels: str) -> DataFrame:
    """Lines from ``start`` up to but not at ``end`` (timestamps as text) whose labels match: ``level="error"``, or with a tilde in front a
    regular expression for the whole label; ``contains`` is looked for in the line. Day and level choose folders; others are not read."""
    out = logs
    for k, v in labels.items():
        if k not in LABELS:
            raise ValueError(f"no label {k}")
        out = out.where(F.col(k).rlike(f"^(?:{v[1:]})$") if v.startswith("~") else F.col(k) == v)
    if start is not None:
        out = out.where((F.col("day") >= start[:10]) & (F.col("ts") >= F.lit(start).cast("timestamp")))
    if end is not None:
        out = out.where((F.col("day") <= end[:10]) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return out if contains is None else out.where(F.contains("line", F.lit(contains)))


def rate(logs: DataFrame, *by: str) -> DataFrame:
    """Lines for each day and label."""
    return logs.groupBy("day", *by).agg(F.count(F.lit(1)).alias("lines"))
