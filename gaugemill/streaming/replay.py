"""Replay of a monitored model: months arrive in order, labels come some months later.

Each micro-batch records its predictions, publishes the gauges of the months it touches, and delivers the labels of
the months that are due, measured against the predictions as they were recorded. All three writes replace whole groups,
so a batch that runs again leaves the same tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.monitor import LABEL_LAG, pending_flag, stage_codes, to_metrics
from ..sources.sinks import write_metric_groups

PREDICTIONS = "row_id long, p double, ok boolean, scenario string, month int, arrival long"
METRICS = "metric string, value double, job string, scenario string, batch_id string"


@dataclass
class Replay:
    """``labels`` has ``row_id`` and ``y`` (0/1). ``score`` and ``ok`` are columns of what arrives (``scenario, month, row_id``
    and features): the model's probability and whether the row keeps the contract. A month with a larger share than
    ``tolerance`` of other rows is blocked: it has stage codes and a verdict, but neither scores nor labels."""

    spark: SparkSession
    root: str
    labels: DataFrame
    score: Column
    ok: Column
    last_month: int
    lag: int = LABEL_LAG
    tolerance: float = 0.0
    min_rows: int = 1000

    def recorded(self, months: list[int]) -> DataFrame:
        """Predictions as they were recorded; only the folders of these months are read."""
        return self.spark.read.schema(PREDICTIONS).parquet(f"{self.root}/predictions").where(F.col("month").isin(months))

    def metrics(self) -> DataFrame:
        return self.spark.read.schema(METRICS).parquet(f"{self.root}/metrics")

    def _blocked(self) -> Column:
        return F.avg((~F.col("ok")).cast("double")) > self.tolerance

    def publish(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch. A month may come in several: its gauges are those of all its rows so far."""
        rows = batch.select("row_id", self.score.alias("p"), F.coalesce(self.ok, F.lit(False)).alias("ok"), "scenario", "month", F.lit(batch_id).cast("long").alias("arrival"))
        rows.write.partitionBy("scenario", "month", "arrival").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/predictions")
        months = [r.month for r in batch.select("month").distinct().collect()]  # a step of the replay
        if not months:
            return
        step = F.col("month")
        seen = self.recorded(months).groupBy("scenario", "month").agg(F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean_predicted"), self._blocked().alias("blocked"))
        contract, drift, verdict = stage_codes(F.col("blocked"), F.col("rows"), self.min_rows)
        gauges = {
            "rows": F.col("rows"), "stage_contract": contract, "stage_drift": drift, "verdict": verdict, "mean_predicted": F.when(~F.col("blocked"), F.col("mean_predicted")),
            "labels_pending": pending_flag(step, self.last_month, self.lag),
        }
        self._put(seen, "scoring", gauges)
        due = self.recorded([m - self.lag for m in months])
        live = due.groupBy("scenario", "month").agg(self._blocked().alias("blocked")).where("NOT blocked").drop("blocked")
        y = F.col("y").cast("double")
        joined = due.join(F.broadcast(live), ["scenario", "month"], "left_semi").join(self.labels, "row_id")
        labelled = joined.groupBy("scenario", "month").agg(F.count(F.lit(1)).alias("rows"), F.avg(y).alias("observed_rate"), (F.avg("p") - F.avg(y)).alias("calibration_gap"), F.avg(F.pow(F.col("p") - y, F.lit(2))).alias("brier"))
        self._put(labelled, "labels", {c: F.col(c) for c in ("rows", "observed_rate", "calibration_gap", "brier")} | {"label_lag": F.lit(self.lag)})

    def _put(self, groups: DataFrame, job: str, gauges: dict[str, Column]) -> None:
        named = groups.withColumn("job", F.lit(job)).withColumn("batch_id", F.col("month").cast("string"))
        write_metric_groups(to_metrics(named, gauges).drop("labels"), f"{self.root}/metrics")

    def run(self, arrivals: DataFrame) -> None:
        """Takes up whatever has arrived since the last call, in one micro-batch."""
        arrivals.writeStream.foreachBatch(self.publish).option("checkpointLocation", f"{self.root}/state").trigger(availableNow=True).start().awaitTermination()
