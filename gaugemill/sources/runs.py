"""Runs and what they measured, and batches that are made once and then kept."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rules import c, inject_defects, is_clean, utilisation_in_range
from ..operators.sampling import stratified_sample, uniform_sample
from . import store
from .tables import TARGET

RUNS = "name string, params map<string,string>, tags map<string,string>, experiment string, run_id string"
MEASURED = "metric string, value double, experiment string, run_id string"
DEMO_ROWS, SMALL_ROWS = 200, 400


class RunLog:
    """Two tables under ``root``: runs with their parameters and tags, and one row for each number that was measured."""

    def __init__(self, spark: SparkSession, root: str, experiment: str):
        self.spark, self.root, self.experiment = spark, root.rstrip("/"), experiment

    def record(self, rows: DataFrame, name: Column, params: list[str], metrics: list[str], tags: list[str] = ()) -> None:
        """A run for each row of ``rows``. Its id is a hash of experiment, name and parameters, so recording it again
        replaces it. A null metric has no row: what was not measured is not zero."""
        kept = lambda names: F.map_filter(F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.array(*[F.col(x).cast("string") for x in names])) if names else F.create_map().cast("map<string,string>"), lambda _, v: v.isNotNull())
        told = rows.select("*", name.alias("name_"), kept(params).alias("params_"), kept(tags).alias("tags_"))
        told = told.withColumn("run_id", F.substring(F.sha2(F.concat_ws("|", F.lit(self.experiment), "name_", F.to_json("params_")), 256), 1, 16)).withColumn("experiment", F.lit(self.experiment))
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        put = lambda df, table: df.write.partitionBy("experiment", "run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/{table}")
        put(told.select(F.col("name_").alias("name"), F.col("params_").alias("params"), F.col("tags_").alias("tags"), "experiment", "run_id"), "runs")
        put(told.select(F.inline(pairs), "experiment", "run_id").where("value IS NOT NULL"), "measured")

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUNS).parquet(f"{self.root}/runs").where(F.col("experiment") == self.experiment)

    def measured(self) -> DataFrame:
        return self.spark.read.schema(MEASURED).parquet(f"{self.root}/measured").where(F.col("experiment") == self.experiment)

    def best(self, metric: str) -> DataFrame:
        """The run with the largest value of a metric; of equal ones that with the least id."""
        top = self.measured().where(F.col("metric") == metric).orderBy(F.desc("value"), "run_id").limit(1)
        return self.runs().join(top.select("run_id", "value"), "run_id")


def write_summary(spark: SparkSession, outcome: dict, path: str) -> None:
    """A training summary as one JSON document."""
    spark.createDataFrame([(json.dumps(outcome, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_summary(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def wipe_groups(spark: SparkSession, path: str) -> list[str]:
    """Removes every group of a metric table and says which jobs it held; a table that is not there is an error."""
    if not store.exists(spark, path):
        raise FileNotFoundError(path)
    jobs = [n.removeprefix("job=") for n in store.names(spark, path) if n.startswith("job=")]
    store.delete(spark, path)
    return jobs


def ensured(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table at ``path`` and whether this call has made it: one that is there stays as it is."""
    made = not store.exists(spark, path)
    if made:
        store.write_once(make(), path)
    return spark.read.parquet(path), made


def clean_base(df: DataFrame, rows: int = DEMO_ROWS, seed: str = "demo", key: str = "row_id") -> DataFrame:
    """``rows`` rows without any defect, classes in proportion, numbered from 0 in the order of a hash."""
    clean = df.where(is_clean() & utilisation_in_range())
    share = {r[0]: r[1] for r in clean.groupBy(c(TARGET)).count().collect()}  # the classes
    total = sum(share.values())
    if total < rows:
        raise ValueError(f"{total} clean rows, {rows} are asked for")
    names = sorted(share, key=lambda k: -share[k])
    counts = {k: round(rows * share[k] / total) for k in names[1:]}
    counts[names[0]] = rows - sum(counts.values())
    drawn = stratified_sample(clean, TARGET, counts, seed, key)
    order = Window.orderBy(F.md5(F.concat_ws(":", F.lit(seed), c(key).cast("string"))), c(key))  # ``rows`` rows
    return drawn.withColumn(key, (F.row_number().over(order) - 1).cast("long"))


def write_demo_batch(df: DataFrame, folder: str, stamp: str, blockers: bool = True, rows: int = DEMO_ROWS) -> str:
    """A batch with planted defects and its manifest under ``folder``; returns the batch's name, which holds the ``stamp`` (yyyyMMdd)."""
    spark = df.sparkSession
    base = spark.createDataFrame(clean_base(df, rows).collect(), df.schema)  # ``rows`` rows, planted by their number
    batch, injected = inject_defects(base, blockers)
    name = f"{'batch' if blockers else 'clean_batch'}_{stamp}"
    write_summary(spark, {"rows_in_base": rows, "rows_out": batch.count(), "include_blockers": blockers, "injected": injected}, f"{folder}/{name}.manifest")
    store.write_once(batch, f"{folder}/{name}.parquet")
    return name


def ensure_dirty_batch(df: DataFrame, folder: str, stamp: str, rows: int = DEMO_ROWS) -> tuple[str, bool]:
    """The newest dirty batch by name, written first if there is none, and whether it was."""
    there = [n.removesuffix(".parquet") for n in store.names(df.sparkSession, folder) if n.startswith("batch_") and n.endswith(".parquet")]
    return (max(there), False) if there else (write_demo_batch(df, folder, stamp, True, rows), True)


def ensure_small_batch(holdout: DataFrame, path: str, rows: int = SMALL_ROWS, seed: str = "small", key: str = "row_id") -> tuple[DataFrame, bool]:
    """A batch that is too small to judge, drawn once from the held-out rows."""
    return ensured(holdout.sparkSession, path, lambda: uniform_sample(holdout, rows, seed, key))
