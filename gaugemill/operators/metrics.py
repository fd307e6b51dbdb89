"""Ranking and calibration metrics of scored rows (y 0/1, p), per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import running


def _curve(scored: DataFrame, *by: str) -> DataFrame:
    """One row per distinct score, highest first: positives and negatives at it and above it."""
    per = scored.groupBy(*by, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    per = running(per.select(F.inline(F.array(F.struct(*per.columns)))), *by, value="p", sums=("pos", "neg"))
    above = lambda c: (F.col(f"{c}_all") - F.col(f"{c}_before"))
    return per.select(*by, "p", "pos", "neg", above("pos").alias("tp"), above("neg").alias("fp"), "pos_all", "neg_all")


def ranking(scored: DataFrame, *by: str) -> DataFrame:
    """(by..., auc, ks, ks_threshold): ties count one half in the AUC; ks is the largest TPR - FPR and
    the threshold the highest score that attains it. Null with one class only."""
    c = _curve(scored, *by).withColumn("gap", F.try_divide(F.col("tp"), F.col("pos_all")) - F.try_divide(F.col("fp"), F.col("neg_all")))
    wins = F.sum((F.col("neg").cast("double") * (F.col("tp") - F.col("pos")) + 0.5 * F.col("neg") * F.col("pos")))
    best = F.max(F.struct("gap", "p"))
    return c.groupBy(*by).agg(F.try_divide(wins, F.first("pos_all").cast("double") * F.first("neg_all")).alias("auc"), best["gap"].alias("ks"), F.when(best["gap"].isNotNull(), best["p"]).alias("ks_threshold"))


def batch_metrics(scored: DataFrame, *by: str) -> DataFrame:
    """Rows, rates, signed calibration gap (mean p - mean y), Brier score, and the ranking metrics."""
    y = F.col("y").cast("double")
    base = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(y).alias("observed_rate"), F.avg("p").alias("mean_predicted"), (F.avg("p") - F.avg(y)).alias("calibration_gap"), F.avg(F.pow(F.col("p") - y, F.lit(2))).alias("brier"))
    rank = ranking(scored, *by)
    return base.join(rank, list(by)) if by else base.crossJoin(rank)


def champion(table: DataFrame, by: str = "auc") -> DataFrame:
    """The row with the largest metric."""
    return table.orderBy(F.desc(by), *[c for c in table.columns if c != by]).limit(1)


def seed_summary(runs: DataFrame, model: str = "model", seed: str = "seed", value: str = "auc") -> DataFrame:
    """(model): mean, sample sd and range over seeds."""
    return runs.groupBy(model).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.max(value) - F.min(value)).alias("range"))


def paired_delta(runs: DataFrame, a: str, b: str, model: str = "model", seed: str = "seed", value: str = "auc") -> DataFrame:
    """Mean of a - b over seeds, and in how many seeds a wins."""
    wide = runs.groupBy(seed).pivot(model, [a, b]).agg(F.first(value)).withColumn("d", F.col(f"`{a}`") - F.col(f"`{b}`"))
    return wide.agg(F.avg("d").alias("mean_delta"), F.count_if(F.col("d") > 0).cast("long").alias("wins"), F.count("d").alias("seeds"))
