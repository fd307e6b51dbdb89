"""Report tables over results: small frames, one row for each line of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import psi_null_bias
from ..sources.tables import CONTINUOUS
from .rules import BLOCKER


def transposed(described: DataFrame, features: list[str], *by: str) -> DataFrame:
    """One row for each statistic, one column for each feature."""
    stats = [c for c in described.columns if c not in (*by, "feature")]
    long = described.select(*by, "feature", *[F.col(s).cast("double").alias(s) for s in stats]).unpivot([*by, "feature"], stats, "statistic", "value")
    return long.groupBy(*by, "statistic").pivot("feature", features).agg(F.first("value"))


def cross_check(own: DataFrame, native: DataFrame, verdict) -> DataFrame:
    """``feature, psi, psi_native, ratio, same_verdict`` of two indexes of the same data."""
    both = own.join(native, "feature")
    return both.select("feature", "psi", "psi_native", F.try_divide("psi_native", "psi").alias("ratio"), (verdict(F.col("psi")) == verdict(F.col("psi_native"))).alias("same_verdict"))


def ks_by_type(rates: DataFrame, sizes: list[int], continuous=CONTINUOUS) -> DataFrame:
    """Mean KS alarm rate of continuous columns and of counts, one column for each sample size."""
    kind = F.when(F.col("feature").isin(*continuous), "continuous").otherwise("count")
    wide = rates.withColumn("kind", kind).groupBy("kind").pivot("n", sizes).agg(F.avg("ks_rate"))
    return wide.toDF("kind", *(f"n_{n}" for n in sizes))


def bias_table(rates: DataFrame, bins: DataFrame, reference_rows: DataFrame) -> DataFrame:
    """``n, measured, predicted, ratio``: the mean index of draws without drift beside (bins - 1)(1/n + 1/m), both averaged over features.
    ``rates``: n, feature, psi_mean; ``bins``: feature, bins; ``reference_rows``: feature, m."""
    each = rates.join(F.broadcast(bins), "feature").join(F.broadcast(reference_rows), "feature").withColumn("bias", psi_null_bias(F.col("n"), F.col("m"), F.col("bins")))
    out = each.groupBy("n").agg(F.avg("psi_mean").alias("measured"), F.avg("bias").alias("predicted"))
    return out.withColumn("ratio", F.try_divide("measured", "predicted"))


def offenders(rates: DataFrame, top: int = 3) -> DataFrame:
    """The features that alarm most at the smallest size."""
    least = rates.agg(F.min("n").alias("n"))
    return rates.join(F.broadcast(least), "n", "left_semi").orderBy(F.desc("psi_warn_rate"), "feature").limit(top)


def first_rejections(fails: DataFrame, n: int = 12) -> DataFrame:
    """The head of a rejection list: blockers first, then by rule and row."""
    return fails.orderBy(F.col("severity") != BLOCKER, "rule", F.col("row_index").asc_nulls_first()).limit(n)
