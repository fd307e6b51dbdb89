"""Cleaning, imputation fitted on the reference, and the model matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import holds
from ..sources.tables import AGE, COLUMNS, COUNTERS, DEBT_RATIO, DEPENDENTS, INCOME, INCOME_MISSING, MODEL_FEATURES, TARGET, UTILIZATION
from .profile import to_long
from .ranks import counted, percentiles
from .rules import AGE_MAX, AGE_MIN, DEBT_RATIO_MAX, MODEL, SENTINELS, assert_passes, c, duplicate_rows

UTILIZATION_CAP = 10.0


def sentinel_mask() -> Column:
    return reduce(lambda a, b: a | b, [holds(c(x).isin(*SENTINELS)) for x in COUNTERS])


def income_missing() -> Column:
    """1 where the income is null or zero, judged before anything is filled."""
    return F.when(c(INCOME).isNull() | (c(INCOME) == 0), 1).otherwise(0).cast("tinyint")


def cap(column: Column, limit: float) -> Column:
    """Upper bound that leaves null null (``least`` would return the bound)."""
    return F.when(column > limit, F.lit(limit)).otherwise(column)


def _steps(df: DataFrame, debt_cap: float, utilization_cap: float) -> tuple[DataFrame, Column]:
    """The frame with all cleaned columns beside flags for what each step touches; and what stays."""
    out = df.withColumn("_sentinel", sentinel_mask()).withColumn("_age", ~holds(c(AGE).between(AGE_MIN, AGE_MAX))).withColumn(INCOME_MISSING, income_missing())
    out = out.withColumn("_debt_capped", holds((c(INCOME_MISSING) == 0) & (c(DEBT_RATIO) > debt_cap))).withColumn("_utilization_capped", holds(c(UTILIZATION) > utilization_cap)).withColumn("_dependents_filled", c(DEPENDENTS).isNull())
    known = c(INCOME_MISSING) == 0
    out = out.withColumn(INCOME, F.when(known, c(INCOME))).withColumn(DEBT_RATIO, cap(F.when(known, c(DEBT_RATIO)), debt_cap))
    out = out.withColumn(UTILIZATION, cap(c(UTILIZATION), utilization_cap)).withColumn(DEPENDENTS, F.coalesce(c(DEPENDENTS), F.lit(0.0)))
    return out, ~F.col("_sentinel") & ~F.col("_age")


def clean(df: DataFrame, key: str = "row_id", debt_cap: float = DEBT_RATIO_MAX, utilization_cap: float = UTILIZATION_CAP) -> DataFrame:
    """Sentinels out, impossible ages out, income flag, null income and debt ratio where it is set, caps,
    dependents filled with 0, duplicates out (first by ``key`` stays). One shuffle, for the last step."""
    out, stays = _steps(df, debt_cap, utilization_cap)
    out = out.where(stays).select(c(key), *[c(x) for x in COLUMNS], INCOME_MISSING)
    return out.withColumn("_repeat", duplicate_rows((*COLUMNS, INCOME_MISSING), key)).where(~F.col("_repeat")).drop("_repeat")


def clean_report(df: DataFrame, key: str = "row_id", debt_cap: float = DEBT_RATIO_MAX, utilization_cap: float = UTILIZATION_CAP) -> DataFrame:
    """One row with what each step of ``clean`` found, counted where that step stands."""
    source = df.withColumn("_source_dup", duplicate_rows(COLUMNS, key))
    out, stays = _steps(source, debt_cap, utilization_cap)
    out = out.withColumn("_stays", stays).withColumn("_repeat", duplicate_rows((*COLUMNS, INCOME_MISSING, "_stays"), key) & F.col("_stays"))
    n = lambda x: F.count_if(x).cast("long")
    left = F.col("_stays")
    return out.agg(
        F.count(F.lit(1)).alias("rows_in"), n(F.col("_source_dup")).alias("source_duplicates"), n(F.col("_sentinel")).alias("sentinels_dropped"), n(~F.col("_sentinel") & F.col("_age")).alias("ages_dropped"),
        n(left & (c(INCOME_MISSING) == 1)).alias("income_missing"), n(left & F.col("_debt_capped")).alias("debt_ratio_capped"), n(left & F.col("_utilization_capped")).alias("utilization_capped"),
        n(left & F.col("_dependents_filled")).alias("dependents_filled"), n(F.col("_repeat")).alias("duplicates_dropped"), n(left & ~F.col("_repeat")).alias("rows_out"),
        F.avg(F.when(left & ~F.col("_repeat"), (c(TARGET) == "1").cast("double"))).alias("positive_rate"),
    )


def fit_imputation(reference: DataFrame) -> DataFrame:
    """One row: medians of income and debt ratio among reference rows whose income is known."""
    known = c(INCOME_MISSING) == 0
    names = {INCOME: "income_median", DEBT_RATIO: "debt_ratio_median"}
    q = percentiles(counted(to_long(reference.where(known), names)), (0.5,), "feature")
    return q.agg(*[F.max(F.when(F.col("feature") == k, F.col("q")[0])).alias(v) for k, v in names.items()])


def impute(df: DataFrame, fit: DataFrame, key: str = "row_id") -> DataFrame:
    """Fills with the fitted medians and drops the duplicates that filling makes."""
    names = df.columns
    filled = df.crossJoin(F.broadcast(fit)).withColumn(INCOME, F.coalesce(c(INCOME), F.col("income_median"))).withColumn(DEBT_RATIO, F.coalesce(c(DEBT_RATIO), F.col("debt_ratio_median")))  # fit is one row
    return filled.withColumn("_repeat", duplicate_rows((*COLUMNS, INCOME_MISSING), key)).where(~F.col("_repeat")).select(*[c(x) for x in names])


def feature_matrix(df: DataFrame, key: str = "row_id") -> DataFrame:
    """``key``, the eleven features as doubles, and ``y`` (1 for target "1")."""
    return df.select(c(key), *[c(x).cast("double").alias(x) for x in MODEL_FEATURES], F.when(c(TARGET) == "1", 1).otherwise(0).cast("tinyint").alias("y"))


def prepare_split(df: DataFrame, fit: DataFrame, key: str = "row_id") -> DataFrame:
    """Imputes, holds the result against the model contract (blockers raise) and gives the matrix."""
    ready = impute(df, fit, key)
    assert_passes(ready, MODEL, key)
    return feature_matrix(ready, key)


def make_scoreable(df: DataFrame) -> DataFrame:
    """Adds the income flag and fills null incomes with the median of the positive ones; defects stay."""
    fit = df.agg(F.percentile(F.when(c(INCOME) > 0, c(INCOME)), 0.5).alias("_m"))
    return df.withColumn(INCOME_MISSING, income_missing()).crossJoin(F.broadcast(fit)).withColumn(INCOME, F.coalesce(c(INCOME), F.col("_m"))).drop("_m")
