"""Per-band confusion rates with intervals, and spreads between bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import ratio, wilson

#: Closed intervals of age.
BANDS = (("18-25", 18, 25), ("26-35", 26, 35), ("36-45", 36, 45), ("46-55", 46, 55), ("56-65", 56, 65), ("66+", 66, 200))
MIN_POSITIVES = 100


def band_of(age: Column) -> Column:
    """The band's label; null outside all of them."""
    out = F.lit(None).cast("string")
    for label, low, high in reversed(BANDS):
        out = F.when(age.between(low, high), label).otherwise(out)
    return out


def band_order(band: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b[0]) for b in BANDS]), band).cast("int")


def band_table(scored: DataFrame, threshold: float, *by: str) -> DataFrame:
    """One row per band that has rows: rates with Wilson intervals. ``p`` is the risk of default, a row
    is flagged at p >= threshold and approved below. A rate without denominator is null."""
    y, flag = F.col("y") == 1, F.col("p") >= threshold
    n = lambda c: F.count_if(c).cast("long")
    c = scored.where(F.col("band").isNotNull()).groupBy(*by, "band").agg(
        F.count(F.lit(1)).alias("n"), n(y).alias("pos"), n(~flag).alias("approved"), n(y & flag).alias("tp"), n(~y & flag).alias("fp"), F.avg("p").alias("mean_predicted")
    )
    col = F.col
    neg, flagged = col("n") - col("pos"), col("tp") + col("fp")
    rates = {"approval": ("approved", col("n")), "tpr": ("tp", col("pos")), "fpr": ("fp", neg), "precision": ("tp", flagged)}
    out = c.withColumn("base_rate", ratio(col("pos"), col("n"))).withColumn("calibration_gap", col("mean_predicted") - col("base_rate"))
    for name, (k, d) in rates.items():
        low, high = wilson(col(k), d)
        out = out.withColumn(f"{name}_rate", ratio(col(k), d)).withColumn(f"{name}_low", low).withColumn(f"{name}_high", high)
    low, high = wilson(col("pos"), col("n"))
    out = out.withColumn("gap_low", col("mean_predicted") - high).withColumn("gap_high", col("mean_predicted") - low)
    return out.withColumn("tpr_n", col("pos")).withColumn("fpr_n", neg).withColumn("precision_n", flagged).withColumn("comparable", col("pos") >= MIN_POSITIVES)


def spreads(bands: DataFrame, *by: str, restrict_to: list[str] | None = None) -> DataFrame:
    """Largest minus smallest approval rate, TPR, FPR, calibration gap and base rate among comparable
    bands; null fields if there is none (``fairness_criteria`` raises then)."""
    rows = bands.where("comparable")
    if restrict_to is not None:
        rows = rows.where(F.col("band").isin(*restrict_to))
    s = lambda c: (F.max(c) - F.min(c))
    return rows.groupBy(*by).agg(
        s("approval_rate").alias("demographic_parity"), F.greatest(s("tpr_rate"), s("fpr_rate")).alias("equalized_odds"), s("calibration_gap").alias("calibration_spread"), s("base_rate").alias("base_rate_spread"), F.count(F.lit(1)).alias("bands")
    )


def fairness_criteria(bands: DataFrame, restrict_to: list[str] | None = None) -> DataFrame:
    out = spreads(bands, restrict_to=restrict_to)
    if not out.where("bands > 0").limit(1).count():
        raise ValueError("no band has enough positives to compare")
    return out


def common_bands(tables: DataFrame, by: str) -> DataFrame:
    """Bands comparable in every population of ``by``, in band order."""
    total = tables.select(F.countDistinct(by).alias("_all"))
    per = tables.where("comparable").groupBy("band").agg(F.countDistinct(by).alias("_n"))
    out = per.crossJoin(F.broadcast(total)).where("_n = _all").select("band", band_order(F.col("band")).alias("band_ord"))
    return out.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("band_ord"))).drop("band_ord")
