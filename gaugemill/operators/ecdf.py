"""Empirical distribution functions: mid-ranks, normal scores, two-sample KS, false-alarm rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import kolmogorov_pvalue, norm_ppf
from .ranks import counted, looked_up, running

CLIP = 1e-6


def fit_ecdf(reference: DataFrame) -> DataFrame:
    """(feature, value, below, upto, total): one row per distinct value."""
    per = running(counted(reference), "feature")
    return per.select("feature", "value", F.col("_n_before").alias("below"), (F.col("_n_before") + F.col("_n")).alias("upto"), F.col("_n_all").alias("total"))


def located_counts(reference: DataFrame, asked: DataFrame) -> DataFrame:
    """(feature, value, below, upto, total, hits) of ``asked`` (feature, value, _n): how many rows of the counted ``reference``
    are less, how many at most, and all of them; ``hits`` sums the asked counts. Values of both sides are put in one order
    with the reference's counts, so no range join is needed. Features without a reference give no row."""
    none = F.lit(0).cast("long")
    both = reference.select("feature", "value", "_n", none.alias("hits")).unionByName(asked.select("feature", "value", none.alias("_n"), F.col("_n").alias("hits")))
    per = both.groupBy("feature", "value").agg(F.sum("_n").alias("_n"), F.sum("hits").alias("hits"))
    per = running(per.select(F.inline(F.array(F.struct(*per.columns)))), "feature").where("hits > 0 AND _n_all > 0")
    return per.select("feature", "value", F.col("_n_before").alias("below"), (F.col("_n_before") + F.col("_n")).alias("upto"), F.col("_n_all").alias("total"), "hits")


def located(values: DataFrame, ecdf: DataFrame) -> DataFrame:
    """(feature, value, below, upto, total) of distinct ``values`` (feature, value) in a fitted distribution."""
    reference = ecdf.select("feature", "value", (F.col("upto") - F.col("below")).alias("_n"))
    return located_counts(reference, values.select("feature", "value", F.lit(1).cast("long").alias("_n"))).drop("hits")


def midrank(current: DataFrame, ecdf: DataFrame, *keys: str) -> DataFrame:
    """(keys..., feature, value, u): (#less + #at most) / 2N against the reference, clipped to
    [1e-6, 1 - 1e-6]."""
    reference = ecdf.select("feature", "value", (F.col("upto") - F.col("below")).alias("_n"))
    return _midrank(current, reference, *keys)


def midrank_against(current: DataFrame, reference: DataFrame, *keys: str) -> DataFrame:
    """The same with the reference's rows instead of its fitted distribution."""
    return _midrank(current, counted(reference), *keys)


def midranks_of_values(current: DataFrame, reference: DataFrame) -> DataFrame:
    """(feature, value, u, rows): one row for each distinct current value."""
    return _ranked_values(counted(current), counted(reference)).withColumnRenamed("hits", "rows")


def midrank_of_own(rows: DataFrame, ecdf: DataFrame, *keys: str) -> DataFrame:
    """``midrank`` of the rows that ``ecdf`` was fitted on: it has each of their values, so none is looked for between two."""
    return looked_up(rows.select(*keys, "feature", "value"), ecdf.select("feature", "value", _mid().alias("u"), (F.col("upto") - F.col("below")).alias("hits")), "hits").select(*keys, "feature", "value", "u")


def _mid() -> Column:
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), (F.col("below") + F.col("upto")) / (2.0 * F.col("total"))))


def _ranked_values(current: DataFrame, reference: DataFrame) -> DataFrame:
    return located_counts(reference, current).select("feature", "value", _mid().alias("u"), "hits")


def _midrank(current: DataFrame, reference: DataFrame, *keys: str) -> DataFrame:
    rows = current.select(*keys, "feature", "value")
    return looked_up(rows, _ranked_values(counted(current), reference), "hits").select(*keys, "feature", "value", "u")


def normal_score(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("z", norm_ppf(F.col("u")))


def ks_of_located(counted: DataFrame, *by: str, feature: str = "feature", also: tuple[Column, ...] = ()) -> DataFrame:
    """(by..., feature, n_ref, n_cur, ks) of (by..., feature, below, upto, total, c): ``c`` rows at a place of the reference.

    The two distributions differ most at a place that has rows, or just before one: the reference cannot add to the
    difference between them. So a group costs its own rows, whatever the size of the reference.
    ``also``: further aggregates of a group."""
    group = Window.partitionBy(*by, feature)
    line = group.orderBy("upto", "below").rowsBetween(Window.unboundedPreceding, 0)
    done, all_ = F.sum("c").over(line), F.sum("c").over(group)
    gap = F.greatest(F.abs(done / all_ - F.col("upto") / F.col("total")), F.abs((done - F.col("c")) / all_ - F.col("below") / F.col("total")))
    return counted.withColumn("gap", gap).groupBy(*by, feature).agg(F.max("total").alias("n_ref"), F.sum("c").alias("n_cur"), F.max("gap").alias("ks"), *also)


def ks_two_sample(reference: DataFrame, current: DataFrame, *by: str) -> DataFrame:
    """(by..., feature, n_ref, n_cur, ks, pvalue). ``by`` splits the current side; each distinct value of all its
    parts is looked up in the reference's distribution once."""
    cur = counted(current, *by).withColumnRenamed("_n", "c")
    places = located_counts(counted(reference), cur.withColumnRenamed("c", "_n")).drop("hits")
    out = ks_of_located(cur.join(places, ["feature", "value"]), *by)
    return out.withColumn("pvalue", kolmogorov_pvalue(F.col("ks"), F.col("n_ref"), F.col("n_cur")))


def per_feature_rates(tidy: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(n, feature): shares of draws with p < alpha, psi > 0.10, psi > 0.25, and the mean psi."""
    rate = lambda x: F.avg(x.cast("double"))
    return tidy.groupBy("n", "feature").agg(rate(F.col("ks_pvalue") < alpha).alias("ks_rate"), rate(F.col("psi") > 0.10).alias("psi_warn_rate"), rate(F.col("psi") > 0.25).alias("psi_alert_rate"), F.avg("psi").alias("psi_mean"))


def benjamini_hochberg(tidy: DataFrame, *by: str, p: str = "ks_pvalue", alpha: float = 0.05) -> DataFrame:
    """(by..., bh_any): whether any sorted p(i) is at most alpha i / m."""
    group = Window.partitionBy(*by)
    ranked = tidy.withColumn("_i", F.row_number().over(group.orderBy(p))).withColumn("_m", F.count(F.lit(1)).over(group))
    return ranked.groupBy(*by).agg(F.bool_or(F.col(p) <= alpha * F.col("_i") / F.col("_m")).alias("bh_any"))


def family_wise_rates(tidy: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(n): shares of draws in which any feature alarms, raw, by Bonferroni, by Benjamini-Hochberg, by psi."""
    per = tidy.groupBy("n", "repeat").agg(F.min("ks_pvalue").alias("p"), F.max("psi").alias("psi"), F.count(F.lit(1)).alias("m")).join(benjamini_hochberg(tidy, "n", "repeat", alpha=alpha), ["n", "repeat"])
    rate = lambda x: F.avg(x.cast("double"))
    return per.groupBy("n").agg(
        rate(F.col("p") < alpha).alias("ks_raw"), rate(F.col("p") < alpha / F.col("m")).alias("ks_bonferroni"), rate(F.col("bh_any")).alias("ks_bh"), rate(F.col("psi") > 0.10).alias("psi_warn"), rate(F.col("psi") > 0.25).alias("psi_alert")
    )
