"""Population stability index on bins cut from the reference, for many features at once.

Tables are long: (keys..., feature, value). Values are counted once per distinct value before anything
else, so percentiles and shares work on counts; edges are one small row per feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import counted, percentiles, percentiles_of_running

FLOOR = 1e-6
FEW_VALUES = 30
WARN, ALERT = 0.10, 0.25
MIN_ROWS = 1000


def _counted(long: DataFrame, *by: str) -> DataFrame:
    return counted(long, *by).where(~F.isnan("value"))


def fit_edges(reference: DataFrame, bins: int = 10, approximate: bool = False) -> DataFrame:
    """(feature, interior array): the cut points inside (-inf, inf).

    The distinct deciles; if there are fewer than ``bins`` + 1 of them and at most 30 distinct values,
    the midpoints between values instead. With two edges or fewer, all of them are interior.
    ``approximate`` takes percentiles from a sketch; the verdict thresholds are calibrated on exact ones.
    """
    if approximate:
        sketch = reference.where("value IS NOT NULL").groupBy("feature").agg(F.percentile_approx("value", _points(bins), 100_000).alias("q"))
        return _interior(sketch, _counted(reference), bins)
    return edges_of_counted(counted(reference), bins)


def edges_of_counted(reference: DataFrame, bins: int = 10) -> DataFrame:
    """The exact edges of counted values (feature, value, _n)."""
    per = reference.where(~F.isnan("value"))
    return _interior(percentiles(per, _points(bins), "feature"), per, bins)


def edges_of_running(run: DataFrame, bins: int = 10) -> DataFrame:
    """The same of counted values with their running totals, none of them NaN."""
    return _interior(percentiles_of_running(run, _points(bins), "feature"), run, bins)


def _points(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def _interior(edges: DataFrame, per: DataFrame, bins: int) -> DataFrame:
    distinct = per.groupBy("feature").agg(F.count(F.lit(1)).alias("ndv"))
    # Only features with few distinct values are gathered, so the list is bounded.
    small = per.join(F.broadcast(distinct.where(F.col("ndv") <= FEW_VALUES)), "feature").groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("values"))
    out = edges.join(distinct, "feature").join(small, "feature", "left").withColumn("q", F.array_sort(F.array_distinct("q")))
    middle = F.transform(F.slice("values", 1, F.greatest(F.size("values") - 1, F.lit(0))), lambda x, i: (x + F.element_at("values", i + 2)) / 2.0)
    inner = F.when(F.size("q") > 2, F.slice("q", 2, F.size("q") - 2)).otherwise(F.col("q"))
    return out.select("feature", F.when((F.size("q") < bins + 1) & (F.col("ndv") <= FEW_VALUES), middle).otherwise(inner).alias("interior"))


def effective_bins(edges: DataFrame) -> DataFrame:
    return edges.select("feature", (F.size("interior") + 1).alias("bins"))


def bin_of(value: Column, interior: Column) -> Column:
    """Number of edges at or below the value: bins are half-open [edge, next edge)."""
    return F.size(F.filter(interior, lambda e: e <= value))


def binned(long: DataFrame, edges: DataFrame, *by: str, most: int | None = None) -> DataFrame:
    """(by..., feature, bin, _n) of the values that are there. ``by`` makes more distinct values of the same rows, so where there are
    at most so many edges, its rows are binned as they come, and only counts of bins are shuffled."""
    if not by or most is None:
        return bins_of_counted(counted(long, *by), edges, *by)
    bin_ = sum((F.coalesce((F.get("interior", F.lit(i)) <= F.col("value")).cast("int"), F.lit(0)) for i in range(most)), F.lit(0))
    rows = long.where(F.col("value").isNotNull() & ~F.isnan("value")).join(F.broadcast(edges), "feature")
    return rows.groupBy(*by, "feature", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))


def bins_of_counted(per: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """The same of counted values (by..., feature, value, _n)."""
    return per.where(~F.isnan("value")).join(F.broadcast(edges), "feature").groupBy(*by, "feature", bin_of(F.col("value"), F.col("interior")).alias("bin")).agg(F.sum("_n").alias("_n"))


def shares_of_binned(counts: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """(by..., feature, bin, share) for every bin, at least 1e-6 each and not renormalised."""
    total = counts.groupBy(*by, "feature").agg(F.sum("_n").alias("total"))
    all_bins = total.join(F.broadcast(edges), "feature").select(*by, "feature", "total", F.explode(F.sequence(F.lit(0), F.size("interior"))).alias("bin"))
    out = all_bins.join(counts, [*by, "feature", "bin"], "left")
    return out.select(*by, "feature", "bin", F.greatest(F.coalesce("_n", F.lit(0)) / F.greatest("total", F.lit(1)), F.lit(FLOOR)).alias("share"))


def shares(long: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """The same of values."""
    return shares_of_binned(binned(long, edges, *by), edges, *by)


def psi_of_binned(reference: DataFrame, current: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """(by..., feature, psi): sum of (p - r) ln(p / r) over the bins of ``edges``."""
    r = shares_of_binned(reference, edges).select("feature", "bin", F.col("share").alias("r"))
    p = shares_of_binned(current, edges, *by).withColumnRenamed("share", "p")
    return p.join(F.broadcast(r), ["feature", "bin"]).groupBy(*by, "feature").agg(F.sum((F.col("p") - F.col("r")) * F.log(F.col("p") / F.col("r"))).alias("psi"))


def psi(reference: DataFrame, current: DataFrame, *by: str, bins: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """The index on bins fitted on ``reference``. ``by`` splits the current side; the reference is one."""
    most = max(bins, FEW_VALUES) if edges is None else None
    edges = fit_edges(reference, bins) if edges is None else edges
    return psi_of_binned(binned(reference, edges), binned(current, edges, *by, most=most), edges, *by)


def native_psi(reference: DataFrame, current: DataFrame) -> DataFrame:
    """The index a reporting library computes by itself, as a cross-check: one bin per value up to 20
    distinct values, else Sturges bins of equal width over the union of both sides."""
    none = F.lit(None).cast("long")
    both = _counted(reference).select("feature", "value", F.col("_n").alias("r"), none.alias("c")).unionByName(_counted(current).select("feature", "value", none.alias("r"), F.col("_n").alias("c")))
    both = both.groupBy("feature", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum(F.coalesce("r", "c")).alias("_n"))
    both = both.select(F.inline(F.array(F.struct(*both.columns))))
    stats = both.groupBy("feature").agg(F.count(F.lit(1)).alias("ndv"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("_n").alias("all"))
    k = F.ceil(F.log2("all") + 1)
    slot = F.when(F.col("ndv") <= 20, F.col("value")).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / k)), k - 1).cast("double"))
    per = both.join(F.broadcast(stats), "feature").groupBy("feature", slot.alias("slot")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    total = per.groupBy("feature").agg(F.sum("r").alias("rt"), F.sum("c").alias("ct"))
    share = lambda n, t: F.greatest(F.coalesce(n, F.lit(0)) / F.col(t), F.lit(1e-4))
    per = per.join(F.broadcast(total), "feature").withColumn("p", share(F.col("c"), "ct")).withColumn("q", share(F.col("r"), "rt"))
    return per.groupBy("feature").agg(F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))).alias("psi_native"))


def psi_verdict(value: Column, rows: Column | None = None) -> Column:
    """stable / moderate / significant; insufficient under 1000 rows, judged only if rows are given."""
    word = F.when(value < WARN, "stable").when(value < ALERT, "moderate").otherwise("significant")
    return word if rows is None else F.when(rows < MIN_ROWS, "insufficient").otherwise(word)


def traffic_light(value: Column) -> Column:
    return F.when(value < WARN, "green").when(value < ALERT, "amber").otherwise("red")


def batch_verdict(max_psi: Column, rows: Column, min_rows: int = MIN_ROWS) -> Column:
    """-1 too few rows, 0 fine or nothing measured, 1 from 0.10, 2 from 0.25 on."""
    return F.when(rows < min_rows, -1).when(max_psi.isNull(), 0).when(max_psi >= ALERT, 2).when(max_psi >= WARN, 1).otherwise(0)


def impact(psis: DataFrame, gains: DataFrame) -> DataFrame:
    """Adds gain_share (0 for features without one) and impact = psi x gain_share."""
    return psis.join(F.broadcast(gains), "feature", "left").withColumn("gain_share", F.coalesce("gain_share", F.lit(0.0))).withColumn("impact", F.col("psi") * F.col("gain_share"))


def impact_ranking(psis: DataFrame, gains: DataFrame, top: int = 6) -> DataFrame:
    return impact(psis, gains).orderBy(F.desc("impact"), "feature").limit(top)


def matrix(psis: DataFrame, row: str, features: list[str]) -> DataFrame:
    """One row per month, one column per feature."""
    return psis.groupBy(row).pivot("feature", features).agg(F.first("psi"))
