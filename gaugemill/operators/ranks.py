"""Counts of distinct values, running totals over them and exact percentiles, with no group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bin of the sorted distinct values of a group has about so many.
VALUES_PER_BIN = 1 << 14
#: A value with more than one in so many of all rows is broadcast to its rows.
HOT = 10_000


def counted(long: DataFrame, *by: str) -> DataFrame:
    """(by..., feature, value, _n) of the values that are there.

    The columns come out of a generator row, so that no reader's filter or unused column changes the aggregate below:
    all readers of one plan share its shuffle, and with it the read of the table."""
    per = long.where("value IS NOT NULL").groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    return per.select(F.inline(F.array(F.struct(*per.columns))))


def upto(cuts: Column, steps: Column, value: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``, by halving; 0 without cuts. ``steps``: falling powers of two, from
    the largest that is no more than the number of cuts."""
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(cuts)) & (F.get(cuts, at + s - 1) <= value), at + s).otherwise(at)), F.lit(0))


def running(per: DataFrame, *by: str, value: str = "value", sums: tuple[str, ...] = ("_n",)) -> DataFrame:
    """Adds ``<s>_before`` (its sum over the smaller values of the group) and ``<s>_all`` for each of ``sums``.

    ``per`` has one row per group and value. The values of a group are cut at those whose hash is divisible by 2^14, the same
    ones on any partitioning: sums of bins first, then sums inside bins."""
    chosen = F.pmod(F.xxhash64(value), F.lit(VALUES_PER_BIN)) == 0
    cuts = per.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(chosen, F.col(value)))).alias("_cuts")).where(F.size("_cuts") > 0)
    cuts = cuts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_cuts", F.filter(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), lambda s: s <= F.size("_cuts")).alias("_steps"))
    on = F.lit(True)
    for i, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    binned = per.join(F.broadcast(cuts), on, "left").withColumn("_bin", upto(F.col("_cuts"), F.col("_steps"), F.col(value))).select(*per.columns, "_bin")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # one row per bin
    line = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(*by, "_bin").agg(*[F.sum(s).alias(s) for s in sums])
    ends = [x for s in sums for x in (F.coalesce(F.sum(s).over(line), F.lit(0)).alias(f"_{s}_b"), F.sum(s).over(group).alias(f"{s}_all"))]
    bins = bins.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_bin").alias("_kb"), *ends)
    inside = Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = binned.join(bins, on & (F.col("_bin") == F.col("_kb")))
    return out.select(*per.columns, *[x for s in sums for x in ((F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"_{s}_b")).alias(f"{s}_before"), F.col(f"{s}_all"))])


def percentiles(per: DataFrame, points, *by: str, value: str = "value") -> DataFrame:
    """(by..., q): exact percentiles of counted values (by..., value, _n), between the two nearest as ``percentile`` has them."""
    return percentiles_of_running(running(per, *by, value=value), points, *by, value=value)


def percentiles_of_running(run: DataFrame, points, *by: str, value: str = "value") -> DataFrame:
    """The same of values with their running totals."""
    aggs, q = [], []
    for i, p in enumerate(points):
        at = (F.col("_n_all") - 1) * F.lit(float(p))
        has = lambda k: F.max(F.when((F.col("_n_before") <= k) & (k < F.col("_n_before") + F.col("_n")), F.col(value)))
        aggs += [has(F.floor(at)).alias(f"_lo{i}"), has(F.ceil(at)).alias(f"_hi{i}"), F.max(at - F.floor(at)).alias(f"_part{i}")]
        lo, hi, part = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_part{i}")
        q.append(F.when(lo == hi, lo).otherwise((1.0 - part) * lo + part * hi))
    return run.groupBy(*by).agg(*aggs).select(*by, F.array(*q).alias("q"))


def looked_up(rows: DataFrame, table: DataFrame, hits: str) -> DataFrame:
    """``rows`` inner joined with ``table`` (feature, value, ...; one row each) by feature and value.

    ``hits`` counts the rows of a value. Values with more than a ten-thousandth of all rows, which are at most 10,000, are
    broadcast; only the rows of others are shuffled, and no value gathers more than that share in one task."""
    hot, cold = looked_up_parts(rows, table, hits)
    return hot.unionByName(cold)


def looked_up_parts(rows: DataFrame, table: DataFrame, hits: str) -> tuple[DataFrame, DataFrame]:
    """The same in two parts: rows of frequent values, and those of all others."""
    all_ = table.agg(F.sum(hits).alias("_hits"))
    marked = table.crossJoin(F.broadcast(all_)).withColumn("_hot", F.col(hits) * HOT > F.col("_hits")).drop("_hits", hits)  # one row
    hot, cold = marked.where("_hot"), marked.where("NOT _hot").drop("_hot")
    seen = rows.join(F.broadcast(hot), ["feature", "value"], "left")
    return seen.where("_hot").drop("_hot"), seen.where("_hot IS NULL").select(*rows.columns).join(cold.hint("shuffle_hash"), ["feature", "value"])


def gathered(df: DataFrame, *by: str) -> DataFrame:
    """``df`` after one exchange by ``by`` that all its readers share: its columns come out of a generator row, so that no reader's
    filter or unused column changes what is before."""
    return df.repartition(*by).select(F.inline(F.array(F.struct(*df.columns))))
