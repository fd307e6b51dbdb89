"""Table profiles: describe, nulls, value rates, correlations, duplicates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import counted, percentiles, running

PERCENTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def to_long(df: DataFrame, columns, *keys: str) -> DataFrame:
    """(keys..., feature, value double) of the given columns; one pass, no join."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    return df.select(*[F.col(f"`{k}`") for k in keys], F.inline(pairs))


def describe(long: DataFrame, *by: str) -> DataFrame:
    """count, mean, sd, min, seven exact percentiles and max of each feature (and group)."""
    q = percentiles(counted(long, *by), PERCENTS, *by, "feature")
    q = q.select(*[F.col(k).alias(f"_{k}") for k in (*by, "feature")], "q")
    on = F.lit(True)
    for k in (*by, "feature"):
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    moments = _moments(long, *by)
    return _described(moments.join(F.broadcast(q), on, "left"), *by)  # one row for each group


def describe_approx(long: DataFrame, *by: str, accuracy: int = 100_000) -> DataFrame:
    return _described(_moments(long, *by, extra=(F.percentile_approx("value", list(PERCENTS), accuracy).alias("q"),)), *by)


def _moments(long: DataFrame, *by: str, extra=()) -> DataFrame:
    return long.groupBy(*by, "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), *extra)


def _described(out: DataFrame, *by: str) -> DataFrame:
    return out.select(*by, "feature", "n", "mean", "sd", "min", *[F.col("q")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(PERCENTS)], "max")


def null_profile(df: DataFrame, columns) -> DataFrame:
    """Nulls and their share per column, and of rows with any null (column '<any>'); one aggregate."""
    count = lambda c: F.count_if(c).cast("long")
    null = {c: F.col(f"`{c}`").isNull() for c in columns}
    any_null = null[columns[0]]
    for c in columns[1:]:
        any_null = any_null | null[c]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[count(x).alias(f"n{i}") for i, x in enumerate([*null.values(), any_null])])
    names = [*columns, "<any>"]
    parts = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"n{i}").alias("nulls"), F.try_divide(F.col(f"n{i}").cast("double"), F.col("rows")).alias("share")) for i, n in enumerate(names)])
    return row.select(F.inline(parts))


def value_rates(df: DataFrame, column: str, target: Column) -> DataFrame:
    """Count, share of all rows and mean of ``target`` for each value."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    per = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.avg(target.cast("double")).alias("rate"))
    return per.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_total")).alias("share"), "rate")  # one row


def conditional_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    row = df.agg(*[F.count_if(c).cast("long").alias(f"c{i}") for i, c in enumerate(conditions.values())])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("condition"), F.col(f"c{i}").alias("n")) for i, n in enumerate(conditions)])))


def duplicate_counts(df: DataFrame, columns) -> DataFrame:
    """Rows that repeat an earlier row in all ``columns`` (null equals null), and groups with repeats."""
    per = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"), F.count_if(F.col("n") > 1).cast("long").alias("groups"))


def pearson(df: DataFrame, columns, where: Column | None = None) -> DataFrame:
    """(x, y, r) for each pair of columns, over rows in which both are known (and ``where`` holds)."""
    pairs = list(combinations(columns, 2))
    v = lambda c: F.col(f"`{c}`").cast("double") if where is None else F.when(where, F.col(f"`{c}`").cast("double"))
    row = df.agg(*[F.corr(v(a), v(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def average_ranks(long: DataFrame) -> DataFrame:
    """(feature, value, rank): ranks with ties averaged, from one count per distinct value."""
    return running(counted(long), "feature").select("feature", "value", (F.col("_n_before") + (F.col("_n") + 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, columns) -> DataFrame:
    """(x, y, rho) over rows in which all of ``columns`` are known.

    Each column's ranks are one row per distinct value, joined onto the rows by that value; rows are
    never regrouped, so they need no key and may repeat. A column called ``_rank0``, ``_rank1``, ... of
    the caller's is not read."""
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_value{i}") for i, c in enumerate(columns)]).na.drop()
    for i in range(len(columns)):
        per = rows.select(F.lit(i).alias("feature"), F.col(f"_value{i}").alias("value"))
        ranks = average_ranks(per).select(F.col("value").alias(f"_value{i}"), F.col("rank").alias(f"_rank{i}"))
        rows = rows.join(ranks, f"_value{i}")
    return pearson(rows.select(*[F.col(f"_rank{i}").alias(c) for i, c in enumerate(columns)]), columns).withColumnRenamed("r", "rho")


def top_pairs(spearman_pairs: DataFrame, k: int = 8) -> DataFrame:
    return spearman_pairs.orderBy(F.desc(F.abs("rho")), "x", "y").limit(k)


def schema_profile(df: DataFrame) -> DataFrame:
    """(position, column, type, nullable)."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, nullable boolean")
