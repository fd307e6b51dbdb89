"""Profiles of the proxy tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.clean import sentinel_mask
from ..operators.rules import c
from ..sources.tables import AGE, COLUMNS, COUNTERS, DEBT_RATIO, INCOME, LATE90, LINE_SQL, TARGET, UTILIZATION, credit, line_features, read_table
from .helpers import WITH_CREDIT, rounded, rsql

_Q = "quantile_cont(value, {}::DOUBLE) AS p{:02d}"
_QS = ", ".join(_Q.format(p, round(100 * p)) for p in P.PERCENTS)
_STATS = f"count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, {_QS}, max(value) AS max"
_STAT_NAMES = "mean, sd, min, p01, p05, p25, p50, p75, p95, p99, max"
_PAIR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def profile_describe(spark, d):
    return rounded(P.describe(line_features(spark, d)))


def profile_describe_by_income(spark, d):
    df = credit(spark, d, INCOME, DEBT_RATIO).select(c(INCOME).isNotNull().alias("has_income"), c(DEBT_RATIO).alias("value"), F.lit(DEBT_RATIO).alias("feature"))
    return rounded(P.describe(df, "has_income").drop("feature"))


def profile_nulls(spark, d):
    return rounded(P.null_profile(credit(spark, d), COLUMNS))


def profile_value_rates(spark, d):
    return rounded(P.value_rates(credit(spark, d, LATE90, TARGET), LATE90, c(TARGET) == "1"))


def profile_conditions(spark, d):
    conditions = {"age < 18": c(AGE) < 18, "age = 0": c(AGE) == 0, "age > 100": c(AGE) > 100, "utilization > 1": c(UTILIZATION) > 1, "utilization > 10": c(UTILIZATION) > 10, "sentinel": sentinel_mask()}
    return P.conditional_counts(credit(spark, d, AGE, UTILIZATION, *COUNTERS), conditions)


def profile_duplicates(spark, d):
    return P.duplicate_counts(read_table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])


def profile_pearson(spark, d):
    return rounded(P.pearson(read_table(spark, d, "lineitem"), _PAIR))


def profile_sentinel_correlation(spark, d):
    """Mean correlation of the three counters with and without sentinel rows, and whether it collapses."""
    df = credit(spark, d)
    mean = lambda w: P.pearson(df, COUNTERS, w).agg(F.avg("r").alias("r"))
    both = mean(None).select(F.col("r").alias("with_sentinels")).crossJoin(mean(~sentinel_mask()).select(F.col("r").alias("without_sentinels")))  # one row each
    drop = (F.col("with_sentinels") - F.col("without_sentinels")) / F.col("with_sentinels")
    return rounded(both.withColumn("collapses", drop >= 0.5))


def profile_spearman(spark, d):
    return rounded(P.spearman(read_table(spark, d, "lineitem"), _PAIR))


def profile_top_pairs(spark, d):
    return P.top_pairs(profile_spearman(spark, d), 3)


def profile_schema(spark, d):
    return P.schema_profile(credit(spark, d))


def _null_sql(name: str) -> str:
    return f"""SELECT '{name}' AS "column", count(*) FILTER ("{name}" IS NULL) AS nulls, count(*) FILTER ("{name}" IS NULL)::DOUBLE / count(*) AS share FROM credit"""


_ANY = " OR ".join(f'"{x}" IS NULL' for x in COLUMNS)
_NULLS = " UNION ALL ".join([_null_sql(x) for x in COLUMNS] + [f"""SELECT '<any>', count(*) FILTER ({_ANY}), count(*) FILTER ({_ANY})::DOUBLE / count(*) FROM credit"""])
_SENTINEL = "(" + " OR ".join(f'"{x}" IN (96, 98)' for x in COUNTERS) + ")"
_CONDITIONS = {"age < 18": "age < 18", "age = 0": "age = 0", "age > 100": "age > 100", "utilization > 1": f'"{UTILIZATION}" > 1', "utilization > 10": f'"{UTILIZATION}" > 10', "sentinel": _SENTINEL}
_RANKS = ", ".join(f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE) AS {x}" for x in _PAIR)
_SPEARMAN = f"WITH r AS (SELECT {_RANKS} FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS rho FROM r" for a, b in combinations(_PAIR, 2))


def _mean_corr(where: str) -> str:
    return "(SELECT avg(r) FROM (" + " UNION ALL ".join(f'SELECT corr("{a}", "{b}") AS r FROM credit {where}' for a, b in combinations(COUNTERS, 2)) + "))"


QUERIES = {f.__name__: f for f in (profile_describe, profile_describe_by_income, profile_nulls, profile_value_rates, profile_conditions, profile_duplicates, profile_pearson, profile_sentinel_correlation, profile_spearman, profile_top_pairs, profile_schema)}
SQL = {
    "profile_describe": rsql(f"SELECT feature, {_STATS} FROM {LINE_SQL} GROUP BY feature", "feature, n", _STAT_NAMES),
    "profile_describe_by_income": rsql(f'SELECT "{INCOME}" IS NOT NULL AS has_income, {_STATS.replace("value", chr(34) + DEBT_RATIO + chr(34))} FROM credit GROUP BY 1', "has_income, n", _STAT_NAMES, head=WITH_CREDIT),
    "profile_nulls": rsql(_NULLS, '"column", nulls', "share", head=WITH_CREDIT),
    "profile_value_rates": rsql(f"""SELECT "{LATE90}" AS "value", count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM credit) AS share, avg(CASE WHEN "{TARGET}" = '1' THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM credit GROUP BY 1""", '"value", n', "share, rate", head=WITH_CREDIT),
    "profile_conditions": WITH_CREDIT + " UNION ALL ".join(f" SELECT '{n}' AS condition, count(*) FILTER ({x}) AS n FROM credit" for n, x in _CONDITIONS.items()),
    "profile_duplicates": "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (n > 1) AS groups FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)",
    "profile_pearson": rsql(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM lineitem" for a, b in combinations(_PAIR, 2)), "x, y", "r"),
    "profile_sentinel_correlation": rsql(f"SELECT w AS with_sentinels, o AS without_sentinels, (w - o) / w >= 0.5 AS collapses FROM (SELECT {_mean_corr('')} AS w, {_mean_corr('WHERE NOT ' + _SENTINEL)} AS o)", "collapses", "with_sentinels, without_sentinels", head=WITH_CREDIT),
    "profile_spearman": rsql(_SPEARMAN, "x, y", "rho"),
    "profile_top_pairs": rsql(_SPEARMAN, "x, y", "rho") + " ORDER BY abs(rho) DESC, x, y LIMIT 3",
}
