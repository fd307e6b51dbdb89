"""Tables: reads, and the stand-ins for the monitored credit data that the generated tables give.

The monitored table has eleven columns (a binary target and ten features). Here each order stands for
one borrower: two MD5s of its key give uniform numbers from which the columns are made with ordinary
arithmetic, so that Spark and DuckDB build the same rows from one text. Missing income, sentinel
counts, impossible ages and extreme utilisations occur at known rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET = "SeriousDlqin2yrs"
UTILIZATION = "RevolvingUtilizationOfUnsecuredLines"
AGE = "age"
LATE30 = "NumberOfTime30-59DaysPastDueNotWorse"
DEBT_RATIO = "DebtRatio"
INCOME = "MonthlyIncome"
OPEN_LINES = "NumberOfOpenCreditLinesAndLoans"
LATE90 = "NumberOfTimes90DaysLate"
REAL_ESTATE = "NumberRealEstateLoansOrLines"
LATE60 = "NumberOfTime60-89DaysPastDueNotWorse"
DEPENDENTS = "NumberOfDependents"
INCOME_MISSING = "income_missing"

COUNTERS = (LATE30, LATE60, LATE90)
FEATURES = (UTILIZATION, AGE, LATE30, DEBT_RATIO, INCOME, OPEN_LINES, LATE90, REAL_ESTATE, LATE60, DEPENDENTS)
MODEL_FEATURES = (*FEATURES, INCOME_MISSING)
COLUMNS = (TARGET, *FEATURES)
CONTINUOUS = (UTILIZATION, AGE, DEBT_RATIO, INCOME)

RAW_SCHEMA = T.StructType([
    T.StructField(TARGET, T.StringType(), False), T.StructField(UTILIZATION, T.DoubleType(), False), T.StructField(AGE, T.ShortType(), False),
    T.StructField(LATE30, T.ShortType(), False), T.StructField(DEBT_RATIO, T.DoubleType(), False), T.StructField(INCOME, T.DoubleType(), True),
    T.StructField(OPEN_LINES, T.ShortType(), False), T.StructField(LATE90, T.ShortType(), False), T.StructField(REAL_ESTATE, T.ShortType(), False),
    T.StructField(LATE60, T.ShortType(), False), T.StructField(DEPENDENTS, T.DoubleType(), True),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_existing(spark: SparkSession, path: str, hint: str) -> DataFrame:
    """A read that says which command makes the table when it is missing."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path} is missing; run: {hint}") from e


_SPARK_U = "cast(conv(substr(m{k}, {at}, 4), 16, 10) AS DOUBLE) / 65536e0"
_DUCK_U = "('0x' || substr(m{k}, {at}, 4))::INTEGER::DOUBLE / 65536e0"

#: Portable SQL; double quotes become backticks for Spark.
_CREDIT = """
SELECT row_id,
  CASE WHEN u0 < 0.015e0 + 0.12e0 * u1 * u1 + 0.05e0 * u6 * u6 * u6 THEN '1' ELSE '0' END AS "SeriousDlqin2yrs",
  CASE WHEN u2 > 0.97e0 THEN floor((1e0 + 14e0 * u3) * 1e4) / 1e4 ELSE floor(u1 * 9900e0) / 1e4 END AS "RevolvingUtilizationOfUnsecuredLines",
  CAST(CASE WHEN u4 < 0.002e0 THEN 0 WHEN u4 > 0.999e0 THEN 112 ELSE 21 + floor(68e0 * u5) END AS SMALLINT) AS "age",
  CAST(CASE WHEN u6 > 0.998e0 THEN 98 WHEN u6 > 0.9975e0 THEN 96 ELSE floor(6e0 * u6 * u6 * u6 * u6 * u6 * u6) END AS SMALLINT) AS "NumberOfTime30-59DaysPastDueNotWorse",
  CASE WHEN u8 < 0.2e0 THEN CAST(floor(3000e0 * u9) AS DOUBLE) ELSE floor(u9 * 19000e0) / 1e4 END AS "DebtRatio",
  CASE WHEN u8 < 0.2e0 THEN NULL WHEN u8 > 0.99e0 THEN 0e0 ELSE CAST(floor(1200e0 + 18000e0 * u10 * u10) AS DOUBLE) END AS "MonthlyIncome",
  CAST(1 + floor(18e0 * u11) AS SMALLINT) AS "NumberOfOpenCreditLinesAndLoans",
  CAST(CASE WHEN u6 > 0.998e0 THEN 98 WHEN u6 > 0.9975e0 THEN 96 ELSE floor(3e0 * u12 * u12 * u12 * u12) END AS SMALLINT) AS "NumberOfTimes90DaysLate",
  CAST(floor(18e0 * u11 / 7e0 + u13) AS SMALLINT) AS "NumberRealEstateLoansOrLines",
  CAST(CASE WHEN u6 > 0.998e0 THEN 98 WHEN u6 > 0.9975e0 THEN 96 ELSE floor(3e0 * u14 * u14 * u14) END AS SMALLINT) AS "NumberOfTime60-89DaysPastDueNotWorse",
  CAST(CASE WHEN u8 < 0.03e0 THEN NULL ELSE floor(5e0 * u15 * u15) END AS DOUBLE) AS "NumberOfDependents"
FROM u
"""


def _credit_sql(u: str, key: str = "o_orderkey", table: str = "orders") -> str:
    us = ", ".join(u.format(k=1 + k // 8, at=1 + 4 * (k % 8)) + f" AS u{k}" for k in range(16))
    return f"WITH m AS (SELECT {key} AS row_id, md5(concat('a:', CAST({key} AS VARCHAR(20)))) AS m1, md5(concat('b:', CAST({key} AS VARCHAR(20)))) AS m2 FROM {table}), u AS (SELECT row_id, {us} FROM m) {_CREDIT}"


def credit(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``row_id`` and the eleven columns, or those that are named, one row per order.

    The columns come out of one generator row: an optimiser that moves filters and expressions
    through a projection would otherwise paste the MD5 arithmetic wherever a column is named. Nor does it take unused ones out of the row, so
    name the columns where only a few are read."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    rows = spark.sql(_credit_sql(_SPARK_U, table="{orders}").replace('"', "`").replace("VARCHAR(20)", "STRING"), orders=orders)
    once = rows.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns if not columns or c in ("row_id", *columns)]))))
    return once


#: The same rows for DuckDB, as a parenthesised table.
CREDIT_SQL = f"({_credit_sql(_DUCK_U)})"

#: Six numeric columns in long form with the part (reference or current) they belong to; the last one
#: is zero for two thirds of its rows.
LINE_FEATURES = {
    "l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount", "l_tax": "l_tax",
    "l_linenumber": "CAST(l_linenumber AS DOUBLE)", "returned_value": "CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0e0 END",
}
CUT = "1998-01-01"


def line_features(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """(keys..., reference boolean, feature, value) of ``lineitem``. A key is a column or ``expression AS name``, computed once a row."""
    df = read_table(spark, sf_dir, "lineitem")
    rows = df.selectExpr(*keys, f"l_shipdate < TIMESTAMP_NTZ '{CUT} 00:00:00' AS reference", *[f"{e} AS _f{i}" for i, e in enumerate(LINE_FEATURES.values())])
    stack = ", ".join(f"'{n}', _f{i}" for i, n in enumerate(LINE_FEATURES))
    return rows.selectExpr(*[k.rpartition(" AS ")[2] for k in keys], "reference", f"stack({len(LINE_FEATURES)}, {stack}) AS (feature, value)")


#: One row of lists instead of a union of constants, which the engine's dictionary cache trips over at times.
LINE_SQL = f"(SELECT l_shipdate, l_shipdate < TIMESTAMP '{CUT} 00:00:00' AS reference, unnest([{', '.join(repr(n) for n in LINE_FEATURES)}]) AS feature, unnest([{', '.join(f'({e})::DOUBLE' for e in LINE_FEATURES.values())}]) AS value FROM lineitem)"
