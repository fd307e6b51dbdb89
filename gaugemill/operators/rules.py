"""Contracts: named rules with severities, evaluated in one pass over a batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import holds
from ..sources.tables import AGE, COLUMNS, COUNTERS, DEBT_RATIO, DEPENDENTS, FEATURES, INCOME, INCOME_MISSING, RAW_SCHEMA, TARGET, UTILIZATION

BLOCKER, WARNING = "blocker", "warning"
ROW, BATCH = "row", "batch"

#: Fixed values of the contract.
AGE_MIN, AGE_MAX = 18, 110
SENTINELS = (96, 98)
DEBT_RATIO_MAX = 2.0
RATE_MIN, RATE_MAX = 0.05, 0.09
SCHEMA_RULE = "schema_columns_and_dtypes"
SEVERITY = {
    SCHEMA_RULE: BLOCKER,
    "age_range": BLOCKER,
    "delinquency_sentinels": BLOCKER,
    "monthly_income_non_negative": BLOCKER,
    "dependents_non_negative": BLOCKER,
    "target_binary": BLOCKER,
    "nested_missingness": BLOCKER,
    "monthly_income_present": BLOCKER,
    "debt_ratio_unit_guard": BLOCKER,
    "no_nulls_in_features": BLOCKER,
    "no_duplicate_rows": WARNING,
    "revolving_utilization_at_most_one": WARNING,
    "positive_rate_band": WARNING,
}


class UnknownRuleError(KeyError):
    pass


@dataclass(frozen=True)
class Check:
    """One way a row can break a rule: ``violated`` is true, false or null (not a violation)."""

    rule: str
    column: str | None
    violated: Column


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def resolve_rule(name: str) -> str:
    """The severity of a rule; an unknown name raises."""
    if name not in SEVERITY:
        raise UnknownRuleError(name)
    return SEVERITY[name]


def severity_for(name: str) -> str:
    """The severity of a rule; an unknown name blocks."""
    return SEVERITY.get(name, BLOCKER)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SEVERITY.items()), "rule string, severity string")


def with_severity(df: DataFrame) -> DataFrame:
    """Joins the severity of ``rule``; unknown rules block. The rule table has thirteen rows."""
    return df.join(F.broadcast(rule_table(df.sparkSession)), "rule", "left").withColumn("severity", F.coalesce("severity", F.lit(BLOCKER)))


# Row checks. A null value breaks no column check unless the rule says so.


def age_range() -> list[Check]:
    return [Check("age_range", AGE, ~c(AGE).between(AGE_MIN, AGE_MAX))]


def sentinels() -> list[Check]:
    return [Check("delinquency_sentinels", x, c(x).isin(*SENTINELS)) for x in COUNTERS]


def income_non_negative() -> list[Check]:
    return [Check("monthly_income_non_negative", INCOME, c(INCOME) < 0)]


def dependents_non_negative() -> list[Check]:
    return [Check("dependents_non_negative", DEPENDENTS, c(DEPENDENTS) < 0)]


def utilization_at_most_one() -> list[Check]:
    return [Check("revolving_utilization_at_most_one", UTILIZATION, c(UTILIZATION) > 1)]


def target_binary() -> list[Check]:
    return [Check("target_binary", TARGET, ~c(TARGET).isin("0", "1"))]


def nested_missingness() -> list[Check]:
    """A missing number of dependents comes with a missing income."""
    return [Check("nested_missingness", None, c(DEPENDENTS).isNull() & c(INCOME).isNotNull())]


def income_present() -> list[Check]:
    """Here a null is a violation too."""
    return [Check("monthly_income_present", INCOME, c(INCOME).isNull() | (c(INCOME) <= 0))]


def debt_ratio_unit_guard() -> list[Check]:
    return [Check("debt_ratio_unit_guard", None, c(INCOME).isNotNull() & (c(DEBT_RATIO) > DEBT_RATIO_MAX))]


def no_nulls_in_features() -> list[Check]:
    return [Check("no_nulls_in_features", None, reduce(lambda a, b: a | b, [c(x).isNull() for x in FEATURES]))]


def not_null(columns) -> list[Check]:
    """A null in a column that is declared without nulls is a structural finding of its row."""
    return [Check(SCHEMA_RULE, x, c(x).isNull()) for x in columns]


def duplicate_rows(columns, key: str) -> Column:
    """Every row but the first (by ``key``) of those equal in all ``columns``, null equal to null."""
    return F.row_number().over(Window.partitionBy(*[c(x) for x in columns]).orderBy(c(key))) > 1


@dataclass(frozen=True)
class Contract:
    name: str
    schema: T.StructType
    checks: Callable[[], list[Check]]
    unique_over: tuple[str, ...] = ()
    rate_band: bool = False
    strict: bool = True

    def rule_names(self) -> set[str]:
        return {x.rule for x in self.checks()} | {SCHEMA_RULE} | ({"no_duplicate_rows"} if self.unique_over else set()) | ({"positive_rate_band"} if self.rate_band else set())


def _required(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if not f.nullable]


def _raw_checks() -> list[Check]:
    return [*not_null(_required(RAW_SCHEMA)), *age_range(), *sentinels(), *income_non_negative(), *dependents_non_negative(), *target_binary(), *nested_missingness(), *utilization_at_most_one()]


MODEL_SCHEMA = T.StructType([T.StructField(f.name, f.dataType, False) for f in RAW_SCHEMA] + [T.StructField(INCOME_MISSING, T.ByteType(), False)])
SCORING_SCHEMA = T.StructType([f for f in RAW_SCHEMA if f.name != TARGET])
LABEL_SCHEMA = T.StructType([f for f in RAW_SCHEMA if f.name == TARGET])


def _model_checks() -> list[Check]:
    return [*not_null(_required(MODEL_SCHEMA)), *_raw_checks()[len(_required(RAW_SCHEMA)) :], *income_present(), *debt_ratio_unit_guard(), *no_nulls_in_features()]


def _scoring_checks() -> list[Check]:
    return [*not_null(_required(SCORING_SCHEMA)), *age_range(), *sentinels(), *income_non_negative(), *dependents_non_negative(), *nested_missingness(), *utilization_at_most_one()]


RAW = Contract("raw", RAW_SCHEMA, _raw_checks, COLUMNS, True)
MODEL = Contract("model", MODEL_SCHEMA, _model_checks, (*COLUMNS, INCOME_MISSING), True, False)
SCORING = Contract("scoring", SCORING_SCHEMA, _scoring_checks, FEATURES, False, False)
LABEL = Contract("label", LABEL_SCHEMA, lambda: [*not_null([TARGET]), *target_binary()], (), True, False)


def assert_rules_are_classified(contract: Contract) -> None:
    """Before any row is read: every rule of the contract has a severity."""
    if missing := contract.rule_names() - SEVERITY.keys():
        raise UnknownRuleError(", ".join(sorted(missing)))


def structural_findings(df: DataFrame, contract: Contract, key: str) -> list[tuple[str, str | None]]:
    """(finding, column) where names, order or types differ; nothing is coerced. Without ``strict``
    further columns and another order are fine."""
    expected, there = contract.schema.fieldNames(), [x for x in df.columns if x != key]
    out: list[tuple[str, str | None]] = [("missing", x) for x in expected if x not in there]
    if contract.strict:
        out += [("unexpected", x) for x in there if x not in expected]
        if not out and there != expected:
            out.append(("order", None))
    out += [("dtype", f.name) for f in contract.schema if f.name in there and df.schema[f.name].dataType != f.dataType]
    return out


FAILURE = "row_index bigint, rule string, column string, observed string, severity string, scope string"


def failures(df: DataFrame, contract: Contract, key: str = "row_id") -> DataFrame:
    """One row per (rule, row, column) that fails and one per batch finding, with severity and scope.

    Row checks are one projection over the batch: an array of the violated checks, exploded. Only
    the duplicate rule shuffles. Checks on absent columns are skipped, since the schema finding
    already tells.
    """
    assert_rules_are_classified(contract)
    spark, there = df.sparkSession, set(df.columns)
    structural = structural_findings(df, contract, key)
    gone = {x for kind, x in structural if kind == "missing"}
    wrong = {x for kind, x in structural if kind == "dtype"}

    def usable(x: Check) -> bool:
        if x.column is not None:
            return x.column in there and not (x.column in wrong and isinstance(df.schema[x.column].dataType, T.StringType) and x.rule != "target_binary")
        return not gone

    checks = [x for x in contract.checks() if usable(x)]
    if contract.unique_over and not gone & set(contract.unique_over):
        df = df.withColumn("_repeat", duplicate_rows(contract.unique_over, key))
        checks.append(Check("no_duplicate_rows", None, F.col("_repeat")))
    kind = "struct<rule:string,column:string,observed:string,severity:string>"
    hit = [
        F.when(holds(x.violated), F.struct(F.lit(x.rule).alias("rule"), F.lit(x.column).cast("string").alias("column"), (c(x.column).cast("string") if x.column else F.lit(None).cast("string")).alias("observed"), F.lit(severity_for(x.rule)).alias("severity")).cast(kind))
        for x in checks
    ]
    rows = df.select(c(key).cast("long").alias("row_index"), F.inline(F.array_compact(F.array(*hit)))).withColumn("scope", F.lit(ROW))
    out = rows.select("row_index", "rule", "column", "observed", "severity", "scope")
    batch = [(None, SCHEMA_RULE, col, kind_, severity_for(SCHEMA_RULE), BATCH) for kind_, col in structural]
    if batch:
        out = out.unionByName(spark.createDataFrame(batch, FAILURE))
    if contract.rate_band and TARGET in there:
        rate = df.agg(F.avg((c(TARGET) == "1").cast("double")).alias("rate")).where(~holds(F.col("rate").between(RATE_MIN, RATE_MAX)))
        name = "positive_rate_band"
        out = out.unionByName(rate.select(F.lit(None).cast("long").alias("row_index"), F.lit(name).alias("rule"), F.lit(None).cast("string").alias("column"), F.format_number("rate", 6).alias("observed"), F.lit(severity_for(name)).alias("severity"), F.lit(BATCH).alias("scope")))
    return out


def rule_counts(fails: DataFrame) -> DataFrame:
    """Distinct rows plus batch findings per rule; scope is row if any row failed."""
    return fails.groupBy("rule", "severity").agg(
        F.when(F.count("row_index") > 0, F.lit(ROW)).otherwise(F.lit(BATCH)).alias("scope"), (F.countDistinct("row_index") + F.count_if(F.col("row_index").isNull())).cast("long").alias("rows")
    )


def monitor_counts(fails: DataFrame) -> DataFrame:
    """The monitor's count: distinct rows, or findings when no row is named. It differs from
    ``rule_counts`` for a rule that fails on rows and on the batch."""
    return fails.groupBy("rule", "severity").agg(F.coalesce(F.nullif(F.countDistinct("row_index"), F.lit(0)), F.count(F.lit(1))).cast("long").alias("violations"))


def blocking(fails: DataFrame) -> DataFrame:
    return fails.where(F.col("severity") == BLOCKER)


def verdict(fails: DataFrame) -> DataFrame:
    """One row: BLOCKED, ACCEPTED_WITH_WARNINGS or ACCEPTED."""
    has = lambda s: F.coalesce(F.bool_or(F.col("severity") == s), F.lit(False))
    return fails.agg(F.when(has(BLOCKER), F.lit("BLOCKED")).when(has(WARNING), F.lit("ACCEPTED_WITH_WARNINGS")).otherwise(F.lit("ACCEPTED")).alias("verdict"))


def row_counts(df: DataFrame, fails: DataFrame) -> DataFrame:
    """rows_in, rows_quarantined, rows_passed: the last two sum to the first."""
    bad = blocking(fails).where(F.col("row_index").isNotNull()).agg(F.countDistinct("row_index").alias("rows_quarantined"))
    return df.agg(F.count(F.lit(1)).alias("rows_in")).crossJoin(bad).select("rows_in", "rows_quarantined", (F.col("rows_in") - F.col("rows_quarantined")).alias("rows_passed"))


def quarantined(df: DataFrame, fails: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows with a blocking failure, once each."""
    bad = blocking(fails).where(F.col("row_index").isNotNull()).select(F.col("row_index").alias("_bad")).distinct()
    return df.join(bad, c(key) == F.col("_bad"), "left_semi")


class ContractBlockedError(ValueError):
    pass


def assert_passes(df: DataFrame, contract: Contract, key: str = "row_id") -> list:
    """Raises on blockers, returns warnings as rows of (rule, severity, scope, rows); at most 13."""
    found = rule_counts(failures(df, contract, key)).collect()
    if bad := [r for r in found if r.severity == BLOCKER]:
        raise ContractBlockedError("; ".join(f"{r.rule}: {r['rows']}" for r in bad))
    return found


def validate_or_none(df: DataFrame, contract: Contract, key: str = "row_id"):
    try:
        assert_passes(df, contract, key)
    except ContractBlockedError as e:
        return e
    return None


def assert_nested_missingness_subsumed(df: DataFrame) -> None:
    """Every row without dependents bears the income flag; run it between the flag and the fill."""
    n = df.where(c(DEPENDENTS).isNull() & (c(INCOME_MISSING) == 0)).count()
    if n:
        raise ValueError(f"{n} rows lack dependents without the income flag")


# Injected defects

DEFECTS = (("age_range", 3), ("delinquency_sentinels", 2), ("nested_missingness", 5), ("monthly_income_non_negative", 2), ("revolving_utilization_at_most_one", 3), ("no_duplicate_rows", 4))


def is_clean() -> Column:
    """A row that breaks no row rule and has both nullable columns."""
    bad = reduce(lambda a, b: a | b, [holds(x.violated) for x in _raw_checks()])
    return ~bad & c(INCOME).isNotNull() & c(DEPENDENTS).isNotNull()


def utilisation_in_range() -> Column:
    """A utilisation that does not warn either."""
    return c(UTILIZATION) <= 1


def inject_defects(base: DataFrame, include_blockers: bool = True, key: str = "row_id") -> tuple[DataFrame, dict[str, int]]:
    """``base`` (row_id 0.. of clean rows) with one kind of defect on each of disjoint row ranges, copies of
    four rows appended, and the age as bigint; and the manifest {rule: count}. Without blockers
    only the two warnings are planted, on the first rows."""
    injected, at, out = {}, 0, base
    spans = {}
    for rule, n in DEFECTS:
        if include_blockers or SEVERITY[rule] == WARNING:
            spans[rule] = (at, at + n - 1)
            injected[rule] = n
            at += n

    def put(column: str, rule: str, value) -> None:
        nonlocal out
        if rule in spans:
            v = value if isinstance(value, Column) else F.lit(value)
            out = out.withColumn(column, F.when(c(key).between(*spans[rule]), v.cast(base.schema[column].dataType)).otherwise(c(column)))

    put(AGE, "age_range", 12)
    put(COUNTERS[2], "delinquency_sentinels", 98)
    put(DEPENDENTS, "nested_missingness", None)
    put(INCOME, "monthly_income_non_negative", -1500.0)
    first = spans["revolving_utilization_at_most_one"][0]
    put(UTILIZATION, "revolving_utilization_at_most_one", F.lit(7.8) + F.lit(0.2) * (c(key) - first))
    copies = base.where(c(key).between(*spans["no_duplicate_rows"])).withColumn(key, c(key) + 1_000_000_000)
    out = out.unionByName(copies)
    if include_blockers:
        out = out.withColumn(AGE, c(AGE).cast("long"))
        injected[SCHEMA_RULE] = 1
    return out, injected
