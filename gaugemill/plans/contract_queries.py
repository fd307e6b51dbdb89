"""Contracts, gate, cleaning, sampling and splitting on the credit rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import rules as R
from ..operators import sampling as S
from ..sources import runs
from ..sources.tables import AGE, COLUMNS, COUNTERS, DEBT_RATIO, DEPENDENTS, FEATURES, INCOME, INCOME_MISSING, TARGET, UTILIZATION, credit, read_table
from .helpers import WITH_CREDIT, rounded, rsql

c = R.c


def _raw(spark, d):
    return R.failures(credit(spark, d), R.RAW)


def contract_rule_counts(spark, d):
    return R.rule_counts(_raw(spark, d))


def contract_monitor_counts(spark, d):
    return R.monitor_counts(_raw(spark, d))


def contract_rejections(spark, d):
    return R.blocking(_raw(spark, d)).where("rule <> 'delinquency_sentinels'").select("row_index", "rule", "column", "severity", "scope")


def contract_quarantine(spark, d):
    df = credit(spark, d)
    return R.quarantined(df, R.failures(df, R.RAW)).select("row_id", AGE, INCOME)


def contract_verdict(spark, d):
    df = credit(spark, d)
    fails = R.failures(df, R.RAW)
    return R.verdict(fails).crossJoin(R.row_counts(df, fails))


def contract_scoring_counts(spark, d):
    return R.rule_counts(R.failures(credit(spark, d).drop(TARGET), R.SCORING))


def contract_label_counts(spark, d):
    """Labels of which one in forty is unreadable: the label contract."""
    df = credit(spark, d, TARGET).select("row_id", F.when(F.col("row_id") % 40 == 0, "x").otherwise(c(TARGET)).alias(TARGET))
    return R.rule_counts(R.failures(df, R.LABEL))


def contract_model_counts(spark, d):
    df = credit(spark, d).withColumn(INCOME_MISSING, C.income_missing())
    return R.rule_counts(R.failures(df, R.MODEL))


def contract_manifest(spark, d):
    """Planted defects against counted ones, on a base of 200 clean rows drawn by class from the whole table."""
    base = runs.clean_base(credit(spark, d), 200)
    base = spark.createDataFrame(base.collect(), base.schema)  # 200 rows, planted by their number
    out, manifest = R.inject_defects(base)
    counted = R.rule_counts(R.failures(out, R.RAW)).where("rule <> 'positive_rate_band'")
    planted = spark.createDataFrame(sorted(manifest.items()), "rule string, planted int")
    return planted.join(counted.select("rule", "rows"), "rule", "full").select("rule", F.col("planted").cast("long"), F.col("rows").cast("long"))


def rule_registry(spark, d):
    return R.rule_table(spark)


def clean_report(spark, d):
    return rounded(C.clean_report(credit(spark, d)))


def clean_rows(spark, d):
    return rounded(C.clean(credit(spark, d)).select("row_id", F.col(DEBT_RATIO).alias("debt_ratio"), F.col(INCOME).alias("income"), F.col(UTILIZATION).alias("utilization"), F.col(DEPENDENTS).alias("dependents"), F.col(INCOME_MISSING).cast("int")))


def impute_median(spark, d):
    return rounded(C.fit_imputation(C.clean(credit(spark, d))))


def imputed_rows(spark, d):
    """Fitted on the reference side of a stratified split, applied to both."""
    cleaned = C.clean(credit(spark, d)).withColumn("y", c(TARGET))
    split = S.stratified_split(cleaned, "y", {"reference": 0.7, "holdout": 0.3}, "split", "row_id").drop("y")
    fit = C.fit_imputation(split.where("split = 'reference'"))
    return rounded(C.impute(split, fit).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.avg(c(INCOME)).alias("income_mean"), F.avg(c(DEBT_RATIO)).alias("debt_ratio_mean")))


def scoreable_batch(spark, d):
    df = C.make_scoreable(credit(spark, d, INCOME, DEBT_RATIO))
    return rounded(df.groupBy(F.col(INCOME_MISSING).cast("int").alias("flag")).agg(F.count(F.lit(1)).alias("rows"), F.avg(c(INCOME)).alias("income_mean")))


def dedup_first(spark, d):
    cols = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    df = read_table(spark, d, "lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return df.withColumn("_r", R.duplicate_rows(cols, "k")).where("NOT _r").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def split_stratified(spark, d):
    df = credit(spark, d, TARGET).select("row_id", F.col(TARGET).alias("y"))
    return S.stratified_split(df, "y", {"train": 0.6, "calibration": 0.2, "validation": 0.2}, "three", "row_id")


def split_metadata(spark, d):
    return rounded(S.split_metadata(split_stratified(spark, d), F.col("y") == "1"))


def sample_hash_topk(spark, d):
    return S.uniform_sample(read_table(spark, d, "events").select("event_id"), 500, "sample", "event_id")


def sample_gumbel_topk(spark, d):
    return S.gumbel_sample(read_table(spark, d, "events").select("event_id", "value"), 500, "gumbel", "event_id", F.log1p("value")).select("event_id")


def sample_stratified(spark, d):
    df = read_table(spark, d, "events").select("event_id", "event_type")
    return S.stratified_sample(df, "event_type", {"click": 40, "view": 30, "purchase": 20}, "strata", "event_id")


def feature_matrix_sums(spark, d):
    m = C.feature_matrix(credit(spark, d).withColumn(INCOME_MISSING, C.income_missing()))
    return rounded(m.groupBy(F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("rows"), F.avg(c(UTILIZATION)).alias("utilization"), F.avg(c(AGE)).alias("age")))


_DUP = f"row_number() OVER (PARTITION BY {', '.join(chr(34) + x + chr(34) for x in COLUMNS)} ORDER BY row_id) > 1"
_DUP_F = f"row_number() OVER (PARTITION BY {', '.join(chr(34) + x + chr(34) for x in FEATURES)} ORDER BY row_id) > 1"
_ROW_RULES = {
    "age_range": [(AGE, "age NOT BETWEEN 18 AND 110")], "delinquency_sentinels": [(x, f'"{x}" IN (96, 98)') for x in COUNTERS], "monthly_income_non_negative": [(INCOME, f'"{INCOME}" < 0')],
    "dependents_non_negative": [(DEPENDENTS, f'"{DEPENDENTS}" < 0')], "target_binary": [(TARGET, f"\"{TARGET}\" NOT IN ('0', '1')")], "nested_missingness": [(None, f'"{DEPENDENTS}" IS NULL AND "{INCOME}" IS NOT NULL')],
    "revolving_utilization_at_most_one": [(UTILIZATION, f'"{UTILIZATION}" > 1')],
}


def _fails(rules: dict, dup: str, source: str = "credit", rate: bool = True, required: tuple = ()) -> str:
    lines = []
    for rule, checks in rules.items():
        for col, cond in checks:
            name = "NULL" if col is None else f"'{col}'"
            lines.append(f"""SELECT row_id AS row_index, '{rule}' AS rule, {name}::VARCHAR AS "column", '{R.SEVERITY[rule]}' AS severity, 'row' AS scope FROM {source} WHERE {cond}""")
    lines += [f"""SELECT row_id, '{R.SCHEMA_RULE}', '{x}', 'blocker', 'row' FROM {source} WHERE "{x}" IS NULL""" for x in required]
    if dup:
        lines.append(f"SELECT row_id, 'no_duplicate_rows', NULL, 'warning', 'row' FROM (SELECT row_id, {dup} AS r FROM {source}) WHERE r")
    if rate:
        lines.append(f"""SELECT NULL, 'positive_rate_band', NULL, 'warning', 'batch' FROM (SELECT avg(CASE WHEN "{TARGET}" = '1' THEN 1.0::DOUBLE ELSE 0 END) AS r FROM {source}) WHERE NOT coalesce(r BETWEEN 0.05 AND 0.09, false)""")
    return " UNION ALL ".join(lines)


_RAW_F = f"{WITH_CREDIT}, f AS ({_fails(_ROW_RULES, _DUP)})"
_COUNT = "SELECT rule, severity, CASE WHEN count(row_index) > 0 THEN 'row' ELSE 'batch' END AS scope, count(DISTINCT row_index) + count(*) FILTER (row_index IS NULL) AS rows FROM f GROUP BY rule, severity"
_SCORE_F = f"{WITH_CREDIT}, f AS ({_fails({k: v for k, v in _ROW_RULES.items() if k != 'target_binary'}, _DUP_F, rate=False)})"
_LABELS = f"""(SELECT row_id, CASE WHEN row_id % 40 = 0 THEN 'x' ELSE "{TARGET}" END AS "{TARGET}" FROM credit)"""
_LABEL_F = f"{WITH_CREDIT}, f AS ({_fails({'target_binary': _ROW_RULES['target_binary']}, '', source=_LABELS)})"
_MODEL_RULES = _ROW_RULES | {
    "monthly_income_present": [(INCOME, f'"{INCOME}" IS NULL OR "{INCOME}" <= 0')], "debt_ratio_unit_guard": [(None, f'"{INCOME}" IS NOT NULL AND "{DEBT_RATIO}" > 2')],
    "no_nulls_in_features": [(None, " OR ".join(f'"{x}" IS NULL' for x in FEATURES))],
}
_MODEL_F = f"{WITH_CREDIT}, f AS ({_fails(_MODEL_RULES, _DUP, required=(INCOME, DEPENDENTS))})"
_CLEAN = f"""{WITH_CREDIT}, s AS (
  SELECT *, {_DUP} AS source_dup, ({" OR ".join(f'"{x}" IN (96, 98)' for x in COUNTERS)}) AS sentinel, age NOT BETWEEN 18 AND 110 AS bad_age,
    CASE WHEN "{INCOME}" IS NULL OR "{INCOME}" = 0 THEN 1 ELSE 0 END AS flag FROM credit
), t AS (
  SELECT *, CASE WHEN flag = 0 THEN "{INCOME}" END AS income, CASE WHEN flag = 0 THEN CASE WHEN "{DEBT_RATIO}" > 2 THEN 2.0::DOUBLE ELSE "{DEBT_RATIO}" END END AS debt_ratio,
    CASE WHEN "{UTILIZATION}" > 10 THEN 10.0::DOUBLE ELSE "{UTILIZATION}" END AS utilization, coalesce("{DEPENDENTS}", 0) AS dependents, NOT sentinel AND NOT bad_age AS stays FROM s
), u AS (
  SELECT *, stays AND row_number() OVER (PARTITION BY stays, flag, income, debt_ratio, utilization, dependents, "{TARGET}", age, {", ".join(f'"{x}"' for x in FEATURES if x not in (AGE, INCOME, DEBT_RATIO, UTILIZATION, DEPENDENTS))} ORDER BY row_id) > 1 AS rep FROM t
)"""
_KEEP = "stays AND NOT rep"
_U = "(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


def _split(source: str, by: str, seed: str, names: list[tuple[str, float]]) -> str:
    u = _U.format(seed=seed, key="row_id")
    case = " ".join(f"WHEN rk <= round(sz * {x}::DOUBLE) THEN '{n}'" for n, x in names[:-1])
    return f"SELECT *, CASE {case} ELSE '{names[-1][0]}' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {u}, row_id) AS rk, count(*) OVER (PARTITION BY {by}) AS sz FROM {source})"


_THREE = _split("credit", f'"{TARGET}"', "three", [("train", 0.6), ("calibration", 0.8), ("validation", 1.0)])
_TWO = _split(f"(SELECT * FROM u WHERE {_KEEP})", f'"{TARGET}"', "split", [("reference", 0.7), ("holdout", 1.0)])
_REST = ", ".join(f'"{x}"' for x in FEATURES if x not in (INCOME, DEBT_RATIO, UTILIZATION, DEPENDENTS))
_IMPUTED = f"""{_CLEAN}, s2 AS ({_TWO}), f AS (SELECT quantile_cont(CASE WHEN flag = 0 THEN income END, 0.5) AS im, quantile_cont(CASE WHEN flag = 0 THEN debt_ratio END, 0.5) AS dm FROM s2 WHERE split = 'reference'),
g AS (SELECT s2.*, coalesce(income, im) AS inc, coalesce(debt_ratio, dm) AS dr FROM s2, f),
h AS (SELECT *, row_number() OVER (PARTITION BY flag, inc, dr, utilization, dependents, "{TARGET}", {_REST} ORDER BY row_id) AS k FROM g)
"""

QUERIES = {
    f.__name__: f
    for f in (
        contract_rule_counts, contract_monitor_counts, contract_rejections, contract_quarantine, contract_verdict, contract_scoring_counts, contract_label_counts, contract_model_counts, contract_manifest, rule_registry, clean_report, clean_rows,
        impute_median, imputed_rows, scoreable_batch, dedup_first, split_stratified, split_metadata, sample_hash_topk, sample_gumbel_topk, sample_stratified, feature_matrix_sums,
    )
}
SQL = {
    "contract_rule_counts": f"{_RAW_F} {_COUNT}",
    "contract_monitor_counts": f"{_RAW_F} SELECT rule, severity, CASE WHEN count(row_index) > 0 THEN count(DISTINCT row_index) ELSE count(*) END AS violations FROM f GROUP BY rule, severity",
    "contract_rejections": f"""{_RAW_F} SELECT row_index, rule, "column", severity, scope FROM f WHERE severity = 'blocker' AND rule <> 'delinquency_sentinels'""",
    "contract_quarantine": f"""{_RAW_F} SELECT row_id, age, "{INCOME}" FROM credit WHERE row_id IN (SELECT row_index FROM f WHERE severity = 'blocker')""",
    "contract_verdict": f"""{_RAW_F} SELECT CASE WHEN (SELECT bool_or(severity = 'blocker') FROM f) THEN 'BLOCKED' WHEN (SELECT count(*) FROM f) > 0 THEN 'ACCEPTED_WITH_WARNINGS' ELSE 'ACCEPTED' END AS verdict,
      n AS rows_in, b AS rows_quarantined, n - b AS rows_passed FROM (SELECT count(*) AS n FROM credit), (SELECT count(DISTINCT row_index) AS b FROM f WHERE severity = 'blocker')""",
    "contract_scoring_counts": f"{_SCORE_F} {_COUNT}",
    "contract_label_counts": f"{_LABEL_F} {_COUNT}",
    "contract_model_counts": f"{_MODEL_F} {_COUNT}",
    "contract_manifest": "SELECT * FROM (VALUES " + ", ".join(f"('{r}', {n}::BIGINT, {n}::BIGINT)" for r, n in [*R.DEFECTS, (R.SCHEMA_RULE, 1)]) + ") AS t(rule, planted, rows)",
    "rule_registry": "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{s}')" for r, s in R.SEVERITY.items()) + ") AS t(rule, severity)",
    "clean_report": rsql(f"""SELECT count(*) AS rows_in, count(*) FILTER (source_dup) AS source_duplicates, count(*) FILTER (sentinel) AS sentinels_dropped, count(*) FILTER (NOT sentinel AND bad_age) AS ages_dropped,
      count(*) FILTER (stays AND flag = 1) AS income_missing, count(*) FILTER (stays AND flag = 0 AND "{DEBT_RATIO}" > 2) AS debt_ratio_capped, count(*) FILTER (stays AND "{UTILIZATION}" > 10) AS utilization_capped,
      count(*) FILTER (stays AND "{DEPENDENTS}" IS NULL) AS dependents_filled, count(*) FILTER (rep) AS duplicates_dropped, count(*) FILTER ({_KEEP}) AS rows_out, avg(CASE WHEN {_KEEP} THEN CASE WHEN "{TARGET}" = '1' THEN 1.0::DOUBLE ELSE 0 END END) AS positive_rate FROM u""",
      "rows_in, source_duplicates, sentinels_dropped, ages_dropped, income_missing, debt_ratio_capped, utilization_capped, dependents_filled, duplicates_dropped, rows_out", "positive_rate", head=_CLEAN),
    "clean_rows": rsql(f"SELECT row_id, flag AS income_missing, debt_ratio, income, utilization, dependents FROM u WHERE {_KEEP}", "row_id, income_missing", "debt_ratio, income, utilization, dependents", head=_CLEAN),
    "impute_median": rsql(f"SELECT quantile_cont(CASE WHEN flag = 0 THEN income END, 0.5) AS income_median, quantile_cont(CASE WHEN flag = 0 THEN debt_ratio END, 0.5) AS debt_ratio_median FROM u WHERE {_KEEP}", "", "income_median, debt_ratio_median", head=_CLEAN),
    "imputed_rows": rsql("SELECT split, count(*) AS rows, avg(inc) AS income_mean, avg(dr) AS debt_ratio_mean FROM h WHERE k = 1 GROUP BY split", "split, rows", "income_mean, debt_ratio_mean", head=_IMPUTED),
    "scoreable_batch": rsql(f"""SELECT CASE WHEN "{INCOME}" IS NULL OR "{INCOME}" = 0 THEN 1 ELSE 0 END AS flag, count(*) AS rows, avg(coalesce("{INCOME}", m)) AS income_mean FROM credit, (SELECT quantile_cont(CASE WHEN "{INCOME}" > 0 THEN "{INCOME}" END, 0.5) AS m FROM credit) GROUP BY 1""", "flag, rows", "income_mean", head=WITH_CREDIT),
    "dedup_first": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1",
    "split_stratified": f'{WITH_CREDIT} SELECT row_id, "{TARGET}" AS y, split FROM ({_THREE})',
    "split_metadata": rsql(f"""SELECT split, count(*) AS rows, avg(CASE WHEN "{TARGET}" = '1' THEN 1.0::DOUBLE ELSE 0 END) AS positive_rate FROM ({_THREE}) GROUP BY split""", "split, rows", "positive_rate", head=WITH_CREDIT),
    "sample_hash_topk": f"SELECT event_id FROM events ORDER BY {_U.format(seed='sample', key='event_id')}, event_id LIMIT 500",
    "sample_gumbel_topk": f"SELECT event_id FROM events ORDER BY ln(1 + value) - ln(-ln({_U.format(seed='gumbel', key='event_id')})) DESC, event_id LIMIT 500",
    "sample_stratified": f"SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_U.format(seed='strata', key='event_id')}, event_id) AS k FROM events) WHERE k <= CASE event_type WHEN 'click' THEN 40 WHEN 'view' THEN 30 WHEN 'purchase' THEN 20 ELSE 0 END",
    "feature_matrix_sums": rsql(f"""SELECT CASE WHEN "{TARGET}" = '1' THEN 1 ELSE 0 END AS y, count(*) AS rows, avg("{UTILIZATION}") AS utilization, avg(age) AS age FROM credit GROUP BY 1""", "y, rows", "utilization, age", head=WITH_CREDIT),
}
