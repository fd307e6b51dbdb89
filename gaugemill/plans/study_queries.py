"""Studies on the proxy tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import hash_uniform
from ..operators import mmd as M
from ..operators import psi as P
from ..operators import studies as ST
from ..operators.clean import income_missing
from ..operators.profile import pearson
from ..operators.rules import c
from ..sources import sinks
from ..sources.tables import COLUMNS, CONTINUOUS, DEBT_RATIO, INCOME, INCOME_MISSING, TARGET, UTILIZATION, credit, read_table
from .drift_queries import _EDGES, _REF, _ks_sql, _p_sql, _shares_sql, draws_sql
from .helpers import WITH_CREDIT, rounded, rsql
from .monitor_queries import _SCORED, _drift, _rank_sql, _scored
from .stream_queries import _state

_U = "(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
_DRAWS, _DRAWN = 500, 7000


def _sides(spark, d, *columns):
    """Seven tenths of the rows by hash are the reference, the rest is held out."""
    df = credit(spark, d, *columns).withColumn(INCOME_MISSING, income_missing()).withColumn("_u", hash_uniform("sides", "row_id"))
    return df.where("_u < 0.7").drop("_u"), df.where("_u >= 0.7").drop("_u")


def sensitivity_sweep(spark, d):
    score = 0.02 + 0.05 * F.least(c(DEBT_RATIO), F.lit(1.0)) + 0.05 * F.least(F.coalesce(c(INCOME), F.lit(5000.0)) / 20000, F.lit(1.0))
    return rounded(ST.sensitivity(*_sides(spark, d, TARGET, DEBT_RATIO, INCOME), score))


def ks_continuous(spark, d):
    return rounded(ST.ks_continuous(*_sides(spark, d, *CONTINUOUS)))


def prediction_drift(spark, d):
    s = _scored(spark, d)
    return rounded(ST.prediction_drift(s.where("month <= 6"), s.where("month > 6"), "month"))


def null_thresholds(spark, d):
    return rounded(ST.null_thresholds(_scored(spark, d), _DRAWN, _DRAWS))


def rate_matrix(spark, d):
    e = read_table(spark, d, "events").select(F.dayofmonth("ts").alias("day"), "event_type", (F.col("value") > 50).cast("double").alias("high"))
    return rounded(ST.mean_matrix(e, "day", "event_type", ["click", "purchase", "view"], "high"))


def expected_pair_rank(spark, d):
    r = pearson(read_table(spark, d, "lineitem"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax")).withColumn("size", F.abs("r"))
    return rounded(ST.rank_of_pair(r, "l_extendedprice", "l_quantity", "size"))


def numeric_sums(spark, d):
    df = ST.numeric_frame(credit(spark, d).drop("row_id"))
    return rounded(df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("numeric_columns"), F.avg(c(UTILIZATION)).alias("utilization"), F.avg(c(INCOME)).alias("income")))


def stable_sample(spark, d):
    return ST.stable_sample(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), 500, "stable", "o_orderkey")


def latest_batch(spark, d):
    o = read_table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("batch"), "o_orderkey")
    return ST.latest_by_name(o, "batch")


def highest_drift(spark, d):
    return rounded(ST.highest(_drift(spark, d), scenario="F", feature="1-URGENT"))


def run_metadata(spark, d):
    """Written as one JSON document and read back."""
    o = read_table(spark, d, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("rows"))
    path = f"{_state(spark)}-metadata"
    sinks.write_run_metadata({"seed": "20260921", "months": "12"}, o, path)
    back = sinks.read_document(spark, path, "config map<string,string>, results array<struct<month:int,rows:long>>")
    return back.select(F.col("config")["seed"].alias("seed"), F.inline("results"))


def mmd_context(spark, d):
    """The held-out side against the fitted reference, on normal scores of three columns."""
    ref, cur = _sides(spark, d)
    names = [UTILIZATION, "age", DEBT_RATIO]
    return M.context_test(cur, M.fit_context(ref, names, "context", rows=400), names, "holdout", "context-batch", rows=400, permutations=200)


_SIDES = f"""{WITH_CREDIT}, sides AS (SELECT *, "{DEBT_RATIO}" AS dr, "{INCOME}" AS inc, CASE WHEN "{TARGET}" = '1' THEN 1 ELSE 0 END AS y, {_U.format(seed='sides', key='row_id')} < 0.7 AS reference FROM credit)"""
_LEVELS = ", ".join(f"{x}::DOUBLE" for x in (0.0, *ST.LEVELS))
_SWEEP = f"""{_SIDES}, dn AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY {_U.format(seed="sensitivity:' || n || '", key='row_id')}, row_id) AS rk FROM sides, (SELECT unnest({list(ST.SIZES)}) AS n) WHERE NOT reference),
up AS (SELECT n, level, n || ':' || level AS cell, y, CASE WHEN inc > 0 THEN dr / (1.0::DOUBLE + level) ELSE dr END AS dr, CASE WHEN inc > 0 THEN inc * (1.0::DOUBLE + level) ELSE inc END AS inc FROM dn, (SELECT unnest([{_LEVELS}]) AS level) WHERE rk <= n),
s AS (SELECT n, level, y, 0.02::DOUBLE + 0.05::DOUBLE * least(dr, 1.0::DOUBLE) + 0.05::DOUBLE * least(coalesce(inc, 5000.0::DOUBLE) / 20000, 1.0::DOUBLE) AS p FROM up),
rf AS (SELECT '{DEBT_RATIO}' AS feature, dr AS value FROM sides WHERE reference UNION ALL SELECT '{INCOME}', inc FROM sides WHERE reference AND inc IS NOT NULL),
cr AS (SELECT cell, '{DEBT_RATIO}' AS feature, dr AS value FROM up WHERE level > 0 UNION ALL SELECT cell, '{INCOME}', inc FROM up WHERE level > 0 AND inc IS NOT NULL),
{_EDGES.replace(_REF, 'rf')}, {_shares_sql('r', 'rf')}, {_shares_sql('q', 'cr', 'cell')},
psis AS (SELECT cell, feature, sum((q.share - r.share) * ln(q.share / r.share)) AS psi FROM q JOIN r USING (feature, bin) GROUP BY ALL),
ks0 AS ({_ks_sql('rf', 'cr', 'cell')}), ks1 AS ({_p_sql('SELECT * FROM ks0', 'cell, feature')}),
auc AS ({_rank_sql('n, level')}), mean AS (SELECT n, level, avg(p) AS mp FROM s GROUP BY ALL), m AS (SELECT n, level, n || ':' || level AS cell, mp, auc FROM mean JOIN auc USING (n, level))"""
_KS_LONG = lambda side: " UNION ALL ".join(f"""SELECT '{x}' AS feature, "{x}"::DOUBLE AS value FROM sides WHERE {side}reference AND "{x}" IS NOT NULL""" for x in CONTINUOUS)
_P_REF, _P_CUR = "(SELECT 'p' AS feature, p AS value FROM s WHERE month <= 6)", "(SELECT month, 'p' AS feature, p AS value FROM s WHERE month > 6)"
_NULLS = f"""{_SCORED}, {draws_sql("s", "row_id", "null", [_DRAWN], _DRAWS)},
d AS MATERIALIZED (SELECT repeat, y, p FROM drawn JOIN ranked USING (place)), auc AS ({_rank_sql('repeat', 'd')}), gap AS (SELECT repeat, avg(p) - avg(y) AS calibration_gap FROM d GROUP BY repeat)"""

QUERIES = {f.__name__: f for f in (sensitivity_sweep, ks_continuous, prediction_drift, null_thresholds, rate_matrix, expected_pair_rank, numeric_sums, stable_sample, latest_batch, highest_drift, run_metadata, mmd_context)}
SQL = {
    "sensitivity_sweep": rsql("""SELECT x.level, CAST(x.n AS INTEGER) AS n, k.feature AS "column", k.ks AS ks_statistic, k.pvalue AS ks_pvalue, psi, x.mp - o.mp AS mean_prediction_shift, x.auc - o.auc AS auc_delta
      FROM ks1 k JOIN psis USING (cell, feature) JOIN m x USING (cell) JOIN m o ON o.n = x.n AND o.level = 0""", 'n, "column"', "level, ks_statistic, ks_pvalue, psi, mean_prediction_shift, auc_delta", head=_SWEEP),
    "ks_continuous": rsql(_p_sql(_ks_sql("rf", "cr"), "feature"), "feature, n_ref, n_cur", "ks, pvalue", head=f"{_SIDES}, rf AS ({_KS_LONG('')}), cr AS ({_KS_LONG('NOT ')})"),
    "prediction_drift": rsql("SELECT month, psi FROM psis", "month", "psi", head=f"{_SCORED}, {_EDGES.replace(_REF, _P_REF)}, {_shares_sql('r', _P_REF)}, {_shares_sql('q', _P_CUR, 'month')}, psis AS (SELECT month, sum((q.share - r.share) * ln(q.share / r.share)) AS psi FROM q JOIN r USING (feature, bin) GROUP BY month)"),
    "null_thresholds": rsql("SELECT count(*) AS draws, quantile_cont(calibration_gap, 0.005::DOUBLE) AS gap_threshold, quantile_cont(auc, 0.01::DOUBLE) AS auc_threshold FROM gap JOIN auc USING (repeat)", "draws", "gap_threshold, auc_threshold", head=_NULLS),
    "rate_matrix": rsql("SELECT CAST(day(ts) AS INTEGER) AS day, " + ", ".join(f"avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END) FILTER (event_type = '{t}') AS {t}" for t in ("click", "purchase", "view")) + " FROM events GROUP BY day(ts)", "day", "click, purchase, view"),
    "expected_pair_rank": rsql("SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY size DESC, x, y) AS INTEGER) AS place FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, abs(corr({a}, {b})) AS size FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))) + ")) WHERE x = 'l_quantity' AND y = 'l_extendedprice'", "x, y, place", "size"),
    "numeric_sums": rsql(f'SELECT count(*) AS rows, {len(COLUMNS) - 1}::INTEGER AS numeric_columns, avg("{UTILIZATION}") AS utilization, avg("{INCOME}") AS income FROM credit', "rows, numeric_columns", "utilization, income", head=WITH_CREDIT),
    "stable_sample": f"SELECT o_orderkey, o_orderpriority FROM orders ORDER BY {_U.format(seed='stable', key='o_orderkey')}, o_orderkey LIMIT 500",
    "latest_batch": "SELECT strftime(o_orderdate, '%Y-%m') AS batch, o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') = (SELECT max(strftime(o_orderdate, '%Y-%m')) FROM orders)",
    "highest_drift": rsql("SELECT max(psi) AS psi FROM (SELECT max(o_orderkey) % 400 / 1000.0::DOUBLE AS psi FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY strftime(o_orderdate, '%m'))", "", "psi"),
    "run_metadata": "SELECT '20260921' AS seed, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS rows FROM orders GROUP BY month(o_orderdate)",
}
