"""Metrics, fairness, simulation and monitoring on the proxy tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import Z95, hash_uniform, salted_id
from ..operators import fairness as FA
from ..operators import metrics as M
from ..operators import models as MO
from ..operators import monitor as MON
from ..operators import simulate as SIM
from ..operators.clean import clean, feature_matrix, fit_imputation, impute, income_missing
from ..operators.ecdf import fit_ecdf, midrank_of_own, normal_score
from ..operators.profile import to_long
from ..operators.rules import c
from ..operators.sampling import stratified_split
from ..sources import sinks
from ..sources.tables import AGE, CONTINUOUS, DEBT_RATIO, INCOME, INCOME_MISSING, LATE30, LATE60, LATE90, LINE_FEATURES, TARGET, UTILIZATION, credit, read_table
from .helpers import WITH_CREDIT, rounded, rsql, written

_U = "(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


def _scored(spark, d):
    """The stub scorer on a clipped utilisation; y from the target; month from the order date."""
    df = credit(spark, d, AGE, UTILIZATION, TARGET).select("row_id", c(AGE).alias("age"), c(UTILIZATION).alias("u"), F.when(c(TARGET) == "1", 1).otherwise(0).alias("y"))
    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.month("o_orderdate").alias("month"))
    u = F.floor(F.least(F.col("u"), F.lit(1.0)) * 200) / 200
    return df.join(orders, "row_id").select("row_id", "age", "month", "y", (MO.stub_score(u) * 0.12).alias("p"))


def auc_roc(spark, d):
    return rounded(M.ranking(_scored(spark, d)))


def ks_separation(spark, d):
    return rounded(M.ranking(_scored(spark, d), "month").select("month", "ks", "ks_threshold"))


def monthly_metrics(spark, d):
    return rounded(M.batch_metrics(_scored(spark, d), "month"))


def _runs(spark, d):
    s = _scored(spark, d).withColumn("seed", (F.col("row_id") % 5).cast("int"))
    both = s.withColumn("model", F.lit("stub")).unionByName(s.withColumn("p", F.col("age") / 200.0).withColumn("model", F.lit("age")))
    return M.ranking(both, "model", "seed").select("model", "seed", "auc")


def champion(spark, d):
    return rounded(M.champion(M.seed_summary(_runs(spark, d)).select("model", F.col("mean").alias("auc"))))


def seed_noise(spark, d):
    return rounded(M.seed_summary(_runs(spark, d)))


def seed_paired_delta(spark, d):
    return rounded(M.paired_delta(_runs(spark, d), "stub", "age"))


def _bands(spark, d, *by):
    s = _scored(spark, d).withColumn("band", FA.band_of(F.col("age"))).withColumn("half", F.when(F.col("month") <= 6, "first").otherwise("second"))
    return FA.band_table(s, 0.06, *by)


def band_metrics(spark, d):
    return rounded(_bands(spark, d))


def wilson_bands(spark, d):
    return rounded(_bands(spark, d, "half").select("half", "band", "n", "approval_low", "approval_high", "tpr_low", "tpr_high", "fpr_low", "fpr_high"))


def fairness_spreads(spark, d):
    return rounded(FA.spreads(_bands(spark, d, "half"), "half"))


def common_bands(spark, d):
    return FA.common_bands(_bands(spark, d, "half"), "half")


# Simulation


def inflation_update(spark, d):
    df = SIM.inflate(credit(spark, d, INCOME, DEBT_RATIO).withColumn(INCOME_MISSING, income_missing()), 1.05)
    return rounded(df.groupBy("inflated").agg(F.count(F.lit(1)).alias("rows"), F.avg(c(INCOME)).alias("income"), F.avg(c(DEBT_RATIO)).alias("debt_ratio")))


def stress_flip(spark, d):
    df = credit(spark, d, TARGET, UTILIZATION).select("row_id", c(TARGET).alias(TARGET), (F.least(c(UTILIZATION), F.lit(1.0))).alias("u"))
    return SIM.stress_labels(df, "u", 0.5, 0.03, "flip").where("flipped = 1").select("row_id")


def _pool(spark, d):
    """Clean rows with normal scores of the five columns that weigh, and mid-rank utilisation."""
    df = written(clean(credit(spark, d)).na.fill({INCOME: 5000.0, DEBT_RATIO: 0.3}), "clean")
    names = {UTILIZATION: "util", AGE: "age", LATE30: "d30", LATE60: "d60", LATE90: "d90"}
    long = to_long(df, names, "row_id")
    z = normal_score(midrank_of_own(long, written(fit_ecdf(long.drop("row_id")), "ecdf"), "row_id"))
    wide = z.groupBy("row_id").pivot("feature", list(names)).agg(F.first("z").alias("z"), F.first("u").alias("u"))
    wide = wide.select("row_id", *[F.col(f"`{k}_z`").alias(f"z_{v}") for k, v in names.items()], F.col(f"`{UTILIZATION}_u`").alias("u_util"))
    return df.join(wide, "row_id")


_CFG = SIM.SimulationConfig(batch_rows=700, n_months=3, lag_60=1, lag_90=2)


def composition_month(spark, d):
    """How the weighted draw of the last month moves the mix against month 0."""
    pool = _pool(spark, d)
    months = SIM.draw_batch(pool, 0, _CFG).withColumn("month", F.lit(0)).unionByName(SIM.draw_batch(pool, 3, _CFG).withColumn("month", F.lit(3)))
    return rounded(months.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.avg("z_util").alias("z_util"), F.avg("z_age").alias("z_age"), F.avg((c(TARGET) == "1").cast("double")).alias("rate")))


def ablation_metrics(spark, d):
    """Pool, batches and scored rows are tables: a plan that holds those before it for each of its readers does not fit the driver."""
    drawn = written(SIM.draw_arms(written(_pool(spark, d), "pool"), _CFG), "drawn")
    out = SIM.simulate_drawn(drawn, _CFG)
    y = F.when(c(TARGET) == "1", 1).otherwise(0)
    scored = written(out.select("scenario", "month", y.alias("y"), (MO.stub_score(F.col("u_util")) * 0.12).alias("p"), "inflated", "flipped"), "scored")
    counts = scored.groupBy("scenario", "month").agg(F.sum("inflated").alias("inflated_rows"), F.sum("flipped").alias("label_flips"))
    return rounded(SIM.month_metrics(scored).join(counts, ["scenario", "month"]))


def _copula(spark, d):
    """A batch drawn by hash from all cleaned rows, as large as a month of the simulation."""
    df = SIM.draw_batch(clean(credit(spark, d)), 0, SIM.SimulationConfig()).select("row_id", "NumberRealEstateLoansOrLines", "NumberOfOpenCreditLinesAndLoans")
    df = df.checkpoint() if spark.sparkContext.getCheckpointDir() else df
    return df, *SIM.invert_dependence(df, "NumberOfOpenCreditLinesAndLoans", "NumberRealEstateLoansOrLines", "copula", steps=12)


def copula_inversion(spark, d):
    _, _, before, after = _copula(spark, d)
    return spark.createDataFrame([(before, after, abs(before + after) < 0.1)], "before double, after double, inverted boolean")


def marginals_preserved(spark, d):
    df, out, _, _ = _copula(spark, d)
    return SIM.multisets_match(df, out, ["NumberRealEstateLoansOrLines", "NumberOfOpenCreditLinesAndLoans"])


# Monitoring


def _drift(spark, d):
    """A made-up drift table: orders by priority (feature) and status (scenario), month (batch)."""
    o = read_table(spark, d, "orders").select(F.col("o_orderstatus").alias("scenario"), F.date_format("o_orderdate", "MM").alias("batch_id"), F.col("o_orderpriority").alias("feature"), "o_orderkey")
    return o.groupBy("scenario", "batch_id", "feature").agg((F.max("o_orderkey") % 400 / 1000.0).alias("psi"), (F.min("o_orderkey") % 30 / 100.0).alias("gain_share"))


def _batches(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_orderstatus").alias("scenario"), F.date_format("o_orderdate", "MM").alias("batch_id"), "o_orderkey")
    k = F.max("o_orderkey")
    return o.groupBy("scenario", "batch_id").agg(
        (k % 3 - 1).cast("int").alias("contract_stage"), (k % 2).cast("int").alias("sample_sufficient"), (k % 200 / 1000.0).alias("prediction_psi"), (-(k % 100) / 10000.0).alias("calibration_gap"), (0.80 + k % 80 / 1000.0).alias("auc"), (k % 4 == 0).cast("int").alias("pending")
    )


def alert_all(spark, d):
    return rounded(MON.alerts(_drift(spark, d), _batches(spark, d)))


def alert_feature_drift(spark, d):
    return rounded(MON.feature_drift(_drift(spark, d)))


def alert_feature_drift_critical(spark, d):
    return rounded(MON.feature_drift_critical(_drift(spark, d)))


def recorded_max(spark, d):
    drift = _drift(spark, d)
    weighted = drift.withColumn("psi_weighted", F.col("psi") * F.col("gain_share"))
    return rounded(MON.max_by_batch(drift, "psi").join(MON.max_by_batch(weighted, "psi_weighted"), ["scenario", "batch_id"]))


def drifted_counters(spark, d):
    return MON.drift_counters(_drift(spark, d))


def labels_pending(spark, d):
    return MON.labels_pending(_batches(spark, d))


def late_label_join(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "n_chars")
    labels = read_table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    out = MON.late_labels(docs, labels, "doc_id")
    return out.select("doc_id", "n_chars", "label", "pending")


def replay_steps(spark, d):
    m = read_table(spark, d, "orders").select(F.month("o_orderdate").alias("month"))
    return MON.replay_pairs(m, m).select("step", "month", MON.pending_flag(F.col("step"), 12).alias("labels_pending"))


def _months(spark, d):
    b = _batches(spark, d)
    return b.select("scenario", F.col("batch_id").cast("int").alias("month"), F.col("calibration_gap").alias("gap"), (F.col("prediction_psi") > 0.15).alias("alarm"))


def blind_window(spark, d):
    return MON.blind_windows(_months(spark, d)).withColumn("degraded_months", F.concat_ws(",", F.transform("degraded_months", lambda x: x.cast("string")))).withColumn("blind_months", F.concat_ws(",", F.transform("blind_months", lambda x: x.cast("string"))))


def mechanism_decision(spark, d):
    b = _batches(spark, d)
    return b.select("scenario", "batch_id", MON.mechanism(F.col("prediction_psi") > 0.1, F.col("calibration_gap") <= MON.GAP_MAX, F.col("contract_stage") != 0, F.when(F.col("sample_sufficient") == 1, 5000).otherwise(10)).alias("mechanism"))


def metric_samples(spark, d):
    rows = _batches(spark, d).withColumn("job", F.lit("scoring"))
    m = MON.to_metrics(rows, {"auc": F.when(F.col("pending") == 0, F.col("auc")), "prediction_psi": F.col("prediction_psi")}, ["pending"])
    return rounded(MON.samples_text(m).select("sample", "scenario", "batch_id", "value"))


def metric_selector(spark, d):
    rows = _batches(spark, d).withColumn("job", F.lit("scoring"))
    m = MON.to_metrics(rows, {"auc": F.col("auc"), "stage": F.col("contract_stage").cast("double")})
    return rounded(MON.select(m, "auc", batch_id="~0[1-3]").select("scenario", "batch_id", "value"))


def metric_replace_group(spark, d):
    rows = _batches(spark, d).withColumn("job", F.lit("scoring"))
    m = MON.to_metrics(rows, {"auc": F.col("auc")}).drop("labels")
    new = m.where("batch_id = '01'").withColumn("value", F.lit(1.0))
    return rounded(MON.replace_group(m, new, "job", "scenario", "batch_id"))


def dashboard_codes(spark, d):
    b = _batches(spark, d)
    return b.select("scenario", "batch_id", MON.code_text(F.col("contract_stage"), MON.STAGE_TEXT).alias("stage"), MON.code_text(F.col("contract_stage") - 1, MON.VERDICT_TEXT).alias("verdict"))


def last_gauge(spark, d):
    """The last value per user and event type."""
    e = read_table(spark, d, "events").select(F.lit("j").alias("job"), F.col("user_id").cast("string").alias("scenario"), F.col("event_type").alias("batch_id"), F.lit("v").alias("metric"), F.create_map(F.lit("k"), F.lit("x")).alias("labels"), "value", F.struct("ts", "event_id").alias("at"))
    return rounded(MON.last_values(e, "at").select("scenario", "batch_id", "value"))


def log_redaction_hash(spark, d):
    return read_table(spark, d, "events").where("event_type = 'error'").select("event_id", salted_id(F.col("user_id"), "pepper").alias("user"))


def report_publish_diff(spark, d):
    p = read_table(spark, d, "pages").select(F.col("page_id").alias("name"), "url")
    run = F.md5(F.col("name").cast("string"))
    old = p.select("name", F.concat("url", F.lit(" run "), run).alias("text"))
    new = p.select("name", F.concat(F.when(F.col("name") % 7 == 0, F.concat("url", F.lit("#"))).otherwise(F.col("url")), F.lit(" run "), F.md5(run)).alias("text"))
    return sinks.content_changed(old, new)


def join_set_operations(spark, d):
    """Keys of orders with and without line items, and the label sets both sides share."""
    o, li = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    n = lambda df, name: df.select(F.lit(name).alias("set"), "k").groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    return n(o.join(li.distinct(), "k", "left_semi"), "semi").unionByName(n(o.join(li, "k", "left_anti"), "anti")).unionByName(n(o.intersect(li), "intersect")).unionByName(n(li.exceptAll(o), "except_all"))


def model_calibration(spark, d):
    """Both candidates trained, calibrated and measured on three parts."""
    ready = clean(credit(spark, d))
    split = stratified_split(ready.withColumn("y0", c(TARGET)), "y0", {"train": 0.6, "calibration": 0.2, "validation": 0.2}, "model", "row_id").drop("y0")
    fit = fit_imputation(split.where("split = 'train'"))
    split = split.persist()
    part = {s: MO.assemble(feature_matrix(impute(split.where(F.col("split") == s).drop("split"), fit))).persist() for s in ("train", "calibration", "validation")}
    out = None
    for name, model in MO.fit_candidates(part["train"], trees=8).items():
        scored = MO.calibrated(model, MO.calibrate(model, part["calibration"]), part["validation"]).select("y", "p")
        row = M.batch_metrics(scored).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


_SCORED = f"""{WITH_CREDIT}, s AS (SELECT row_id, age, month(o_orderdate)::INT AS month, CASE WHEN "{TARGET}" = '1' THEN 1 ELSE 0 END AS y, 0.12::DOUBLE / (1 + exp(-(4 * (floor(least("{UTILIZATION}", 1.0::DOUBLE) * 200) / 200) - 2))) AS p FROM credit JOIN orders ON row_id = o_orderkey)"""


def _rank_sql(by: str, source: str = "s") -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {b}sum(neg * (tp - pos) + 0.5::DOUBLE * neg * pos) / (max(pa)::DOUBLE * max(na)) AS auc, max(gap) AS ks, max(p) FILTER (gap = mg) AS ks_threshold FROM (
      SELECT *, max(gap) OVER ({part}) AS mg FROM (SELECT *, tp::DOUBLE / pa - fp::DOUBLE / na AS gap FROM (
        SELECT {b}p, pos, neg, sum(pos) OVER ({part} ORDER BY p DESC) AS tp, sum(neg) OVER ({part} ORDER BY p DESC) AS fp, sum(pos) OVER ({part}) AS pa, sum(neg) OVER ({part}) AS na FROM (
          SELECT {b}p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {source} GROUP BY ALL)))) {f"GROUP BY {by}" if by else ""}"""


_RUNS = f"{_SCORED}, t AS (SELECT 'stub' AS model, (row_id % 5)::INT AS seed, y, p FROM s UNION ALL SELECT 'age', (row_id % 5)::INT, y, age / 200.0::DOUBLE FROM s), runs AS ({_rank_sql('model, seed', 't')})"
_W = "{k}::DOUBLE / {n} + 0"


def _wil(k: str, n: str) -> tuple[str, str]:
    p = f"({k}::DOUBLE / {n})"
    z = f"({Z95!r})::DOUBLE"
    centre, den = f"({p} + {z} * {z} / (2.0::DOUBLE * {n}))", f"(1 + {z} * {z} / {n})"
    half = f"({z} / {den} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0::DOUBLE * {n} * {n})))"
    return f"CASE WHEN {n} > 0 THEN greatest(0, least({centre} / {den} - {half}, {p})) END", f"CASE WHEN {n} > 0 THEN least(1, greatest({centre} / {den} + {half}, {p})) END"


def _bands_sql(by: str = "") -> str:
    b = f"{by}, " if by else ""
    band = "CASE " + " ".join(f"WHEN age BETWEEN {lo} AND {hi} THEN '{n}'" for n, lo, hi in FA.BANDS) + " END"
    rates = {"approval": ("approved", "n"), "tpr": ("tp", "pos"), "fpr": ("fp", "neg"), "precision": ("tp", "flagged")}
    cols = []
    for name, (k, n) in rates.items():
        lo, hi = _wil(k, n)
        cols += [f"CASE WHEN {n} > 0 THEN {k}::DOUBLE / {n} END AS {name}_rate", f"{lo} AS {name}_low", f"{hi} AS {name}_high"]
    lo, hi = _wil("pos", "n")
    return f"""{_SCORED}, b0 AS (SELECT {b}band, count(*) AS n, sum(y) AS pos, count(*) FILTER (p < 0.06) AS approved, count(*) FILTER (y = 1 AND p >= 0.06) AS tp, count(*) FILTER (y = 0 AND p >= 0.06) AS fp, avg(p) AS mean_predicted
      FROM (SELECT *, {band} AS band, CASE WHEN month <= 6 THEN 'first' ELSE 'second' END AS half FROM s) WHERE band IS NOT NULL GROUP BY ALL),
    b1 AS (SELECT *, n - pos AS neg, tp + fp AS flagged FROM b0),
    bands AS (SELECT *, pos::DOUBLE / n AS base_rate, mean_predicted - pos::DOUBLE / n AS calibration_gap, {", ".join(cols)}, mean_predicted - ({hi}) AS gap_low, mean_predicted - ({lo}) AS gap_high, pos AS tpr_n, neg AS fpr_n, flagged AS precision_n, pos >= 100 AS comparable FROM b1)"""


_BAND_D = "mean_predicted, base_rate, calibration_gap, approval_rate, approval_low, approval_high, tpr_rate, tpr_low, tpr_high, fpr_rate, fpr_low, fpr_high, precision_rate, precision_low, precision_high, gap_low, gap_high"
_BAND_P = "band, n, pos::BIGINT AS pos, approved, tp, fp, tpr_n::BIGINT AS tpr_n, fpr_n::BIGINT AS fpr_n, precision_n, comparable"
_DRIFT = "d AS (SELECT o_orderstatus AS scenario, strftime(o_orderdate, '%m') AS batch_id, o_orderpriority AS feature, max(o_orderkey) % 400 / 1000.0::DOUBLE AS psi, min(o_orderkey) % 30 / 100.0::DOUBLE AS gain_share FROM orders GROUP BY ALL)"
_BATCH = "b AS (SELECT *, (k % 3 - 1)::INT AS contract_stage, (k % 2)::INT AS sample_sufficient, k % 200 / 1000.0::DOUBLE AS prediction_psi, -(k % 100) / 10000.0::DOUBLE AS calibration_gap, 0.80::DOUBLE + k % 80 / 1000.0::DOUBLE AS auc, (k % 4 = 0)::INT AS pending FROM (SELECT o_orderstatus AS scenario, strftime(o_orderdate, '%m') AS batch_id, max(o_orderkey) AS k FROM orders GROUP BY ALL))"
_CRIT = "crit AS (SELECT * FROM d WHERE psi > 0.25 AND gain_share >= 0.1)"
_WARN = "warn AS (SELECT * FROM d WHERE psi > 0.1 AND NOT (psi > 0.25 AND gain_share >= 0.1))"
_A = "SELECT '{}' AS alert, '{}' AS severity, scenario, {} AS batch_id, {}::VARCHAR AS feature, ({})::DOUBLE AS value FROM {}"
_ALERTS = " UNION ALL ".join(_A.format(*x) for x in (
    ("ContractBlocked", "critical", "batch_id", "NULL", "contract_stage", "b WHERE contract_stage = 0"), ("InsufficientSample", "info", "batch_id", "NULL", "sample_sufficient", "b WHERE sample_sufficient = 0"),
    ("FeatureDrift", "warning", "batch_id", "feature", "psi", "warn"), ("FeatureDriftCritical", "critical", "batch_id", "feature", "psi", "crit"), ("PredictionDrift", "warning", "batch_id", "NULL", "prediction_psi", "b WHERE prediction_psi > 0.1"),
    ("CalibrationGapBreach", "critical", "batch_id", "NULL", "calibration_gap", "b WHERE calibration_gap <= -0.0056"), ("AUCDrop", "warning", "batch_id", "NULL", "auc", "b WHERE auc <= 0.8372"),
    ("LabelsPending", "info", "NULL::VARCHAR", "NULL", "n", "(SELECT scenario, sum(pending) AS n FROM b GROUP BY scenario) WHERE n > 0"),
))
_MONTHS = f"WITH {_BATCH}, m AS (SELECT scenario, batch_id::INT AS month, calibration_gap <= -0.0056 AS bad, prediction_psi > 0.15 AS alarm FROM b), f AS (SELECT *, min(month) FILTER (bad) OVER (PARTITION BY scenario) AS fd FROM m)"
_STRESS = f"""{WITH_CREDIT}, t AS (SELECT row_id, "{TARGET}" AS y, least("{UTILIZATION}", 1.0::DOUBLE) AS u FROM credit), k AS (SELECT CASE WHEN sum(CASE WHEN y = '0' THEN u END) > 0 THEN 0.03::DOUBLE * count(*) / sum(CASE WHEN y = '0' THEN u END) ELSE 0 END AS c FROM t)"""

QUERIES = {
    f.__name__: f
    for f in (
        auc_roc, ks_separation, monthly_metrics, champion, seed_noise, seed_paired_delta, band_metrics, wilson_bands, fairness_spreads, common_bands, inflation_update, stress_flip, composition_month, ablation_metrics, copula_inversion, marginals_preserved,
        alert_all, alert_feature_drift, alert_feature_drift_critical, recorded_max, drifted_counters, labels_pending, late_label_join, replay_steps, blind_window, mechanism_decision, metric_samples, metric_selector, metric_replace_group, dashboard_codes, last_gauge,
        log_redaction_hash, report_publish_diff, join_set_operations, model_calibration,
    )
}
SQL = {
    "auc_roc": rsql(_rank_sql(""), "", "auc, ks, ks_threshold", head=_SCORED),
    "ks_separation": rsql(_rank_sql("month"), "month", "ks, ks_threshold", head=_SCORED),
    "monthly_metrics": rsql(f"SELECT * FROM (SELECT month, count(*) AS rows, avg(y) AS observed_rate, avg(p) AS mean_predicted, avg(p) - avg(y) AS calibration_gap, avg((p - y) * (p - y)) AS brier FROM s GROUP BY month) JOIN ({_rank_sql('month')}) USING (month)", "month, rows", "observed_rate, mean_predicted, calibration_gap, brier, auc, ks, ks_threshold", head=_SCORED),
    "champion": rsql("SELECT model, avg(auc) AS auc FROM runs GROUP BY model ORDER BY 2 DESC, 1 LIMIT 1", "model", "auc", head=_RUNS),
    "seed_noise": rsql("SELECT model, avg(auc) AS mean, stddev_samp(auc) AS sd, max(auc) - min(auc) AS range FROM runs GROUP BY model", "model", "mean, sd, range", head=_RUNS),
    "seed_paired_delta": rsql("SELECT avg(a.auc - b.auc) AS mean_delta, count(*) FILTER (a.auc > b.auc) AS wins, count(*) AS seeds FROM runs a JOIN runs b USING (seed) WHERE a.model = 'stub' AND b.model = 'age'", "wins, seeds", "mean_delta", head=_RUNS),
    "band_metrics": rsql("SELECT * FROM bands", _BAND_P, _BAND_D, head=_bands_sql()),
    "wilson_bands": rsql("SELECT * FROM bands", "half, band, n", "approval_low, approval_high, tpr_low, tpr_high, fpr_low, fpr_high", head=_bands_sql("half")),
    "fairness_spreads": rsql("SELECT half, max(approval_rate) - min(approval_rate) AS demographic_parity, greatest(max(tpr_rate) - min(tpr_rate), max(fpr_rate) - min(fpr_rate)) AS equalized_odds, max(calibration_gap) - min(calibration_gap) AS calibration_spread, max(base_rate) - min(base_rate) AS base_rate_spread, count(*) AS bands FROM bands WHERE comparable GROUP BY half", "half, bands", "demographic_parity, equalized_odds, calibration_spread, base_rate_spread", head=_bands_sql("half")),
    "common_bands": _bands_sql("half") + " SELECT band, CAST(row_number() OVER (ORDER BY band) AS INTEGER) AS position FROM (SELECT band FROM bands WHERE comparable GROUP BY band HAVING count(DISTINCT half) = (SELECT count(DISTINCT half) FROM bands))",
    "inflation_update": rsql(f"""SELECT CASE WHEN "{INCOME}" IS NULL OR "{INCOME}" = 0 THEN 0 ELSE 1 END AS inflated, count(*) AS rows, avg(CASE WHEN "{INCOME}" > 0 THEN "{INCOME}" * 1.05::DOUBLE ELSE "{INCOME}" END) AS income, avg(CASE WHEN "{INCOME}" > 0 THEN "{DEBT_RATIO}" / 1.05::DOUBLE ELSE "{DEBT_RATIO}" END) AS debt_ratio FROM credit GROUP BY 1""", "inflated, rows", "income, debt_ratio", head=WITH_CREDIT),
    "stress_flip": f"{_STRESS} SELECT row_id FROM t, k WHERE y = '0' AND {_U.format(seed='flip', key='row_id')} < greatest(0, least(1, c * 0.5::DOUBLE * u))",
    "marginals_preserved": """SELECT * FROM (VALUES ('NumberRealEstateLoansOrLines', true), ('NumberOfOpenCreditLinesAndLoans', true)) AS t("column", equal)""",
    "alert_all": rsql(_ALERTS, "alert, severity, scenario, batch_id, feature", "value", head=f"WITH {_DRIFT}, {_BATCH}, {_CRIT}, {_WARN}"),
    "alert_feature_drift": rsql("SELECT * FROM warn", "scenario, batch_id, feature", "psi", head=f"WITH {_DRIFT}, {_WARN}"),
    "alert_feature_drift_critical": rsql("SELECT * FROM crit", "scenario, batch_id, feature", "psi", head=f"WITH {_DRIFT}, {_CRIT}"),
    "recorded_max": rsql("SELECT scenario, batch_id, max(psi) AS psi, max(psi * gain_share) AS psi_weighted FROM d GROUP BY ALL", "scenario, batch_id", "psi, psi_weighted", head=f"WITH {_DRIFT}"),
    "drifted_counters": f"WITH {_DRIFT} SELECT scenario, batch_id, count(*) FILTER (psi >= 0.1 AND psi < 0.25) AS drifted_warning, count(*) FILTER (psi >= 0.25) AS drifted_critical FROM d GROUP BY ALL",
    "labels_pending": f"WITH {_BATCH} SELECT scenario, CAST(sum(pending) AS BIGINT) AS labels_pending FROM b GROUP BY scenario",
    "late_label_join": "SELECT d.doc_id, n_chars, quality AS label, (quality IS NULL)::INT AS pending FROM documents d LEFT JOIN labels USING (doc_id)",
    "replay_steps": "WITH m AS (SELECT DISTINCT month(o_orderdate)::INT AS month FROM orders) SELECT s.month AS step, a.month, (s.month + 2 > 12)::INT AS labels_pending FROM m s JOIN m a ON a.month + 2 = s.month",
    "blind_window": f"""{_MONTHS} SELECT scenario, coalesce(array_to_string(list_sort(list(month) FILTER (bad)), ','), '') AS degraded_months, coalesce(array_to_string(list_sort(list(month) FILTER (bad AND NOT alarm AND NOT fd <= month - 2)), ','), '') AS blind_months,
      min(month) FILTER (bad) AS first_degraded_month, min(month) FILTER (alarm) AS first_drift_alarm_month, least(min(month) FILTER (bad) + 2, min(month) FILTER (alarm)) AS first_signal_month,
      CASE WHEN min(month) FILTER (bad) IS NOT NULL THEN min(month) FILTER (bad) - least(min(month) FILTER (bad) + 2, min(month) FILTER (alarm)) END AS lead_time_months FROM f GROUP BY scenario""",
    "mechanism_decision": f"""WITH {_BATCH} SELECT scenario, batch_id, CASE WHEN contract_stage = 0 THEN 'data quality: fix the feed before reading anything else' WHEN sample_sufficient = 0 THEN 'sample too small to tell'
      WHEN prediction_psi > 0.1 AND NOT calibration_gap <= -0.0056 THEN 'composition: the mix moved, the model still holds' WHEN prediction_psi > 0.1 THEN 'composition and relation: retrain and review' WHEN calibration_gap <= -0.0056 THEN 'relation: labels moved under unchanged features' ELSE 'stable' END AS mechanism FROM b""",
    "metric_samples": rsql("""SELECT 'auc{pending="' || pending || '"}' AS sample, scenario, batch_id, auc AS value FROM b WHERE pending = 0 UNION ALL SELECT 'prediction_psi{pending="' || pending || '"}', scenario, batch_id, prediction_psi FROM b""", "sample, scenario, batch_id", "value", head=f"WITH {_BATCH}"),
    "metric_selector": rsql("SELECT scenario, batch_id, auc AS value FROM b WHERE regexp_full_match(batch_id, '0[1-3]')", "scenario, batch_id", "value", head=f"WITH {_BATCH}"),
    "metric_replace_group": rsql("SELECT 'scoring' AS job, scenario, batch_id, 'auc' AS metric, CASE WHEN batch_id = '01' THEN 1.0::DOUBLE ELSE auc END AS value FROM b", "job, scenario, batch_id, metric", "value", head=f"WITH {_BATCH}"),
    "dashboard_codes": f"WITH {_BATCH} SELECT scenario, batch_id, CASE contract_stage WHEN -1 THEN 'skipped' WHEN 0 THEN 'failed' WHEN 1 THEN 'ok' ELSE 'unknown' END AS stage, CASE contract_stage - 1 WHEN -2 THEN 'blocked' WHEN -1 THEN 'insufficient sample' WHEN 0 THEN 'ok' WHEN 1 THEN 'warning' WHEN 2 THEN 'critical' ELSE 'unknown' END AS verdict FROM b",
    "last_gauge": rsql("SELECT user_id::VARCHAR AS scenario, event_type AS batch_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL", "scenario, batch_id", "value"),
    "log_redaction_hash": "SELECT event_id, substr(sha256('pepper:' || user_id), 1, 16) AS \"user\" FROM events WHERE event_type = 'error'",
    "report_publish_diff": "SELECT page_id AS name, page_id % 7 = 0 AS changed FROM pages",
    "join_set_operations": """SELECT 'semi' AS "set", count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'anti', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
      UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'except_all', count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)""",
}
