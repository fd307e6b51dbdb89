"""The monitoring layer: metric rows, alert rules, label lag, blind windows, decisions.

A metric table is long: (job, scenario, batch_id, metric, labels map, value). It holds the last value per
key and no time axis; a value that was not measured has no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rules.
PSI_WARN, PSI_ALERT, GAIN_MIN = 0.10, 0.25, 0.10
GAP_MAX, AUC_MIN = -0.0056, 0.8372
LABEL_LAG = 2


@dataclass(frozen=True)
class Thresholds:
    """What batches are judged by; a settings file has to name every one."""

    psi_warn: float = PSI_WARN
    psi_alert: float = PSI_ALERT
    gain_min: float = GAIN_MIN
    gap_max: float = GAP_MAX
    auc_min: float = AUC_MIN
    label_lag: int = LABEL_LAG
    min_rows: int = 1000


VERDICT_TEXT = {-2: "blocked", -1: "insufficient sample", 0: "ok", 1: "warning", 2: "critical"}
STAGE_TEXT = {-1: "skipped", 0: "failed", 1: "ok"}


def code_text(code: Column, texts: dict[int, str]) -> Column:
    out = F.lit("unknown")
    for k, v in texts.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def to_metrics(df: DataFrame, metrics: dict[str, Column], labels: list[str] | None = None) -> DataFrame:
    """Unpivots columns of (job, scenario, batch_id, ...) into metric rows; nulls are dropped."""
    made = F.map_from_arrays(F.array(*[F.lit(x) for x in labels or []]), F.array(*[F.col(x).cast("string") for x in labels or []])) if labels else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), e.cast("double").alias("value")) for n, e in metrics.items()])
    return df.select("job", "scenario", "batch_id", made.alias("labels"), F.inline(rows)).where("value IS NOT NULL").select("job", "scenario", "batch_id", "metric", "labels", "value")


def samples_text(metrics: DataFrame) -> DataFrame:
    """(sample, value) with sample as name{label="value",...}, labels sorted."""
    pairs = F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))))
    return metrics.select(F.concat("metric", F.lit("{"), F.concat_ws(",", pairs), F.lit("}")).alias("sample"), "job", "scenario", "batch_id", "value")


def select(metrics: DataFrame, metric: str, **equal: str) -> DataFrame:
    """An instant selector: equality on columns or labels; a value that starts with ~ is a regular
    expression that must match as a whole."""
    out = metrics.where(F.col("metric") == metric)
    for k, v in equal.items():
        col = F.col(k) if k in metrics.columns else F.col("labels")[k]
        out = out.where(col.rlike(f"^(?:{v[1:]})$") if v.startswith("~") else col == v)
    return out


def last_values(history: DataFrame, order: str) -> DataFrame:
    """The gauge: the latest value of each key by ``order``."""
    key = ["job", "scenario", "batch_id", "metric", F.to_json("labels").alias("_l")]
    return history.groupBy(*key).agg(F.max_by(F.struct("labels", "value"), order).alias("x")).select("job", "scenario", "batch_id", "metric", "x.labels", "x.value")


def replace_group(table: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Delete before push: groups in ``new`` lose all their old rows, others stay."""
    return table.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


# Recording rules and alerts. Drift rows: (scenario, batch_id, feature, psi, gain_share).


def max_by_batch(drift: DataFrame, value: str) -> DataFrame:
    return drift.groupBy("scenario", "batch_id").agg(F.max(value).alias(value))


def labels_pending(pending: DataFrame) -> DataFrame:
    return pending.groupBy("scenario").agg(F.sum("pending").alias("labels_pending"))


def _critical(drift: DataFrame) -> DataFrame:
    """Large drift, kept where a gain of at least 0.10 exists for the same feature and batch."""
    on = ["feature", "scenario", "batch_id"]
    weighty = drift.where(F.col("gain_share") >= GAIN_MIN).select(*on)
    return drift.where(F.col("psi") > PSI_ALERT).join(weighty, on, "left_semi")


def feature_drift_critical(drift: DataFrame) -> DataFrame:
    return _critical(drift).select("scenario", "batch_id", "feature", "psi")


def feature_drift(drift: DataFrame) -> DataFrame:
    """Drift above the warning line unless the critical rule fires for the same series."""
    return drift.where(F.col("psi") > PSI_WARN).join(_critical(drift).select("feature", "scenario", "batch_id"), ["feature", "scenario", "batch_id"], "left_anti").select("scenario", "batch_id", "feature", "psi")


def alerts(drift: DataFrame, batches: DataFrame) -> DataFrame:
    """(alert, severity, scenario, batch_id, feature, value) of all rules.

    ``batches``: scenario, batch_id, contract_stage (-1 / 0 / 1), sample_sufficient, prediction_psi,
    calibration_gap, auc, pending; null where not measured.
    """

    def fire(name: str, severity: str, df: DataFrame, value: Column, batch: Column | None = None, feature: Column | None = None) -> DataFrame:
        return df.select(F.lit(name).alias("alert"), F.lit(severity).alias("severity"), "scenario", (F.col("batch_id") if batch is None else batch).alias("batch_id"), (F.lit(None) if feature is None else feature).cast("string").alias("feature"), value.cast("double").alias("value"))

    b, col = batches, F.col
    parts = [
        fire("ContractBlocked", "critical", b.where("contract_stage = 0"), col("contract_stage")),
        fire("InsufficientSample", "info", b.where("sample_sufficient = 0"), col("sample_sufficient")),
        fire("FeatureDrift", "warning", feature_drift(drift), col("psi"), feature=col("feature")),
        fire("FeatureDriftCritical", "critical", feature_drift_critical(drift), col("psi"), feature=col("feature")),
        fire("PredictionDrift", "warning", b.where(col("prediction_psi") > PSI_WARN), col("prediction_psi")),
        fire("CalibrationGapBreach", "critical", b.where(col("calibration_gap") <= GAP_MAX), col("calibration_gap")),
        fire("AUCDrop", "warning", b.where(col("auc") <= AUC_MIN), col("auc")),
        fire("LabelsPending", "info", labels_pending(b).where("labels_pending > 0"), col("labels_pending"), batch=F.lit(None).cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Labels that come later


def late_labels(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Predictions as recorded, with the label where it has come, and ``pending`` where it has not."""
    return predictions.join(labels, key, "left").withColumn("pending", F.col("label").isNull().cast("int"))


def replay_pairs(scored: DataFrame, arrived: DataFrame, lag: int = LABEL_LAG) -> DataFrame:
    """(step, month): at each scoring step the labels of month step - lag arrive."""
    return scored.select(F.col("month").alias("step")).distinct().join(arrived.select("month").distinct(), F.col("month") + lag == F.col("step"))


def pending_flag(step: Column, n_months: int, lag: int = LABEL_LAG) -> Column:
    return (step + lag > n_months).cast("int")


def blind_windows(months: DataFrame, lag: int = LABEL_LAG, threshold: float = GAP_MAX) -> DataFrame:
    """``months``: (scenario, month, gap, alarm). Per scenario:

    degraded months have gap <= threshold; one is blind if it has no alarm and no degraded month lies
    ``lag`` or more before it. first_signal is the earlier of first_degraded + lag and the first alarm of
    any month; lead_time = first_degraded - first_signal, null if nothing ever degrades.
    """
    one = Window.partitionBy("scenario")
    bad = F.coalesce(F.col("gap") <= threshold, F.lit(False))
    m = months.withColumn("_bad", bad).withColumn("_first", F.min(F.when(bad, F.col("month"))).over(one))
    blind = F.col("_bad") & ~F.coalesce(F.col("alarm"), F.lit(False)) & ~(F.col("_first") <= F.col("month") - lag)
    ints = lambda c: F.array_sort(F.array_agg(F.when(c, F.col("month"))))
    out = m.groupBy("scenario").agg(
        ints(F.col("_bad")).alias("degraded_months"), ints(blind).alias("blind_months"), F.min(F.when(F.col("_bad"), F.col("month"))).alias("first_degraded_month"), F.min(F.when(F.coalesce(F.col("alarm"), F.lit(False)), F.col("month"))).alias("first_drift_alarm_month")
    )
    signal = F.least(F.col("first_degraded_month") + lag, F.col("first_drift_alarm_month"))  # least skips nulls
    return out.withColumn("first_signal_month", signal).withColumn("lead_time_months", F.when(F.col("first_degraded_month").isNotNull(), F.col("first_degraded_month") - signal))


def stage_codes(contract_blocked: Column, rows: Column, min_rows: int = 1000) -> tuple[Column, Column, Column]:
    """(contract, drift, verdict): a blocked batch skips drift and has verdict -2, a small one is -1."""
    contract = F.when(contract_blocked, 0).otherwise(1)
    drift = F.when(contract_blocked, -1).otherwise(1)
    return contract, drift, F.when(contract_blocked, -2).when(rows < min_rows, -1)


def mechanism(drift: Column, gap: Column, contract_ok: Column, rows: Column, min_rows: int = 1000) -> Column:
    """What the signature of a batch points to; the first row that fits decides."""
    return (
        F.when(~contract_ok, "data quality: fix the feed before reading anything else")
        .when(rows < min_rows, "sample too small to tell")
        .when(drift & ~gap, "composition: the mix moved, the model still holds")
        .when(drift & gap, "composition and relation: retrain and review")
        .when(~drift & gap, "relation: labels moved under unchanged features")
        .otherwise("stable")
    )


def drift_counters(drift: DataFrame) -> DataFrame:
    """Per batch: features in the warning band, features at or above the alert line."""
    p = F.col("psi")
    return drift.groupBy("scenario", "batch_id").agg(F.count_if((p >= PSI_WARN) & (p < PSI_ALERT)).cast("long").alias("drifted_warning"), F.count_if(p >= PSI_ALERT).cast("long").alias("drifted_critical"))


def judged(batches: DataFrame, limits: DataFrame) -> DataFrame:
    """(scenario, batch_id, rows, psi, gap) with ``verdict`` and ``degraded`` by the one row of ``limits`` (``Thresholds`` as a table)."""
    x = batches.crossJoin(F.broadcast(limits))  # one row
    verdict = F.when(F.col("rows") < F.col("min_rows"), "insufficient").when(F.col("psi") >= F.col("psi_alert"), "critical").when(F.col("psi") >= F.col("psi_warn"), "warning").otherwise("ok")
    return x.select(*batches.columns, verdict.alias("verdict"), (F.col("gap") <= F.col("gap_max")).alias("degraded"))


#: The gauges that a scoring run publishes for a batch, and those that labels bring.
SCORING_GAUGES = ("rows_in", "rows_quarantined", "batch_size", "sample_sufficient", "drift_verdict", "last_success_timestamp_seconds", "labels_pending", "prediction_mean", "prediction_psi")
LABEL_GAUGES = ("auc", "brier", "calibration_gap", "observed_default_rate", "label_lag_months")
_GROUP = ("scenario", "batch_id")


def scoring_gauges(batches: DataFrame, features: DataFrame, violations: DataFrame, stages: DataFrame, job: str = "credit_monitor_scoring") -> DataFrame:
    """All metric rows of scoring runs. ``batches``: the gauges above and drifted_warning, drifted_critical; ``features``: feature, psi,
    gain_share; ``violations``: rule, severity, rows; ``stages``: stage, seconds, status; all by scenario and batch. A null is absent, not zero."""
    at = lambda df: df.withColumn("job", F.lit(job))
    level = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(f"drifted_{n}").alias("count")) for n in ("warning", "critical")]))
    both = F.col("drifted_warning").isNotNull() & F.col("drifted_critical").isNotNull()
    drifted = batches.where(both).select(*_GROUP, level.alias("x")).select(*_GROUP, "x.level", "x.count")
    parts = [
        to_metrics(at(batches), {n: F.col(n) for n in SCORING_GAUGES}),
        to_metrics(at(features), {"drift_psi": F.col("psi"), "drift_psi_weighted": F.col("psi") * F.col("gain_share"), "feature_gain_share": F.col("gain_share")}, ["feature"]),
        to_metrics(at(drifted), {"drifted_features": F.col("count")}, ["level"]),
        to_metrics(at(violations), {"contract_violations": F.col("rows")}, ["rule", "severity"]),
        to_metrics(at(stages), {"stage_duration_seconds": F.col("seconds"), "stage_status": F.col("status")}, ["stage"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def label_gauges(labelled: DataFrame, job: str = "credit_monitor_labels") -> DataFrame:
    """The five gauges of a batch whose labels have come."""
    return to_metrics(labelled.withColumn("job", F.lit(job)), {n: F.col(n) for n in LABEL_GAUGES})


def drilldown(metrics: DataFrame, logs: DataFrame, scenario: str, batch_id: str) -> DataFrame:
    """``panel, name, value, line`` of one batch: its plain gauges, its index by feature, and its log lines (``scenario, batch_id, ts, line``)."""
    own = metrics.where((F.col("scenario") == scenario) & (F.col("batch_id") == batch_id))
    text = F.lit(None).cast("string").alias("line")
    plain = own.where(F.size("labels") == 0).select(F.lit("gauge").alias("panel"), F.col("metric").alias("name"), "value", text)
    index = own.where("metric = 'drift_psi'").select(F.lit("drift_psi").alias("panel"), F.col("labels")["feature"].alias("name"), "value", text)
    lines = logs.where((F.col("scenario") == scenario) & (F.col("batch_id") == batch_id)).select(F.lit("log").alias("panel"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("name"), F.lit(None).cast("double").alias("value"), "line")
    return plain.unionByName(index).unionByName(lines)
