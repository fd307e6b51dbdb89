"""Run tables, kept batches, gauges and report tables on small frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gaugemill.operators import mmd, monitor, reports, rules
from gaugemill.operators.clean import clean, fit_imputation, prepare_split
from gaugemill.sources import runs, sinks, tables
from gaugemill.sources.tables import TARGET, credit


def test_runs_keep_what_was_measured(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path), "monitoring")
    rows = spark.createDataFrame([("full", "m1", 10, 0.8, None, "ok"), ("full", "m2", 20, 0.9, 0.1, None)], "scenario string, batch_id string, size int, auc double, psi double, verdict string")
    name = F.concat_ws("/", "scenario", "batch_id")
    record = lambda r: log.record(r, name, ["batch_id", "size"], ["auc", "psi"], ["verdict"])
    record(rows)
    record(rows.where("batch_id = 'm1'").withColumn("auc", F.lit(0.95)))  # the same run again replaces itself
    assert sorted((r.name, r.params, r.tags) for r in log.runs().collect()) == [("full/m1", {"batch_id": "m1", "size": "10"}, {"verdict": "ok"}), ("full/m2", {"batch_id": "m2", "size": "20"}, {})]
    assert sorted((r.metric, r.value) for r in log.measured().collect()) == [("auc", 0.9), ("auc", 0.95), ("psi", 0.1)]
    assert [(r.name, r.value) for r in log.best("auc").collect()] == [("full/m1", 0.95)] and log.best("none").count() == 0
    other = runs.RunLog(spark, str(tmp_path), "training")
    other.record(rows.limit(1), F.lit("x"), ["size"], ["auc"])
    assert other.runs().count() == 1 and log.runs().count() == 2


def test_summary_and_wiped_groups(spark, tmp_path):
    runs.write_summary(spark, {"auc": 0.5, "models": ["a"]}, f"{tmp_path}/s")
    assert runs.read_summary(spark, f"{tmp_path}/s") == {"auc": 0.5, "models": ["a"]}
    m = spark.createDataFrame([("a", "s", "1", "x", 1.0), ("b", "s", "1", "x", 1.0)], "job string, scenario string, batch_id string, metric string, value double")
    sinks.write_metric_groups(m, f"{tmp_path}/m")
    assert runs.wipe_groups(spark, f"{tmp_path}/m") == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        runs.wipe_groups(spark, f"{tmp_path}/m")


def test_demo_batches_are_made_once(spark, sf_dir, tmp_path):
    df = credit(spark, sf_dir)
    base = runs.clean_base(df, 60)
    got = rules.rule_counts(rules.failures(spark.createDataFrame(base.collect(), df.schema), rules.RAW)).where("rule <> 'positive_rate_band'")
    assert got.count() == 0 and sorted(r.row_id for r in base.collect()) == list(range(60))
    name, made = runs.ensure_dirty_batch(df, str(tmp_path), "20240101", 60)
    assert (name, made) == ("batch_20240101", True) and runs.ensure_dirty_batch(df, str(tmp_path), "20250101", 60) == ("batch_20240101", False)
    told = runs.read_summary(spark, f"{tmp_path}/{name}.manifest")
    batch = spark.read.parquet(f"{tmp_path}/{name}.parquet")
    counted = {r.rule: r.rows for r in rules.rule_counts(rules.failures(batch, rules.RAW)).collect()}
    assert told["rows_out"] == batch.count() == 64 and all(counted[k] == v for k, v in told["injected"].items())
    small, made = runs.ensure_small_batch(df, f"{tmp_path}/small", 40)
    again, remade = runs.ensure_small_batch(df.limit(0), f"{tmp_path}/small", 40)
    assert made and not remade and small.count() == again.count() == 40
    with pytest.raises(ValueError):
        runs.clean_base(df.limit(3), 60)


def test_splits_are_read_by_name_with_their_metadata(spark, tmp_path):
    df = spark.createDataFrame([("reference", 1, 1), ("reference", 2, 0), ("holdout", 3, 0)], "split string, id int, y int")
    sinks.write_split(df, f"{tmp_path}/s", positive=F.col("y") == 1)
    assert sorted(r.id for r in sinks.load_split(spark, f"{tmp_path}/s", "reference").collect()) == [1, 2]
    assert {r.split: (r.rows, r.positive_rate) for r in spark.read.json(f"{tmp_path}/s-metadata").collect()} == {"reference": (2, 0.5), "holdout": (1, 0.0)}
    assert tables.read_existing(spark, f"{tmp_path}/s", "make split").count() == 3
    with pytest.raises(FileNotFoundError, match="make split"):
        tables.read_existing(spark, f"{tmp_path}/none", "make split")


def test_events_keep_broken_lines(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"stage": "a", "n": 1}\n\n{"stage": \n{"stage": "b", "n": "x"}\n')
    got = sorted((str(r.stage), r.n, r.broken) for r in sinks.read_events(spark, str(tmp_path / "e.jsonl"), "stage string, n int").collect())
    assert got == [("None", None, '{"stage": '), ("a", 1, None), ("b", None, '{"stage": "b", "n": "x"}')]


def test_prepared_split_is_a_model_matrix(spark, sf_dir):
    cleaned = clean(credit(spark, sf_dir))
    out = prepare_split(cleaned, fit_imputation(cleaned))
    assert "y" in out.columns and TARGET not in out.columns and out.where(" OR ".join(f"`{c}` IS NULL" for c in out.columns)).count() == 0


def test_p_values_below_the_resolution_are_bounds(spark):
    got = [r.t for r in spark.createDataFrame([(1 / 1001,), (0.25,)], "p double").select(mmd.floored_p(F.col("p"), 1000).alias("t")).collect()]
    assert got == ["<= 0.0010", "0.2500"]


def test_gauges_leave_out_what_was_not_measured(spark):
    names = (*monitor.SCORING_GAUGES, "drifted_warning", "drifted_critical")
    rows = [("full", "1", 10.0, 1.0, 9.0, 0.0, -1.0, None, 1.0, None, None, None, None), ("full", "2", 10.0, 0.0, 10.0, 1.0, 0.0, 5.0, 0.0, 0.1, 0.2, 3.0, 4.0)]
    batches = spark.createDataFrame(rows, "scenario string, batch_id string, " + ", ".join(f"{n} double" for n in names))
    features = spark.createDataFrame([("full", "2", "age", 0.5, None)], "scenario string, batch_id string, feature string, psi double, gain_share double")
    violations = spark.createDataFrame([("full", "1", "age_range", "blocker", 1)], "scenario string, batch_id string, rule string, severity string, rows long")
    stages = spark.createDataFrame([("full", "1", "contract", 0.5, 0)], "scenario string, batch_id string, stage string, seconds double, status int")
    got = {(r.batch_id, r["sample"].split("{", 1)[0], r["sample"].split("{", 1)[1]): r.value for r in monitor.samples_text(monitor.scoring_gauges(batches, features, violations, stages)).collect()}
    assert ("1", "prediction_mean", "}") not in got and ("1", "last_success_timestamp_seconds", "}") not in got and got[("2", "prediction_psi", "}")] == 0.2
    assert got[("2", "drifted_features", 'level="critical"}')] == 4 and not any(k[:2] == ("1", "drifted_features") for k in got)
    assert got[("2", "drift_psi", 'feature="age"}')] == 0.5 and ("2", "drift_psi_weighted", 'feature="age"}') not in got
    assert got[("1", "contract_violations", 'rule="age_range",severity="blocker"}')] == 1 and got[("1", "stage_status", 'stage="contract"}')] == 0
    labelled = spark.createDataFrame([("full", "1", 0.8, 0.1, None, 0.05, 2)], "scenario string, batch_id string, auc double, brier double, calibration_gap double, observed_default_rate double, label_lag_months int")
    assert sorted(r.metric for r in monitor.label_gauges(labelled).collect()) == ["auc", "brier", "label_lag_months", "observed_default_rate"]


def test_report_tables(spark):
    rates = spark.createDataFrame([(10, "a", 0.1, 0.3, 0.0, 0.5), (10, "b", 0.3, 0.6, 0.1, 0.7), (20, "a", 0.0, 0.0, 0.0, 0.2)], "n int, feature string, ks_rate double, psi_warn_rate double, psi_alert_rate double, psi_mean double")
    assert [r.feature for r in reports.offenders(rates, 1).collect()] == ["b"]
    assert {r.kind: (r.n_10, r.n_20) for r in reports.ks_by_type(rates, [10, 20], ("a",)).collect()} == {"continuous": (0.1, 0.0), "count": (0.3, None)}
    bins = spark.createDataFrame([("a", 5), ("b", 3)], "feature string, bins int")
    rows = spark.createDataFrame([("a", 100), ("b", 50)], "feature string, m long")
    got = {r.n: (r.measured, r.predicted) for r in reports.bias_table(rates, bins, rows).collect()}
    assert abs(got[10][0] - 0.6) < 1e-12 and abs(got[10][1] - (4 * (0.1 + 0.01) + 2 * (0.1 + 0.02)) / 2) < 1e-12
    fails = spark.createDataFrame([("w", "warning", 1), ("b", "blocker", 9), ("a", "blocker", None)], "rule string, severity string, row_index long")
    assert [r.rule for r in reports.first_rejections(fails, 2).collect()] == ["a", "b"]


def test_tables_are_published_into_a_document(spark, tmp_path):
    path = f"{tmp_path}/docs/report.md"
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "feature string, psi double")
    first = sinks.publish_table(df, path, "psi")
    assert first == sinks.publish_table(df, path, "psi") and "| a | 0.5000 |" in first
    both = sinks.publish_table(df.limit(1), path, "other")
    assert both.count("begin -->") == 2
    again = sinks.publish_table(df.where("feature = 'b'"), path, "psi")
    assert again.count("begin -->") == 2 and again.count("| a | 0.5000 |") == 1 and (tmp_path / "docs" / "report.md").read_text().strip() == again.strip()
    with pytest.raises(ValueError):
        sinks.publish_table(df, path, "psi", most=1)


def test_paths_and_times_have_one_form(spark):
    from gaugemill.functions import core

    given = ["/r/a//b", r"\r\a\.\b", "./x/y", "/rest/z", "/r/./././q", "a.b/./c."]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, p string").select("i", core.relative_path(F.col("p"), "/r/").alias("t")).collect()
    assert [r.t for r in sorted(rows)] == ["a/b", "a/b", "x/y", "/rest/z", "q", "a.b/c."]
    t = spark.sql("SELECT TIMESTAMP '2024-03-05 06:07:08.9' AS t")
    assert t.select(core.day_stamp(F.col("t")), core.whole_second(F.col("t"))).first() == ("20240305", "2024-03-05T06:07:08")
