"""Streams over several runs: restarts, late rows, repeated batches."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugemill.streaming import stream as S
from gaugemill.streaming.alerting import AlertRule, Series, alert_transitions
from gaugemill.streaming.replay import Replay

T0 = dt.datetime(2024, 1, 1)
at = lambda hours: T0 + dt.timedelta(hours=hours)


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_pending_labels_come_out_once_after_a_restart(spark, tmp_path):
    p_schema, y_schema = "row_id long, ts timestamp, p double", "row_id long, label_ts timestamp, y int"

    def run():
        p = S.arrivals(spark, f"{tmp_path}/p", p_schema).withWatermark("ts", "1 hour")
        y = S.arrivals(spark, f"{tmp_path}/y", y_schema).withWatermark("label_ts", "1 hour")
        return sorted((r.row_id, r.p, r.y, r.pending) for r in S.drain(S.labels_or_pending(p, y, "row_id", "24 hours", "y"), "run", str(tmp_path)).collect())

    land(spark, [(1, at(0), 0.1), (2, at(0), 0.2), (3, at(1), 0.3)], p_schema, f"{tmp_path}/p")
    land(spark, [(1, at(5), 1)], y_schema, f"{tmp_path}/y")
    first = run()
    assert first == [(1, 0.1, 1, 0)]  # the time of 2 and 3 is not over
    land(spark, [(4, at(40), 0.4)], p_schema, f"{tmp_path}/p")
    land(spark, [(3, at(20), 0), (9, at(40), 1)], y_schema, f"{tmp_path}/y")
    assert run() == [(1, 0.1, 1, 0), (2, 0.2, None, 1), (3, 0.3, 0, 0)]
    assert run() == [(1, 0.1, 1, 0), (2, 0.2, None, 1), (3, 0.3, 0, 0)]
    land(spark, [(5, at(100), 0.5)], p_schema, f"{tmp_path}/p")
    land(spark, [(4, at(100), 1)], y_schema, f"{tmp_path}/y")  # later than a day
    assert run()[3:] == [(4, 0.4, None, 1)]


RULE = AlertRule(above=10.0, hold=3600, stale=6 * 3600)


def walked(samples):
    s, out = Series(RULE), []
    for hours, row_id, value in samples:
        out += list(s.sample(int(hours * 3600) * 1_000_000, row_id, value))
    return [(us / 3.6e9, phase, value) for us, phase, value in out]


@pytest.mark.parametrize("samples,want", [
    ([(0, 1, 11.0), (0.5, 2, 5.0)], [(0, "pending", 11.0), (0.5, "inactive", 5.0)]),
    ([(0, 1, 11.0), (1, 2, 12.0), (2, 3, 13.0), (3, 4, None)], [(0, "pending", 11.0), (1, "firing", 12.0), (3, "resolved", None)]),
    ([(0, 1, 11.0), (2, 2, 12.0), (9, 3, 12.0)], [(0, "pending", 11.0), (2, "firing", 12.0), (8, "resolved", None), (9, "pending", 12.0)]),
    ([(0, 1, 10.0), (1, 2, float("nan"))], []),
    ([(2, 1, 11.0), (1, 2, 5.0), (2, 1, 5.0), (2, 3, 5.0)], [(2, "pending", 11.0), (2, "inactive", 5.0)]),
])
def test_alert_phases(samples, want):
    assert walked(samples) == want


def test_rule_without_hold_fires_at_once():
    assert [x[1] for x in Series(AlertRule(1.0, 0, 60)).sample(0, 1, 2.0)] == ["firing"]
    with pytest.raises(ValueError):
        AlertRule(1.0, -1, 60)


def test_alert_state_survives_restarts_and_silence(spark, tmp_path):
    schema = "series string, ts timestamp, row_id long, value double"

    def run():
        samples = S.arrivals(spark, f"{tmp_path}/in", schema).withWatermark("ts", "1 hour")
        return sorted(((r.moment - T0).total_seconds() / 3600, r.series, r.phase, r.value) for r in S.drain(alert_transitions(samples, RULE), "run", str(tmp_path)).collect())

    land(spark, [("a", at(0), 1, 20.0), ("b", at(0.5), 2, 20.0)], schema, f"{tmp_path}/in")
    got = [(0.0, "a", "pending", 20.0), (0.5, "b", "pending", 20.0)]
    assert run() == got
    land(spark, [("a", at(1), 3, 21.0)], schema, f"{tmp_path}/in")
    got.append((1.0, "a", "firing", 21.0))
    assert run() == got
    land(spark, [("c", at(5), 4, 1.0), ("a", at(4), 5, 22.0), ("a", at(2), 6, 2.0)], schema, f"{tmp_path}/in")
    got += [(2.0, "a", "resolved", 2.0), (4.0, "a", "pending", 22.0)]
    assert run() == sorted(got)
    land(spark, [("c", at(12), 7, 1.0)], schema, f"{tmp_path}/in")  # a and b have said nothing for six hours
    got += [(6.5, "b", "inactive", None), (10.0, "a", "inactive", None)]
    assert run() == sorted(got)


@pytest.fixture
def replay(spark, tmp_path):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "row_id long, y int")
    return Replay(spark, str(tmp_path), labels, F.col("x") / 10, F.col("x") >= 0, last_month=3, lag=1, min_rows=3)


def month(spark, m, ids, x=1.0):
    return spark.createDataFrame([("full", m, i, x) for i in ids], "scenario string, month int, row_id long, x double")


def table_of(replay):
    return {(r.job, r.batch_id, r.metric): r.value for r in replay.metrics().collect()}


def test_replay_is_the_same_after_a_repeated_batch(spark, replay):
    replay.publish(month(spark, 0, range(4)), 0)
    first = table_of(replay)
    assert first[("scoring", "0", "rows")] == 4 and first[("scoring", "0", "labels_pending")] == 0 and not any(k[0] == "labels" for k in first)
    replay.publish(month(spark, 1, range(10, 15), 2.0), 1)
    second = table_of(replay)
    assert second[("labels", "0", "observed_rate")] == 0.5 and abs(second[("labels", "0", "calibration_gap")] + 0.4) < 1e-12
    replay.publish(month(spark, 1, range(10, 15), 2.0), 1)
    assert table_of(replay) == second
    replay.score = F.lit(0.9)  # labels meet what was recorded, not what the model would say now
    replay.publish(month(spark, 2, range(20, 24)), 2)
    third = table_of(replay)
    assert abs(third[("labels", "1", "calibration_gap")] - (0.2 - 0.4)) < 1e-12 and third[("scoring", "2", "mean_predicted")] == 0.9
    assert {k: v for k, v in third.items() if k[1] == "0"} == {k: v for k, v in second.items() if k[1] == "0"}


def test_replay_of_a_month_in_parts_a_blocked_and_a_small_one(spark, replay):
    replay.publish(month(spark, 0, range(2)), 0)
    assert table_of(replay)[("scoring", "0", "verdict")] == -1  # too few rows
    replay.publish(month(spark, 0, range(2, 6)), 1)  # the rest of the month
    assert table_of(replay)[("scoring", "0", "rows")] == 6 and ("scoring", "0", "verdict") not in table_of(replay)
    replay.publish(month(spark, 1, range(10, 14), -1.0), 2)
    replay.publish(month(spark, 2, range(20, 24)), 3)
    got = table_of(replay)
    assert (got[("scoring", "1", "stage_contract")], got[("scoring", "1", "stage_drift")], got[("scoring", "1", "verdict")]) == (0, -1, -2)
    assert ("scoring", "1", "mean_predicted") not in got and not any(k[:2] == ("labels", "1") for k in got)
    replay.publish(month(spark, 3, []), 4)
    assert table_of(replay) == got


def test_replay_as_a_stream_takes_each_step_once(spark, replay, tmp_path):
    schema = "scenario string, month int, row_id long, x double"
    for m in range(3):
        land(spark, [("full", m, 10 * m + i, 1.0) for i in range(4)], schema, f"{tmp_path}/in")
        replay.run(S.arrivals(spark, f"{tmp_path}/in", schema, 1000))
    once = table_of(replay)
    replay.run(S.arrivals(spark, f"{tmp_path}/in", schema, 1000))
    assert table_of(replay) == once and once[("labels", "1", "rows")] == 4 and once[("scoring", "2", "labels_pending")] == 0


def test_metric_groups_as_a_stream(spark, tmp_path):
    schema = "job string, scenario string, batch_id string, metric string, value double"
    land(spark, [("s", "full", "1", "auc", 0.5), ("s", "full", "1", "old", 1.0), ("s", "full", "2", "auc", 0.6)], schema, f"{tmp_path}/in")
    go = lambda: S.replace_groups(S.arrivals(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/state")
    go()
    land(spark, [("s", "full", "1", "auc", 0.7)], schema, f"{tmp_path}/in")
    go()
    assert sorted((r.batch_id, r.metric, r.value) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "auc", 0.7), (2, "auc", 0.6)]
