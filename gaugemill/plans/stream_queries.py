"""Streams that run over what is there and stop; their results equal the batch queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.models import stub_score
from ..operators.rules import c
from ..sources.tables import AGE, TARGET, UTILIZATION, credit, read_table
from ..streaming import stream as S
from ..streaming.alerting import AlertRule, alert_transitions
from ..streaming.replay import Replay
from .helpers import WITH_CREDIT, rounded, rsql, shared_dir


def _state(spark) -> str:
    """A fresh folder for the state of a stream."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, d):
    """The events table as a stream; the pattern also matches a single file."""
    schema = read_table(spark, d, "events").schema
    return S.with_event_time(S.arrivals(spark, f"{d}/event[s].parquet", schema), "ts", "1 day")


def stream_daily_counts(spark, d):
    out = S.drain(S.daily_counts(_events(spark, d)), f"daily_{uuid.uuid4().hex[:8]}", _state(spark), "complete")
    return rounded(out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", "max_value"))


def stream_last_gauge(spark, d):
    out = S.drain(S.last_gauge(_events(spark, d), "user_id", "ts", "value"), f"gauge_{uuid.uuid4().hex[:8]}", _state(spark), "complete")
    return rounded(out.select("user_id", "value"))


def stream_late_labels(spark, d):
    """Clicks as predictions, purchases of the same user within two days as their labels."""
    schema = read_table(spark, d, "events").schema
    arrive = lambda kind: S.arrivals(spark, f"{d}/event[s].parquet", schema).where(F.col("event_type") == kind)
    p = S.with_event_time(arrive("click").select("user_id", "event_id", "ts"), "ts", "1 day")
    y = S.with_event_time(arrive("purchase").select("user_id", F.col("event_id").alias("label_id"), F.col("ts").alias("label_ts")), "label_ts", "1 day")
    joined = S.late_label_join(p, y, "user_id", "2 days").select("p.user_id", "event_id", "label_id")
    return S.drain(joined, f"late_{uuid.uuid4().hex[:8]}", _state(spark))


def _clicks_and_purchases(spark, d):
    schema = read_table(spark, d, "events").schema
    arrive = lambda kind: S.arrivals(spark, f"{d}/event[s].parquet", schema).where(F.col("event_type") == kind)
    p = S.with_event_time(arrive("click").select("user_id", "event_id", "ts"), "ts", "1 day")
    y = S.with_event_time(arrive("purchase").select("user_id", F.col("event_id").alias("label_id"), F.col("ts").alias("label_ts")), "label_ts", "1 day")
    return p, y


def stream_pending_labels(spark, d):
    """Clicks with the purchases of the same user within two days, or pending once their time is over."""
    out = S.labels_or_pending(*_clicks_and_purchases(spark, d), "user_id", "2 days", "label_id").drop("ts")
    return S.drain(out, f"pending_{uuid.uuid4().hex[:8]}", _state(spark))


RULE = AlertRule(above=40.0, hold=12 * 3600, stale=3 * 86_400)


def stream_alert_states(spark, d):
    """Each user's last value against a rule that must hold half a day; three days of silence end an alert."""
    samples = _events(spark, d).select(F.col("user_id").cast("string").alias("series"), "ts", F.col("event_id").alias("row_id"), "value")
    out = S.drain(alert_transitions(samples, RULE), f"alerts_{uuid.uuid4().hex[:8]}", _state(spark))
    return rounded(out.select("series", F.date_format("moment", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"), "phase", "value"))


#: A year whose share of impossible ages is above this is blocked.
TOLERANCE = 0.003


def stream_replay(spark, d):
    """Years arrive one after another as months do, scored by the stub; labels come two steps later."""
    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("scenario"), F.year("o_orderdate").alias("month"))
    rows = credit(spark, d, AGE, UTILIZATION, TARGET).select("row_id", c(AGE).alias("age"), c(UTILIZATION).alias("u"), F.when(c(TARGET) == "1", 1).otherwise(0).alias("y")).join(orders, "row_id")
    root = _state(spark)
    rows.write.partitionBy("month").parquet(f"{root}/staged")
    staged = spark.read.schema(rows.select("row_id", "age", "u", "y", "scenario", "month").schema).parquet(f"{root}/staged")
    years = [r.month for r in orders.select("month").distinct().orderBy("month").collect()]  # one for each step
    u = F.floor(F.least(F.col("u"), F.lit(1.0)) * 200) / 200
    replay = Replay(spark, root, staged.select("row_id", "y"), stub_score(u) * 0.12, F.col("age").between(18, 110), years[-1] if years else 0, tolerance=TOLERANCE)
    for year in years:
        staged.where(F.col("month") == year).drop("y").write.mode("append").parquet(f"{root}/arrived")
        replay.run(S.arrivals(spark, f"{root}/arrived", staged.drop("y").schema, 1_000_000))
    return rounded(replay.metrics().select("job", "scenario", "batch_id", "metric", "value"))


QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_last_gauge, stream_late_labels, stream_pending_labels, stream_alert_states, stream_replay)}
_MS = "date_trunc('millisecond', {})"
_REPLAY = f"""{WITH_CREDIT}, s AS (SELECT o_orderstatus AS scenario, year(o_orderdate)::INT AS month, age, CASE WHEN "{TARGET}" = '1' THEN 1 ELSE 0 END AS y, 0.12::DOUBLE / (1 + exp(-(4 * (floor(least("{UTILIZATION}", 1.0::DOUBLE) * 200) / 200) - 2))) AS p FROM credit JOIN orders ON row_id = o_orderkey),
  g AS (SELECT scenario, month, count(*) AS rows, avg(p) AS mean_predicted, avg(CASE WHEN age BETWEEN 18 AND 110 THEN 0.0::DOUBLE ELSE 1 END) > {TOLERANCE}::DOUBLE AS blocked, avg(y) AS observed_rate, avg(p) - avg(y) AS calibration_gap, avg((p - y) * (p - y)) AS brier, (SELECT max(month) FROM s) AS last FROM s GROUP BY scenario, month),
  m AS (SELECT 'scoring' AS job, scenario, month, unnest(['rows', 'stage_contract', 'stage_drift', 'verdict', 'mean_predicted', 'labels_pending']) AS metric,
      unnest([rows::DOUBLE, CASE WHEN blocked THEN 0 ELSE 1 END, CASE WHEN blocked THEN -1 ELSE 1 END, CASE WHEN blocked THEN -2 WHEN rows < 1000 THEN -1 END, CASE WHEN NOT blocked THEN mean_predicted END, (month + 2 > last)::INT]) AS value FROM g
    UNION ALL SELECT 'labels', scenario, month, unnest(['rows', 'observed_rate', 'calibration_gap', 'brier', 'label_lag']), unnest([rows::DOUBLE, observed_rate, calibration_gap, brier, 2]) FROM g
    WHERE NOT blocked AND month + 2 <= last AND EXISTS (SELECT 1 FROM s WHERE s.month = g.month + 2))"""
SQL = {
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(max(value), 6) + 0.0::DOUBLE AS max_value FROM events GROUP BY ALL",
    "stream_last_gauge": "SELECT user_id, round(arg_max(value, ts), 6) + 0.0::DOUBLE AS value FROM events GROUP BY user_id",
    "stream_late_labels": "SELECT p.user_id, p.event_id, y.event_id AS label_id FROM events p JOIN events y USING (user_id) WHERE p.event_type = 'click' AND y.event_type = 'purchase' AND y.ts >= p.ts AND y.ts <= p.ts + INTERVAL 2 DAY",
    "stream_pending_labels": f"""WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), y AS (SELECT user_id, event_id AS label_id, ts AS label_ts FROM events WHERE event_type = 'purchase'),
      w AS (SELECT least((SELECT {_MS.format('max(ts)')} FROM p), (SELECT {_MS.format('max(label_ts)')} FROM y)) - INTERVAL 1 DAY AS w)
      SELECT p.user_id, event_id, label_id, (label_id IS NULL)::INT AS pending FROM p LEFT JOIN y ON p.user_id = y.user_id AND label_ts >= ts AND label_ts <= ts + INTERVAL 2 DAY
      WHERE label_id IS NOT NULL OR ts <= (SELECT w - INTERVAL 2 DAY - INTERVAL 1 MILLISECOND FROM w)""",
    "stream_alert_states": rsql(f"""SELECT user_id::VARCHAR AS series, strftime(t.moment, '%Y-%m-%d %H:%M:%S.%f') AS moment, t.phase AS phase, t.value AS value FROM (SELECT user_id, unnest([
        {{'moment': started, 'phase': 'pending', 'value': first_value}}, {{'moment': fired, 'phase': 'firing', 'value': fired_value}},
        {{'moment': coalesce(ended, CASE WHEN closed THEN last + INTERVAL {RULE.stale} SECOND END), 'phase': CASE WHEN fired IS NULL THEN 'inactive' ELSE 'resolved' END, 'value': end_value}}]) AS t
      FROM (SELECT user_id, seg, island, any_value(last) AS last, any_value(closed) AS closed, min(ts) FILTER (bad) AS started, arg_min(value, (ts, event_id)) FILTER (bad) AS first_value,
          min(ts) FILTER (bad AND held) AS fired, arg_min(value, (ts, event_id)) FILTER (bad AND held) AS fired_value, min(ts) FILTER (NOT bad) AS ended, arg_min(value, (ts, event_id)) FILTER (NOT bad) AS end_value
        FROM (SELECT *, ts - min(ts) FILTER (bad) OVER (PARTITION BY user_id, seg, island) >= INTERVAL {RULE.hold} SECOND AS held FROM i WHERE island > 0) GROUP BY user_id, seg, island)) WHERE t.moment IS NOT NULL""",
      "series, moment, phase", "value", head=f"""WITH e AS (SELECT *, value > {RULE.above} AS bad, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events),
      s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL {RULE.stale} SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM e),
      b AS (SELECT *, coalesce(lag(bad) OVER w, false) AS was, max(ts) OVER (PARTITION BY user_id, seg) AS last, max(CASE WHEN after IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, seg) = 1 AS open FROM s WINDOW w AS (PARTITION BY user_id, seg ORDER BY ts, event_id)),
      i AS (SELECT *, sum(CASE WHEN bad AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) AS island,
        NOT open OR {_MS.format('last')} + INTERVAL {RULE.stale} SECOND < (SELECT {_MS.format('max(ts)')} - INTERVAL 1 DAY FROM events) AS closed FROM b)"""),
    "stream_replay": rsql("SELECT job, scenario, month::VARCHAR AS batch_id, metric, value FROM m WHERE value IS NOT NULL", "job, scenario, batch_id, metric", "value", head=_REPLAY),
}
