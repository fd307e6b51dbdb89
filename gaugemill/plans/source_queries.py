"""Sources, settings, kept models and logs over the generated tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.core import day_stamp, hash_uniform, relative_path, whole_second
from ..operators import metrics as M
from ..operators import models as MO
from ..operators import monitor as MON
from ..operators import psi as P
from ..operators.clean import clean, feature_matrix, fit_imputation, impute
from ..operators.profile import to_long
from ..sources import config
from ..sources.positions import byte_profile, with_positions
from ..sources.registry import ModelRegistry
from ..sources.tables import MODEL_FEATURES, credit, read_table
from ..streaming import logs
from .helpers import rounded, rsql, shared_dir
from .monitor_queries import _BATCH, _batches


def positional_rows(spark, d):
    return with_positions(spark, f"{d}/lineitem.parquet").select("row_id", "l_orderkey", "l_linenumber")


def profile_bytes(spark, d):
    return byte_profile(spark, f"{d}/lineitem.parquet")


def config_verdicts(spark, d):
    """Batches judged by settings that are read from a file; every one has to be there."""
    path = f"{shared_dir(spark)}/config-{uuid.uuid4().hex}"
    config.save(spark, MON.Thresholds(psi_warn=0.05, psi_alert=0.12, gap_max=-0.004, min_rows=1), path)
    limits = config.one_row(spark, config.load(spark, MON.Thresholds, path))
    rows = _batches(spark, d).select("scenario", "batch_id", F.col("sample_sufficient").alias("rows"), F.col("prediction_psi").alias("psi"), F.col("calibration_gap").alias("gap"))
    return rounded(MON.judged(rows, limits))


def _prepared(spark, d):
    """Cleaned rows with y and the feature vector: seven tenths by hash, and the rest."""
    ready = clean(credit(spark, d))
    split = hash_uniform("models", "row_id") < 0.7
    fit = fit_imputation(ready.where(split))
    part = lambda rows: impute(rows, fit)
    return part(ready.where(split)), part(ready.where(~split))


def champion_scores(spark, d):
    """Both candidates are kept as versions, the better one is named champion, and the champion as it is loaded scores the held-out rows."""
    train, test = (MO.assemble(feature_matrix(x)).persist() for x in _prepared(spark, d))
    registry = ModelRegistry(spark, f"{shared_dir(spark)}/models-{uuid.uuid4().hex}")
    best = None
    for name, model in MO.fit_candidates(train, trees=5).items():
        auc = M.ranking(MO.scores(model, test).select("y", "p")).first()["auc"]
        version = registry.save(model, name=name, auc=auc)
        best = max(best or (auc, version), (auc, version))
    registry.point("champion", best[1])
    scored = MO.scores(registry.load("champion"), test).select("y", "p")
    out = M.batch_metrics(scored).withColumn("version", F.lit(registry.version_of("champion"))).withColumn("kept_auc", F.lit(best[0]))
    out = spark.createDataFrame(out.collect(), out.schema)  # one row
    train.unpersist()
    test.unpersist()
    return rounded(out)


def _checkpoints(spark) -> None:
    """Many boosted trees need a folder for checkpoints, or their lineage grows with them."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def impact_from_model(spark, d):
    """Drift of the held-out rows weighed by the gains of the boosted trees fitted on the others."""
    _checkpoints(spark)
    rows, held = (feature_matrix(x).persist() for x in _prepared(spark, d))
    try:
        gains = MO.gain_table(MO.fit_boosted(MO.assemble(rows)), spark)
        out = P.impact_ranking(P.psi(to_long(rows, MODEL_FEATURES), to_long(held, MODEL_FEATURES)), gains, len(MODEL_FEATURES))
        out = spark.createDataFrame(out.collect(), out.schema)  # one row for each feature
    finally:
        rows.unpersist()
        held.unpersist()
    return rounded(out)


def seed_refits(spark, d):
    """Paired differences of the candidates over five refits."""
    _checkpoints(spark)
    runs = MO.refits(*(MO.assemble(feature_matrix(x)) for x in _prepared(spark, d)), [1, 2, 3, 4, 5])
    return rounded(M.paired_delta(runs, "boosted", "logistic"))


def log_query(spark, d):
    """Events written as log lines, shipped by a stream, and asked for by label and time."""
    e = read_table(spark, d, "events")
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.date_format("ts", "MM-dd").alias("batch_id"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("scenario"),
        F.col("event_type").alias("stage"), F.when(F.col("value") > 100, "warning").otherwise("ok").alias("status"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"), "event_id",
    ))
    root = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    for half in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")):  # appended in two goes
        half.select(line.alias("value")).write.mode("append").text(f"{root}/lines")
        logs.ship(spark, f"{root}/lines", f"{root}/table", f"{root}/state")
    found = logs.matching(logs.read(spark, f"{root}/table"), "2024-01-05 00:00:00", "2024-01-20 12:00:00", level="error", scenario="~s[01]")
    return found.select(F.get_json_object("line", "$.event_id").cast("long").alias("event_id"), "batch_id", "scenario", "stage", "status", "day")


def normalised_paths(spark, d):
    """Addresses as they would stand on another system, brought back to one form below a root."""
    p = read_table(spark, d, "pages")
    odd = F.concat(F.lit("C:\\\\work\\.\\"), F.translate("url", "/", "\\"))
    return p.select("page_id", relative_path(odd, "C:/work").alias("path"))


def event_stamps(spark, d):
    """Events by the day in a batch name, with the first and last second."""
    e = read_table(spark, d, "events")
    per = e.groupBy(day_stamp(F.col("ts")).alias("stamp")).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return per.select("stamp", "events", whole_second(F.col("a")).alias("first"), whole_second(F.col("b")).alias("last"))


QUERIES = {f.__name__: f for f in (positional_rows, profile_bytes, config_verdicts, champion_scores, impact_from_model, seed_refits, log_query, normalised_paths, event_stamps)}
SQL = {
    "positional_rows": "SELECT row_number() OVER () - 1 AS row_id, l_orderkey, l_linenumber FROM lineitem",
    "config_verdicts": rsql("""SELECT scenario, batch_id, sample_sufficient AS rows, prediction_psi AS psi, calibration_gap AS gap, CASE WHEN sample_sufficient < 1 THEN 'insufficient' WHEN prediction_psi >= 0.12 THEN 'critical' WHEN prediction_psi >= 0.05 THEN 'warning' ELSE 'ok' END AS verdict,
      calibration_gap <= -0.004 AS degraded FROM b""", "scenario, batch_id, rows, verdict, degraded", "psi, gap", head=f"WITH {_BATCH}"),
    "normalised_paths": "SELECT page_id, regexp_replace(url, '/{2,}', '/', 'g') AS path FROM pages",
    "event_stamps": "SELECT strftime(ts, '%Y%m%d') AS stamp, count(*) AS events, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last FROM events GROUP BY 1",
    "log_query": """SELECT event_id, strftime(ts, '%m-%d') AS batch_id, 's' || (user_id % 3) AS scenario, event_type AS stage, CASE WHEN value > 100 THEN 'warning' ELSE 'ok' END AS status, strftime(ts, '%Y-%m-%d') AS day
      FROM events WHERE event_type = 'error' AND user_id % 3 IN (0, 1) AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00'""",
}
