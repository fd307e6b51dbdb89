"""Writes: splits, batches, quarantine, metric groups, event logs, checksums, reports."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import blocking, c, quarantined, rule_counts, verdict
from .store import aside, delete, exists, names, replace
from .tables import COLUMNS, MODEL_FEATURES, TARGET

#: Fields that a log line must not carry.
FORBIDDEN_FIELDS = frozenset((*COLUMNS, *MODEL_FEATURES, "row_id"))


def write_split(df: DataFrame, path: str, by: str = "split", positive: Column | None = None) -> None:
    """The sides as folders, and beside them ``<path>-metadata``: rows and, with ``positive``, the positive rate of each."""
    df.write.partitionBy(by).mode("overwrite").parquet(path)
    rate = F.avg((F.lit(None) if positive is None else positive).cast("double")).alias("positive_rate")
    df.groupBy(F.col(by).alias("split")).agg(F.count(F.lit(1)).alias("rows"), rate).coalesce(1).write.mode("overwrite").json(f"{path}-metadata")


def load_split(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One side; the partition filter reads only its files."""
    return spark.read.parquet(path).where(F.col("split") == name)


def write_batch(features: DataFrame, scored: Column, path: str, key: str = "row_id") -> None:
    """Three tables under ``path``, each by (scenario, month): features, predictions, labels."""
    at = ["scenario", "month"]
    for name, cols in (("features", [c(key), *[c(x) for x in MODEL_FEATURES]]), ("predictions", [c(key), scored.alias("probability")]), ("labels", [c(key), c(TARGET).cast("string").alias(TARGET)])):
        features.select(*at, *cols).write.partitionBy(*at).mode("overwrite").parquet(f"{path}/{name}")


def load_batch(spark: SparkSession, path: str, key: str = "row_id") -> DataFrame:
    """The three tables joined; raises unless their keys are the same."""
    on = ["scenario", "month", key]
    f, p, y = (spark.read.parquet(f"{path}/{n}") for n in ("features", "predictions", "labels"))
    keys = f.select(*on, F.lit(1).alias("a")).join(p.select(*on, F.lit(1).alias("b")), on, "full").join(y.select(*on, F.lit(1).alias("d")), on, "full")
    if keys.where("a IS NULL OR b IS NULL OR d IS NULL").limit(1).count():
        raise ValueError("features, predictions and labels do not hold the same rows")
    return f.join(p, on).join(y, on)


def write_quarantine(df: DataFrame, fails: DataFrame, path: str, key: str = "row_id") -> str | None:
    """rows/ (only if row-scoped blockers exist) and rejections/ as JSON lines; None if nothing blocks."""
    bad = blocking(fails)
    if not bad.limit(1).count():
        return None
    if bad.where("row_index IS NOT NULL").limit(1).count():
        quarantined(df, fails, key).withColumnRenamed(key, "batch_row_index").write.mode("overwrite").parquet(f"{path}/rows")
    bad.write.mode("overwrite").json(f"{path}/rejections")
    return path


def validation_report(batch_id: str, schema: str, df: DataFrame, fails: DataFrame) -> dict:
    """The gate's report as one document: counts by rule (at most 13) and totals."""
    counts = rule_counts(fails).orderBy(F.col("severity") != "blocker", F.desc("rows"), "rule").collect()
    rows_in = df.count()
    held = blocking(fails).where("row_index IS NOT NULL").select("row_index").distinct().count()
    return {"batch_id": batch_id, "schema": schema, "verdict": verdict(fails).first()[0], "rows": {"in": rows_in, "passed": rows_in - held, "quarantined": held}, "rules": [r.asDict() for r in counts]}


def report_html(report: dict) -> str:
    rows = "".join(f"<tr><td>{html.escape(r['rule'])}</td><td>{html.escape(r['severity'])}</td><td>{r['rows']}</td></tr>" for r in report["rules"])
    return f"<html><body><h1>{html.escape(report['batch_id'])}: {html.escape(report['verdict'])}</h1><p>{report['rows']}</p><table>{rows}</table></body></html>"


def to_markdown(rows: list, columns: list[str]) -> str:
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[x]) for x in columns) + " |" for r in rows)])


def upsert_section(text: str, marker: str, body: str) -> str:
    """Replaces what stands between the marker's begin and end comments, or appends it."""
    begin, end = f"<!-- {marker}:begin -->", f"<!-- {marker}:end -->"
    block = f"{begin}\n{body}\n{end}"
    return re.sub(re.escape(begin) + ".*?" + re.escape(end), lambda _: block, text, flags=re.S) if begin in text else f"{text.rstrip()}\n\n{block}\n"


def publish_table(df: DataFrame, path: str, marker: str, most: int = 1000) -> str:
    """Puts a report table as Markdown into the document at ``path``, in place of what ``marker`` held there, and returns the
    document. A table of more than ``most`` rows is no report and raises."""
    spark, rows = df.sparkSession, df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    old = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()) if exists(spark, path) else ""
    text = upsert_section(old.strip("\n"), marker, to_markdown(rows, df.columns)).strip("\n")
    tmp = aside(path)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(tmp)
    replace(spark, f"{tmp}/{next(n for n in names(spark, tmp) if n.startswith('part-'))}", path)
    delete(spark, tmp)
    return text


#: Fixed value: the two forms of ids, with dashes and without.
ID_PATTERN = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32}"


def without_ids(col: Column) -> Column:
    return F.regexp_replace(col, ID_PATTERN, "<id>")


def content_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, changed): texts compared after ids are normalised; a file on one side only has changed."""
    a, b = (d.select("name", without_ids(F.col("text")).alias(n)) for d, n in ((old, "o"), (new, "n")))
    return a.join(b, "name", "full").select("name", (~F.col("o").eqNullSafe(F.col("n"))).alias("changed"))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of files that fit a task."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def verified(spark: SparkSession, path: str, expected: str | None) -> str:
    """``match``, ``mismatch``, or ``adopted`` where nothing was expected yet."""
    rows = file_checksums(spark, path).orderBy("path").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("sha256"))), 256)).first()
    return "adopted" if expected is None else "match" if rows[0] == expected else "mismatch"


def write_metric_groups(metrics: DataFrame, path: str) -> None:
    """Replaces the (job, scenario, batch_id) groups that ``metrics`` holds and leaves the others."""
    metrics.write.partitionBy("job", "scenario", "batch_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    """Appends JSON lines; a field named like a feature raises before anything is written."""
    if bad := FORBIDDEN_FIELDS & set(events.columns):
        raise ValueError(f"fields that must not be logged: {sorted(bad)}")
    events.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events with ``broken``: the text of a line that does not fit the schema, null for others. Blank lines give no row."""
    rows = spark.read.schema(f"{schema}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return rows


def write_run_metadata(config: dict[str, str], results: DataFrame, path: str) -> None:
    """One JSON document: the settings of a run and its result rows, a report-sized table."""
    settings = F.create_map(*[F.lit(x) for kv in sorted(config.items()) for x in kv])
    row = results.agg(F.array_sort(F.collect_list(F.struct(*results.columns))).alias("results"))
    row.select(settings.alias("config"), "results").coalesce(1).write.mode("overwrite").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, each of which may span lines; one that does not parse raises."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
