"""Positions, footers, checksums, kept results, model versions, settings and logs."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gaugemill.operators import monitor as MON
from gaugemill.sources import checksums, config, positions, store
from gaugemill.sources.cache import cached, content_key
from gaugemill.sources.registry import ModelRegistry
from gaugemill.streaming import logs


def test_positions_follow_files_and_rows(spark, tmp_path):
    for k, n in enumerate((3, 0, 5, 1)):
        spark.range(10 * k, 10 * k + n).withColumn("row_id", F.lit("old")).coalesce(1).write.parquet(f"{tmp_path}/p{k}")
    df = positions.with_positions(spark, f"{tmp_path}/p*")
    assert df.columns == ["row_id", "id"]
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == list(enumerate([0, 1, 2, 20, 21, 22, 23, 24, 30]))
    assert "Exchange hashpartitioning(id" not in df._jdf.queryExecution().toString() and positions.with_positions(spark, f"{tmp_path}/p1").count() == 0


def test_byte_profile_is_what_the_footers_say(spark, tmp_path):
    spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("s")).repartition(3).write.parquet(f"{tmp_path}/t")
    want: dict = {}
    for f in (tmp_path / "t").glob("*.parquet"):
        meta = pq.read_metadata(f)
        for g in range(meta.num_row_groups):
            for k in range(meta.num_columns):
                col = meta.row_group(g).column(k)
                row = want.setdefault(col.path_in_schema, [0, 0, 0, 0, 0])
                for i, v in enumerate((meta.row_group(g).num_rows, 1, col.total_compressed_size, col.total_uncompressed_size, col.statistics.null_count)):
                    row[i] += v
    got = {r.column: [r.rows, r.row_groups, r.compressed, r.plain, r.nulls] for r in positions.byte_profile(spark, f"{tmp_path}/t").collect()}
    assert got == want and got["s"][4] == 666


def test_checksums_match_mismatch_adopt_and_write_back(spark, tmp_path):
    data, known = tmp_path / "data", str(tmp_path / "known")
    data.mkdir()
    (data / "a.bin").write_bytes(bytes(range(256)) * 10)
    (data / "empty.bin").write_bytes(b"")
    status = lambda: {r.name: r.status for r in checksums.verify(spark, str(data), known, 1000).collect()}
    blocks = [hashlib.sha256((bytes(range(256)) * 10)[i : i + 1000]).hexdigest() for i in (0, 1000, 2000)]
    got = {r.name: (r.digest, r.length) for r in checksums.file_digests(spark, str(data), 1000).collect()}
    assert got["a.bin"] == (hashlib.sha256(",".join(["1000", *blocks]).encode()).hexdigest(), 2560)
    assert status() == {"a.bin": "adopted", "empty.bin": "adopted"} and status() == {"a.bin": "match", "empty.bin": "match"}
    (data / "a.bin").write_bytes(bytes(range(256)) * 9 + b"\0" * 256)
    (data / "b.bin").write_bytes(b"new")
    assert status() == {"a.bin": "mismatch", "empty.bin": "match", "b.bin": "adopted"}
    assert status()["a.bin"] == "mismatch"  # what is known does not change by being asked
    assert checksums.needs_fetch(spark, str(data), known, "a.bin", 1000) and not checksums.needs_fetch(spark, str(data), known, "b.bin", 1000) and checksums.needs_fetch(spark, str(data), known, "c.bin")
    (data / "b.bin").unlink()
    assert status()["b.bin"] == "missing"


def test_kept_results(spark, tmp_path):
    ran = []

    def go(df, **params):
        return cached(str(tmp_path), {"x": df}, params, lambda: ran.append(1) or df.groupBy().agg(F.sum("id").alias("s"))).first().s

    df = spark.range(100)
    assert go(df, a=1) == 4950 and len(ran) == 1
    assert go(df.orderBy(F.desc("id")).repartition(7), a=1) == 4950 and len(ran) == 1  # the same rows in another order
    go(df, a=2), go(df.where("id <> 5"), a=1), go(df.unionByName(df.where("id = 5")), a=1), go(df.unionByName(df.where("id = 5")).unionByName(df.where("id = 5")), a=1), go(df.withColumn("y", F.lit(None).cast("int")), a=1)
    assert len(ran) == 6
    assert content_key({"x": df.limit(0)}, {}) != content_key({"x": df.limit(0).select(F.col("id").alias("j"))}, {})
    assert not [n for n in store.names(spark, str(tmp_path)) if n.startswith(".") and not n.endswith(".crc")]


def test_a_cut_off_write_is_never_read(spark, tmp_path):
    path = f"{tmp_path}/r"
    with pytest.raises(Exception, match="boom|UDF|USER_RAISED"):
        store.write_once(spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("x")), path)
    assert not store.exists(spark, path)
    store.write_once(spark.range(5), path)
    store.write_once(spark.range(9), path)  # too late: the first stays
    assert spark.read.parquet(path).count() == 5 and store.names(spark, f"{tmp_path}/nothing") == []


def test_model_versions_and_alias(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(float(i % 2), Vectors.dense([i % 2 + i / 50, i % 3])) for i in range(60)], ["label", "features"])
    r, models = ModelRegistry(spark, str(tmp_path)), [LogisticRegression(regParam=x, maxIter=20).fit(rows) for x in (0.1, 0.9)]
    with pytest.raises(KeyError):
        r.load("champion")
    assert [r.save(m, auc=0.5 + i) for i, m in enumerate(models)] == [1, 2] and r.about(2)["facts"] == {"auc": 1.5}
    told = lambda m: [x.p for x in m.transform(rows).select(F.col("probability").cast("string").alias("p")).collect()]
    r.point("champion", 1)
    assert told(r.load("champion")) == told(models[0])
    r.point("champion", 2)
    assert r.version_of("champion") == 2 and told(r.load("champion")) == told(models[1]) != told(models[0])
    (tmp_path / "versions" / ".v000000-half" / "model").mkdir(parents=True)  # what a writer left that was cut off
    assert r.versions() == [1, 2] and r.save(models[0]) == 3
    with pytest.raises(KeyError):
        r.point("champion", 9)
    assert r.version_of("champion") == 2


@dataclass(frozen=True)
class Inner:
    n: int


@dataclass(frozen=True)
class Outer:
    name: str
    share: float
    on: bool
    inner: Inner


GOOD = {"name": "x", "share": 1, "on": True, "inner": {"n": 3}}


@pytest.mark.parametrize("change,said", [
    ({"share": None}, "Outer.share"), ({"name": 3}, "Outer.name"), ({"on": 1}, "Outer.on"), ({"inner": {"n": 1.5}}, "Outer.inner.n"), ({"inner": {}}, "missing Outer.inner.n"),
    ({"inner": []}, "not a mapping"), ({"extra": 1}, "unknown Outer.extra"), ({"name": ...}, "missing Outer.name"),
])
def test_settings_name_what_is_wrong(change, said):
    with pytest.raises(config.ConfigError, match=said):
        config.parsed(Outer, {k: v for k, v in (GOOD | change).items() if v is not ...})


def test_settings_round_trip(spark, tmp_path):
    assert config.parsed(Outer, GOOD) == Outer("x", 1.0, True, Inner(3))
    limits = MON.Thresholds(psi_warn=0.2)
    config.save(spark, limits, f"{tmp_path}/c")
    assert config.load(spark, MON.Thresholds, f"{tmp_path}/c") == limits and config.one_row(spark, limits).first().psi_warn == 0.2
    (tmp_path / "bad.json").write_text('{"psi_warn": 0.1')
    with pytest.raises(config.ConfigError):
        config.load(spark, MON.Thresholds, f"{tmp_path}/bad.json")
    (tmp_path / "few.json").write_text('{"psi_warn": 0.1}')
    with pytest.raises(config.ConfigError, match="missing Thresholds.auc_min"):  # although the class has a default
        config.load(spark, MON.Thresholds, f"{tmp_path}/few.json")


def test_logs_are_shipped_once_and_found_by_label_and_time(spark, tmp_path):
    src, ship = tmp_path / "src", lambda: logs.ship(spark, str(tmp_path / "src"), f"{tmp_path}/out", f"{tmp_path}/state")
    src.mkdir()
    line = lambda ts, level, stage, **k: str({"ts": ts, "level": level, "stage": stage, "batch_id": "month_01", "scenario": "full", **k}).replace("'", '"')
    (src / "a.jsonl").write_text("\n".join([line("2024-01-01 10:00:00", "error", "drift", rows=1), "", "  ", "{broken", line("2024-01-02 00:00:00", "info", "score")]) + "\n")
    ship()
    (src / "b.jsonl").write_text(line("2024-01-02 09:00:00", "error", "score") + "\n" + line("no time", "error", "x") + "\n")
    ship()
    ship()
    table = logs.read(spark, f"{tmp_path}/out")
    assert sorted((r.level, r.day, r.stage) for r in table.collect()) == [("error", "2024-01-01", "drift"), ("error", "2024-01-02", "score"), ("error", "none", "x"), ("info", "2024-01-02", "score"), ("unparsed", "none", None)]
    stages = lambda *a, **k: sorted(r.stage for r in logs.matching(table, *a, **k).collect())
    assert stages(level="error") == ["drift", "score", "x"] and stages("2024-01-02 00:00:00", level="error") == ["score"] and stages(end="2024-01-02 00:00:00") == ["drift"]
    assert stages(stage="~dr.*|x", batch_id="month_01") == ["drift", "x"] and stages(contains='"rows": 1') == ["drift"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = logs.matching(table, "2024-01-02 00:00:00", level="error")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    chosen = plan.split("PartitionFilters: [")[1].split("], ")[0]
    assert "day" in chosen and "level" in chosen
    with pytest.raises(ValueError):
        logs.matching(table, text="x")
    assert [(r.day, r.lines) for r in logs.rate(table, "level").where("level = 'error'").orderBy("day").collect()] == [("2024-01-01", 1), ("2024-01-02", 1), ("none", 1)]
