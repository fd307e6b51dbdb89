"""Hand-derived cases of the operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugemill.functions import core
from gaugemill.operators import clean, ecdf, fairness, metrics, mmd, models, monitor, profile, psi, rules, sampling, simulate
from gaugemill.sources import sinks
from gaugemill.sources.tables import AGE, COLUMNS, DEPENDENTS, FEATURES, INCOME, INCOME_MISSING, LATE90, RAW_SCHEMA, TARGET, UTILIZATION


def frame(spark, n=40, **changes):
    """n clean rows, row_id 0..; 7 in 100 positive; ``changes``: {row: {column: value}} under ``at``."""
    at = changes.get("at", {})
    rows = []
    for i in range(n):
        r = {TARGET: "1" if i % 14 == 0 else "0", UTILIZATION: 0.05 + 0.01 * i, AGE: 25 + i % 60, FEATURES[2]: i % 3, FEATURES[3]: 0.2 + 0.01 * i, INCOME: 3000.0 + 100 * i, FEATURES[5]: 5 + i % 7, FEATURES[6]: i % 2, FEATURES[7]: i % 3, FEATURES[8]: (i + 1) % 2, DEPENDENTS: float(i % 4)}
        r |= at.get(i, {})
        rows.append((i, *[r[c] for c in COLUMNS]))
    return spark.createDataFrame(rows, T.StructType([T.StructField("row_id", T.LongType()), *[T.StructField(f.name, f.dataType) for f in RAW_SCHEMA]]))


def one(df):
    return df.collect()[0]


def test_rule_registry_and_severities(spark):
    assert len(rules.SEVERITY) == 13 and sum(v == rules.BLOCKER for v in rules.SEVERITY.values()) == 10
    assert rules.severity_for("nobody knows") == rules.BLOCKER
    with pytest.raises(rules.UnknownRuleError):
        rules.resolve_rule("nobody knows")
    for c in (rules.RAW, rules.MODEL, rules.SCORING, rules.LABEL):
        rules.assert_rules_are_classified(c)


def test_row_rules_and_null_policy(spark):
    df = frame(spark, at={1: {AGE: 12}, 2: {LATE90: 98}, 3: {INCOME: None}, 4: {DEPENDENTS: None}, 5: {INCOME: -1.0}, 6: {UTILIZATION: 2.0}})
    got = {(r.rule, r.row_index) for r in rules.failures(df, rules.RAW).where("scope = 'row'").collect()}
    assert got == {("age_range", 1), ("delinquency_sentinels", 2), ("nested_missingness", 4), ("monthly_income_non_negative", 5), ("revolving_utilization_at_most_one", 6)}
    model = {(r.rule, r.row_index) for r in rules.failures(df.withColumn(INCOME_MISSING, clean.income_missing()), rules.MODEL).collect() if r.row_index == 3}
    assert {("monthly_income_present", 3), (rules.SCHEMA_RULE, 3), ("no_nulls_in_features", 3)} <= model


def test_structure(spark):
    df = frame(spark)
    assert rules.structural_findings(df, rules.RAW, "row_id") == []
    assert ("missing", AGE) in rules.structural_findings(df.drop(AGE), rules.RAW, "row_id")
    assert ("dtype", AGE) in rules.structural_findings(df.withColumn(AGE, F.col(AGE).cast("long")), rules.RAW, "row_id")
    assert ("unexpected", "x") in rules.structural_findings(df.withColumn("x", F.lit(1)), rules.RAW, "row_id")
    assert one(rules.verdict(rules.failures(df.drop(AGE), rules.RAW)))[0] == "BLOCKED"


def test_injected_defects_are_counted(spark):
    out, manifest = rules.inject_defects(frame(spark, 26))
    got = {r.rule: r["rows"] for r in rules.rule_counts(rules.failures(out, rules.RAW)).collect() if r.rule != "positive_rate_band"}
    assert got == manifest
    fails = rules.failures(out, rules.RAW)
    row = one(rules.row_counts(out, fails))
    assert row.rows_passed + row.rows_quarantined == row.rows_in and row.rows_quarantined == 12
    _, mild = rules.inject_defects(frame(spark, 26), include_blockers=False)
    assert mild == {"revolving_utilization_at_most_one": 3, "no_duplicate_rows": 4}


def test_gate_actions(spark, tmp_path):
    df = frame(spark, at={1: {AGE: 12}})
    with pytest.raises(rules.ContractBlockedError):
        rules.assert_passes(df, rules.RAW)
    assert rules.validate_or_none(frame(spark), rules.RAW) is None
    fails = rules.failures(df, rules.RAW)
    assert sinks.write_quarantine(df, fails, str(tmp_path / "q")) and spark.read.parquet(str(tmp_path / "q/rows")).count() == 1
    assert sinks.write_quarantine(frame(spark), rules.failures(frame(spark), rules.RAW), str(tmp_path / "none")) is None
    report = sinks.validation_report("b1", "raw", df, fails)
    assert report["verdict"] == "BLOCKED" and report["rows"] == {"in": 40, "passed": 39, "quarantined": 1} and "b1" in sinks.report_html(report)


def test_clean_and_impute(spark):
    df = frame(spark, at={0: {LATE90: 96}, 1: {AGE: 0}, 2: {INCOME: 0.0}, 3: {INCOME: None, DEPENDENTS: None}, 4: {UTILIZATION: 50.0}, 5: {FEATURES[3]: 9.0}})
    out = {r.row_id: r for r in clean.clean(df).collect()}
    assert 0 not in out and 1 not in out and out[2][INCOME_MISSING] == 1 and out[2][INCOME] is None
    assert out[3][DEPENDENTS] == 0.0 and out[4][UTILIZATION] == 10.0 and out[5][FEATURES[3]] == 2.0
    r = one(clean.clean_report(df))
    assert (r.sentinels_dropped, r.ages_dropped, r.income_missing, r.debt_ratio_capped, r.utilization_capped, r.dependents_filled, r.rows_out) == (1, 1, 2, 1, 1, 1, 38)
    full = clean.impute(clean.clean(df), clean.fit_imputation(clean.clean(df)))
    assert full.where(F.col(INCOME).isNull()).count() == 0
    with pytest.raises(ValueError):
        rules.assert_nested_missingness_subsumed(frame(spark, at={3: {DEPENDENTS: None}}).withColumn(INCOME_MISSING, clean.income_missing()))


def test_split_and_samples_are_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("string").alias("y"))
    got = {(r.split, r.y): r["count"] for r in sampling.stratified_split(df, "y", {"a": 0.7, "b": 0.3}, "s", "k").groupBy("split", "y").count().collect()}
    assert got == {("a", "true"): 70, ("b", "true"): 30, ("a", "false"): 630, ("b", "false"): 270}
    again = sampling.uniform_sample(df.repartition(7), 50, "s", "k").collect()
    assert {r.k for r in again} == {r.k for r in sampling.uniform_sample(df, 50, "s", "k").collect()}
    assert sampling.stratified_sample(df, "y", {"true": 5, "false": 9}, "s", "k").count() == 14


def long(spark, values, feature="f"):
    return spark.createDataFrame([(feature, None if v is None else float(v)) for v in values], "feature string, value double")


def test_psi_edges_and_identity(spark):
    few = one(psi.fit_edges(long(spark, [1, 1, 2, 3] * 30)))
    assert few.interior == [1.5, 2.5]
    many = one(psi.fit_edges(long(spark, range(101))))
    assert many.interior == [10.0 * i for i in range(1, 10)]
    zero = one(psi.fit_edges(long(spark, [0] * 80 + list(range(1, 60)))))
    assert zero.interior[0] > 0
    same = long(spark, range(200))
    assert abs(one(psi.psi(same, same)).psi) < 1e-12
    assert one(psi.psi(same, long(spark, range(150, 350)))).psi > 1
    assert max(one(psi.fit_edges(long(spark, [None, 1.0, float("nan"), 2.0]))).interior) < 2


@pytest.mark.parametrize(("value", "word"), [(0.0, "stable"), (0.099, "stable"), (0.10, "moderate"), (0.249, "moderate"), (0.25, "significant"), (1.0, "significant")])
def test_psi_verdicts(spark, value, word):
    r = one(spark.range(1).select(psi.psi_verdict(F.lit(value)).alias("w"), psi.psi_verdict(F.lit(value), F.lit(999)).alias("s"), psi.batch_verdict(F.lit(value), F.lit(5000)).alias("c")))
    assert (r.w, r.s) == (word, "insufficient") and r.c == {"stable": 0, "moderate": 1, "significant": 2}[word]


def test_ks_and_midrank(spark):
    a, b = [1, 2, 2, 3, 5, 8], [2, 3, 3, 4, 9]
    brute = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in a + b)
    r = one(ecdf.ks_two_sample(long(spark, a), long(spark, b)))
    assert abs(r.ks - brute) < 1e-12 and (r.n_ref, r.n_cur) == (6, 5) and 0 < r.pvalue <= 1
    got = {x.value: x.u for x in ecdf.midrank(long(spark, [0, 2, 4, 9]), ecdf.fit_ecdf(long(spark, a))).collect()}
    for v, u in got.items():
        want = (sum(x < v for x in a) + sum(x <= v for x in a)) / 12
        assert abs(u - min(1 - 1e-6, max(1e-6, want))) < 1e-12


def test_normal_quantile(spark):
    from statistics import NormalDist

    for u in (1e-6, 0.01, 0.3, 0.5, 0.97, 1 - 1e-6):
        assert abs(one(spark.range(1).select(core.norm_ppf(F.lit(u)).alias("z"))).z - NormalDist().inv_cdf(u)) < 1e-7


@pytest.mark.parametrize(("ps", "hit"), [([0.001] + [0.9] * 10, True), ([0.5] * 11, False), ([0.03] + [0.9] * 10, False)])
def test_benjamini_hochberg(spark, ps, hit):
    df = spark.createDataFrame([(1, p) for p in ps], "g int, ks_pvalue double")
    assert one(ecdf.benjamini_hochberg(df, "g")).bh_any is hit


def scored(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


def test_ranking_metrics(spark):
    perfect = scored(spark, [(0, 0.4 * i / 49) for i in range(50)] + [(1, 0.6 + 0.4 * i / 49) for i in range(50)])
    r = one(metrics.ranking(perfect))
    assert r.auc == 1.0 and r.ks == 1.0
    half = scored(spark, [(1, 0.9)] * 50 + [(1, 0.1)] * 50 + [(0, 0.1)] * 100)
    r = one(metrics.ranking(half))
    assert r.ks == 0.5 and r.ks_threshold == 0.9 and r.auc == 0.75
    assert one(metrics.ranking(scored(spark, [(0, 0.5), (1, 0.5)] * 100))).auc == 0.5
    base = one(metrics.batch_metrics(scored(spark, [(1, 0.0668)] * 668 + [(0, 0.0668)] * 9332)))
    assert abs(base.brier - 0.0623) < 1e-4 and abs(base.calibration_gap) < 1e-9
    assert one(metrics.ranking(scored(spark, [(1, 0.3)]))).auc is None


@pytest.mark.parametrize(("k", "n"), [(0, 10), (1, 10), (5, 10), (9, 10), (10, 10), (80, 781), (2, 80)])
def test_wilson_contains(spark, k, n):
    low, high = core.wilson(F.lit(k), F.lit(n))
    r = one(spark.range(1).select(low.alias("a"), high.alias("b")))
    assert 0 <= r.a <= k / n <= r.b <= 1
    low, _ = core.wilson(F.lit(0), F.lit(0))
    assert one(spark.range(1).select(low.alias("a"))).a is None


def test_bands(spark):
    ages = {17: None, 18: "18-25", 25: "18-25", 26: "26-35", 65: "56-65", 66: "66+", 109: "66+"}
    for age, band in ages.items():
        assert one(spark.range(1).select(fairness.band_of(F.lit(age)).alias("b"))).b == band
    rows = [(b[0], int(i % 10 == 0), 0.9 if i % 10 == 0 else 0.1) for b in fairness.BANDS for i in range(2000)]
    table = fairness.band_table(spark.createDataFrame(rows, "band string, y int, p double"), 0.5)
    r = one(fairness.fairness_criteria(table))
    assert r.demographic_parity == 0 and r.equalized_odds == 0 and r.base_rate_spread == 0 and r.bands == 6
    small = spark.createDataFrame([("18-25", 1, 0.9)] * 30, "band string, y int, p double")
    with pytest.raises(ValueError):
        fairness.fairness_criteria(fairness.band_table(small, 0.5))


CASES = [
    # degraded with an alarm in the same months
    ({1: 0.0, 2: -0.5, 3: -0.75}, {2, 3}, 1, -0.25, [2, 3], [], 0),
    # no alarm at all: blind until the labels of the first bad month are there
    ({1: 0.1, 2: -0.3, 3: -0.4, 4: -0.5, 5: -0.6}, set(), 3, -0.25, [2, 3, 4, 5], [2, 3, 4], -3),
    # the alarm comes after the first bad month but before its labels
    ({1: -0.3, 2: -0.4, 3: -0.4}, {2}, 4, -0.25, [1, 2, 3], [1, 3], -1),
    # an early alarm leads
    ({1: 0.0, 2: 0.0, 8: -0.9}, {2}, 2, -0.25, [8], [8], 6),
    # alarms without any bad month
    ({1: 0.2, 2: 0.3}, {1}, 2, -0.25, [], [], None),
    # the threshold itself counts as bad, just above it does not
    ({4: -0.25, 5: -0.2499}, {4}, 2, -0.25, [4], [], 0),
]


@pytest.mark.parametrize(("gaps", "alarms", "lag", "threshold", "degraded", "blind", "lead"), CASES)
def test_blind_window(spark, gaps, alarms, lag, threshold, degraded, blind, lead):
    df = spark.createDataFrame([("s", m, g, m in alarms) for m, g in gaps.items()], "scenario string, month int, gap double, alarm boolean")
    r = one(monitor.blind_windows(df, lag, threshold))
    assert (r.degraded_months, r.blind_months, r.lead_time_months) == (degraded, blind, lead)


def test_alert_scenarios(spark):
    drift = spark.createDataFrame([("m", "6", "low_gain", 0.4, 0.01), ("m", "6", "high_gain", 0.5, 0.6), ("q", "6", "x", 0.001, 0.9)], "scenario string, batch_id string, feature string, psi double, gain_share double")
    kinds = "scenario string, batch_id string, contract_stage int, sample_sufficient int, prediction_psi double, calibration_gap double, auc double, pending int"
    batches = spark.createDataFrame([("stress", "6", 1, 1, 0.004, -0.5, 0.6, 0), ("dirty", "1", 0, 1, None, None, None, 0), ("skip", "1", -1, 0, None, None, None, 0), ("late", "1", 1, 1, 0.001, None, None, 1), ("late", "2", 1, 1, 0.001, None, None, 1)], kinds)
    got = {(r.alert, r.scenario, r.feature, r.value) for r in monitor.alerts(drift, batches).collect()}
    assert got == {("FeatureDrift", "m", "low_gain", 0.4), ("FeatureDriftCritical", "m", "high_gain", 0.5), ("CalibrationGapBreach", "stress", None, -0.5), ("AUCDrop", "stress", None, 0.6), ("ContractBlocked", "dirty", None, 0.0), ("InsufficientSample", "skip", None, 0.0), ("LabelsPending", "late", None, 2.0)}


def test_simulation_parts(spark):
    df = frame(spark).withColumn(INCOME_MISSING, F.lit(0).cast("tinyint"))
    up = one(simulate.inflate(df, 1.1).agg(F.sum(INCOME).alias("s")))
    assert abs(up.s / one(df.agg(F.sum(INCOME).alias("s"))).s - 1.1) < 1e-9
    flips = simulate.stress_labels(df.withColumn("u", F.lit(0.9)), "u", 1.0, 0.5, "z")
    assert flips.where("flipped = 1").count() > 0 and flips.where((F.col(TARGET) == "0") & (F.col("flipped") == 1)).count() == 0
    assert simulate.lagged(2, 2, 6) == 0 and simulate.lagged(6, 2, 6) == 1 and simulate.intensity(3, 6) == 0.5
    xy = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 20).cast("double").alias("x"), ((F.col("id") % 20) * 2 + F.col("id") % 3).cast("double").alias("y"))
    out, before, after = simulate.invert_dependence(xy, "x", "y", "t", steps=8)
    assert before > 0.9 and abs(before + after) < 0.1
    assert all(r.equal for r in simulate.multisets_match(xy, out, ["x", "y"]).collect())


def test_kernel_statistics(spark):
    import numpy as np

    g = np.random.default_rng(1)
    x, y = g.normal(size=(60, 3)), g.normal(size=(60, 3)) + 2
    h = mmd.median_bandwidth(x)
    value, p, _ = mmd.permutation_test(x, y, h, 99, 0)
    k = lambda a, b: mmd.rbf(a, b, h).sum()
    assert abs(value - mmd.unbiased(k(x, x), k(y, y), k(x, y), 60, 60)) < 1e-9 and p == 0.01
    rows = [("t", bool(c), i, [float(v) for v in r]) for c, m in ((0, x), (1, y)) for i, r in enumerate(m)]
    r = one(mmd.mmd_tests(spark.createDataFrame(rows, "test string, current boolean, key long, x array<double>"), 99))
    assert r.detected and abs(r.mmd2 - value) < 1e-9


def test_guards(spark):
    with pytest.raises(models.LabelLeakageError):
        models.guard_features(frame(spark))
    with pytest.raises(KeyError):
        models.guard_features(frame(spark).drop(TARGET))
    with pytest.raises(ValueError):
        sinks.write_events(spark.range(1).select(F.lit(30).alias("age")), "/nowhere")


def test_sinks_round_trip(spark, tmp_path):
    df = frame(spark).withColumn(INCOME_MISSING, F.lit(0).cast("tinyint")).withColumn("scenario", F.lit("s")).withColumn("month", F.lit(1))
    sinks.write_batch(df, F.lit(0.5), str(tmp_path / "b"))
    assert sinks.load_batch(spark, str(tmp_path / "b")).count() == 40
    df.where("row_id < 39").select("scenario", "month", "row_id", TARGET).write.partitionBy("scenario", "month").mode("overwrite").parquet(str(tmp_path / "b/labels"))
    with pytest.raises(ValueError):
        sinks.load_batch(spark, str(tmp_path / "b"))
    m = spark.createDataFrame([("j", "s", "1", "auc", 0.5), ("j", "s", "2", "auc", 0.6)], "job string, scenario string, batch_id string, metric string, value double")
    sinks.write_metric_groups(m, str(tmp_path / "m"))
    sinks.write_metric_groups(m.where("batch_id = '1'").withColumn("value", F.lit(0.9)), str(tmp_path / "m"))
    assert {(r.batch_id, r.value) for r in spark.read.schema(m.schema).parquet(str(tmp_path / "m")).collect()} == {("1", 0.9), ("2", 0.6)}
    assert sinks.verified(spark, str(tmp_path / "m/*/*/*"), None) == "adopted"
    assert sinks.upsert_section("a", "m", "x") == sinks.upsert_section(sinks.upsert_section("a", "m", "y"), "m", "x")


def test_profile_edges(spark):
    df = spark.createDataFrame([Row(a=1.0, b=None), Row(a=None, b=2.0), Row(a=1.0, b=None)], "a double, b double")
    got = {r["column"]: r.nulls for r in profile.null_profile(df, ["a", "b"]).collect()}
    assert got == {"a": 1, "b": 2, "<any>": 3}
    assert one(profile.duplicate_counts(df, ["a", "b"])).duplicates == 1
    assert profile.null_profile(df.limit(0), ["a"]).collect()[0].nulls == 0
    assert math.isclose(one(profile.describe(profile.to_long(df, ["a"]))).mean, 1.0)


def test_mmd_permutation_reads_the_whole_table(spark, tmp_path):
    import numpy as np

    from gaugemill.plans.drift_queries import mmd_permutation

    g = np.random.default_rng(9)
    rows = [(5000 + i, (g.normal(size=4) + 3 * (i % 5 == 4)).tolist(), i % 5) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.test: r for r in mmd_permutation(spark, str(tmp_path)).collect()}
    assert sorted(got) == [f"label-{k}" for k in range(5)] and got["label-4"].detected
    assert all(r.m == 60 and r.n == 200 for r in got.values())


def test_copula_inverts_a_drawn_batch(spark, tmp_path, monkeypatch):
    from gaugemill.plans import monitor_queries as q

    rows = spark.range(9000).select(F.col("id").alias("row_id"), F.lit(1).alias("NumberRealEstateLoansOrLines"), F.lit(2).alias("NumberOfOpenCreditLinesAndLoans"))
    monkeypatch.setattr(q, "credit", lambda *_: rows)
    monkeypatch.setattr(q, "clean", lambda df: df)
    monkeypatch.setattr(q.SIM, "invert_dependence", lambda df, *a, **k: (df, 0.0, 0.0))
    ids = [r.row_id for r in q._copula(spark, str(tmp_path))[0].collect()]
    assert len(set(ids)) == 7368 and max(ids) > 8900


def test_bandwidth_draws_from_all_rows():
    import numpy as np

    assert mmd.median_bandwidth(np.arange(6000.0)[:, None]) > 1500  # the first 2000 give under 600


def test_mmd_blocks_read_every_row(spark):
    import numpy as np

    from gaugemill.functions.core import hash_uniform

    g = np.random.default_rng(4)
    rows = [(i % 3 == 0, i, g.normal(size=3).tolist()) for i in range(400)]
    df = spark.createDataFrame([*rows, (True, 900, None), (False, 901, [1.0, None, 2.0])], "current boolean, key long, x array<double>")
    at = {r.key: int(r.u * 4) for r in df.select("key", hash_uniform("mmd-block", "key").alias("u")).collect()}

    def brute(keep):
        x, y = (np.array([v for cur, k, v in rows if cur == side and keep(k)]) for side in (False, True))
        k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / 4.5)
        n, m = len(x), len(y)
        return (k(x, x).sum() - n) / (n * (n - 1)) + (k(y, y).sum() - m) / (m * (m - 1)) - 2 * k(x, y).mean()

    all_pairs, four, empty = one(mmd.mmd2_blocks(df, 1.5)), one(mmd.mmd2_blocks(df, 1.5, 100)), one(mmd.mmd2_blocks(df.limit(0), 1.5))
    assert (all_pairs.n, all_pairs.m, all_pairs.blocks) == (266, 134, 1) and math.isclose(all_pairs.mmd2, brute(lambda k: True), abs_tol=1e-12)
    assert (four.n, four.m, four.blocks) == (266, 134, 4) and math.isclose(four.mmd2, np.mean([brute(lambda k, b=b: at[k] == b) for b in range(4)]), abs_tol=1e-12)
    assert (empty.mmd2, empty.n, empty.m, empty.blocks) == (None, 0, 0, 0)
