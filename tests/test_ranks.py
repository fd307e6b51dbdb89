"""Running totals, percentiles and lookups that leave no group in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugemill.operators import metrics, profile, psi, ranks, sampling


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def long(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.normal(size=3000)] + [("b", float(x)) for x in rng.integers(0, 7, 2000)] + [("a", None), ("c", 4.0)]
    return spark.createDataFrame(rows, "feature string, value double"), rows


def test_running_totals_over_many_bins(long, monkeypatch):
    monkeypatch.setattr(ranks, "VALUES_PER_BIN", 50)
    df, rows = long
    out = ranks.running(ranks.counted(df), "feature")
    got = {(r.feature, r.value): (r._n_before, r._n, r._n_all) for r in out.collect()}
    for f in "abc":
        v = np.array([x for g, x in rows if g == f and x is not None])
        want = {(f, x): (int((v < x).sum()), int((v == x).sum()), len(v)) for x in set(v.tolist())}
        assert want == {k: x for k, x in got.items() if k[0] == f}


def test_percentiles_equal_those_of_the_aggregate(long, monkeypatch):
    monkeypatch.setattr(ranks, "VALUES_PER_BIN", 50)
    df, _ = long
    points = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    got = {r.feature: r.q for r in ranks.percentiles(ranks.counted(df), points, "feature").collect()}
    want = {r.feature: r.q for r in df.groupBy("feature").agg(F.percentile("value", F.array(*map(F.lit, points))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[f], want[f], rtol=1e-14) for f in want)


def test_profiles_and_edges_gather_no_feature(long):
    df, _ = long
    for out in (profile.describe(df), psi.fit_edges(df)):
        assert "percentile(" not in plan(out)


def test_ranking_windows_are_by_bin(spark):
    out = metrics.ranking(spark.createDataFrame([(1, 0.3), (0, 0.2), (1, 0.2)], "y int, p double"))
    assert "_bin" in plan(out) and out.first().auc == pytest.approx(0.75)


def test_draws_are_not_broadcast(spark):
    drawn = sampling.draws(spark.range(1000), [20], 3, "s", "id")
    assert "BroadcastHashJoin [_place" not in plan(drawn) and drawn.count() == 60


def test_lookup_of_hot_and_other_values(spark, monkeypatch):
    monkeypatch.setattr(ranks, "HOT", 10)
    rows = spark.createDataFrame([(i, "f", 0.0 if i % 2 else float(i)) for i in range(100)], "id int, feature string, value double")
    table = rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("hits")).withColumn("u", F.col("value") * 2).where("value < 90")
    got = sorted((r.id, r.u) for r in ranks.looked_up(rows, table, "hits").collect())
    assert got == [(i, 0.0 if i % 2 else 2.0 * i) for i in range(100) if i % 2 or i < 90]


def test_split_rows_are_binned_without_counting_values(spark):
    ref = spark.createDataFrame([("f", float(x)) for x in range(100)], "feature string, value double")
    cur = spark.createDataFrame([(m, "f", float(x)) for m in ("a", "b") for x in [*range(50), *range(40)]] + [("a", "f", None), ("b", "f", float("nan"))], "month string, feature string, value double")
    edges = psi.fit_edges(ref)
    fast = {tuple(r) for r in psi.binned(cur, edges, "month", most=30).collect()}
    assert fast == {tuple(r) for r in psi.binned(cur, edges, "month").collect()}
    assert "value" not in plan(psi.binned(cur, edges, "month", most=30)).split("Exchange hashpartitioning(month", 1)[1].split("]")[0]
