"""Draws and the false-alarm calibration against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugemill.operators import ecdf, psi, studies
from gaugemill.operators.sampling import draws


@pytest.mark.parametrize("rows", [0, 1, 2, 7, 90, 101])
def test_draws_are_without_replacement_and_exact(spark, rows):
    df = spark.range(rows).withColumn("x", F.col("id") * 2)
    got: dict = {}
    for r in draws(df, [1, 5, 100], 6, "s", "id").collect():
        assert r.x == 2 * r.id
        got.setdefault((r.n, r.repeat), []).append(r.id)
    assert sorted(got) == [(n, r) for n in (1, 5, 100) for r in range(6) if rows]
    for (n, _), ids in got.items():
        assert len(ids) == len(set(ids)) == min(n, rows)
    again = {(r.n, r.repeat, r.id) for r in draws(df.repartition(5), [1, 5, 100], 6, "s", "id").collect()}
    assert again == {(n, r, i) for (n, r), ids in got.items() for i in ids}


def test_draws_take_every_row_about_as_often(spark):
    n, rows, repeats = 20, 200, 400
    counts = {r.id: r["count"] for r in draws(spark.range(rows), [n], repeats, "even", "id").groupBy("id").count().collect()}
    mean = n * repeats / rows
    assert len(counts) == rows and max(abs(v - mean) for v in counts.values()) < 6 * math.sqrt(mean)


def ks(a, b):
    at = sorted({*a, *b})
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in at)


def test_lookup_ks_is_the_largest_gap_of_the_two_distributions(spark):
    rng = random.Random(3)
    ref = [rng.choice([1.0, 2.0, 2.5, 4.0, 7.0, 9.0]) for _ in range(60)]
    parts = {"same": ref[:20], "low": [-1.0, 0.0], "high": [20.0], "between": [2.2, 3.0, 3.0, 8.0], "mixed": [0.0, 2.0, 2.1, 9.0, 9.5]}
    long = lambda rows: spark.createDataFrame(rows, "part string, feature string, value double")
    cur = long([(p, "f", v) for p, vs in parts.items() for v in vs] + [("same", "f", None), ("same", "unknown", 1.0)])
    got = {r.part: (r.n_ref, r.n_cur, r.ks) for r in ecdf.ks_two_sample(long([("", "f", v) for v in [*ref, None]]).drop("part"), cur, "part").collect()}
    assert got.keys() == parts.keys()
    for p, vs in parts.items():
        assert got[p][:2] == (60, len(vs)) and abs(got[p][2] - ks(ref, vs)) < 1e-12


def test_false_alarms_equal_the_tests_of_each_draw(spark):
    rng = random.Random(4)
    rows = lambda k: [(f"{k}{i}", rng.gauss(0, 1), float(rng.randint(0, 3)), None if i % 9 == 0 else float(rng.randint(0, 200))) for i in range(300)]
    schema, names = "k string, a double, b double, c double", ["a", "b", "c"]
    ref, held = spark.createDataFrame(rows("r"), schema), spark.createDataFrame(rows("h"), schema)
    found = {(r.n, r.repeat, r.feature): r for r in studies.false_alarms(ref, held, names, [40, 1000], 3).collect()}
    stack = F.expr("stack(3, 'a', a, 'b', b, 'c', c) AS (feature, value)")
    drawn = draws(held, [40, 1000], 3, "aa", "k").select("n", "repeat", stack).persist()
    want_ks = {(r.n, r.repeat, r.feature): r for r in ecdf.ks_two_sample(ref.select(stack), drawn, "n", "repeat").collect()}
    want_psi = {(r.n, r.repeat, r.feature): r.psi for r in psi.psi(ref.select(stack), drawn, "n", "repeat").collect()}
    drawn.unpersist()
    assert found.keys() == want_ks.keys() == want_psi.keys() and len(found) == 18
    for k, r in found.items():
        assert abs(r.ks_statistic - want_ks[k].ks) < 1e-12 and abs(r.ks_pvalue - want_ks[k].pvalue) < 1e-9 and abs(r.psi - want_psi[k]) < 1e-9


def test_ordinal_ranks_equal_a_sort(spark):
    from gaugemill.operators.sampling import ordinal_rank

    rng = random.Random(9)
    for rows in ([], [(5, None)], [(i, rng.choice([0.0, 0.0, 0.0, 1.0, 2.5, None, float(rng.randint(0, 400))])) for i in range(900)]):
        df = spark.createDataFrame(rows, "row_id long, x double")
        want = {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0])))}
        assert {r.row_id: r.place for r in ordinal_rank(df, "x", "row_id", "place", 16).collect()} == want
        named = df.withColumn("row_id", F.format_string("%05d", "row_id"))  # a key that is no number
        assert {int(r.row_id): r.place for r in ordinal_rank(named, "x", "row_id", "place", 16).collect()} == want


def test_a_frequent_value_is_in_many_bins(spark):
    from gaugemill.operators.sampling import ordinal_rank

    df = spark.range(4000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(7)).cast("double").alias("x"))
    plan = ordinal_rank(df, "x", "row_id", "place", 16)
    assert plan.agg(F.count_distinct("place"), F.max("place")).first() == (4000, 4000)
    cuts = df.agg(F.percentile_approx("row_id", [i / 16 for i in range(1, 16)])).first()[0]
    assert len(set(cuts)) == 15  # what the rows of the value 7 are cut at


def test_rates_do_not_hang_on_a_kept_result(spark, sf_dir, monkeypatch):
    from gaugemill.plans import drift_queries, report_queries

    def refuse(*_):
        raise AssertionError("reads what another query may have kept")

    monkeypatch.setattr(drift_queries, "cached", refuse)
    assert [r.kind for r in report_queries.report_ks_by_type(spark, sf_dir).orderBy("kind").collect()] == ["continuous", "count"]


def test_draws_need_no_window_over_their_tries(spark):
    df = spark.range(1000)  # the next prime is 1009, so some places fall out
    drawn = draws(df, [20, 1000], 5, "s", "id")
    assert "windowspecdefinition(n#" not in drawn._jdf.queryExecution().executedPlan().toString()
    assert {r.n: r["count"] for r in drawn.groupBy("n").count().collect()} == {20: 100, 1000: 5000}


@pytest.mark.parametrize("share", [0.0, 1e-9, 0.3, 0.5, 0.7, 1.0])
def test_digits_below_a_share_are_numbers_below_it(spark, share):
    from gaugemill.functions.core import hash_below, hash_uniform

    rows = spark.range(3000)
    assert rows.where(hash_below(share, "s", "id") != (hash_uniform("s", "id") < share)).count() == 0
