"""The ablation from tables, and the whole number of trees."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gaugemill.operators import ecdf, models, simulate
from gaugemill.plans import catalogue
from gaugemill.sources.tables import DEBT_RATIO, INCOME, INCOME_MISSING, TARGET


def test_batches_drawn_once_give_the_rows_of_all_arms(spark):
    z = [F.sin(F.col("row_id") * k).alias(f"z_{n}") for k, n in enumerate(("util", "age", "d30", "d60", "d90"), 1)]
    pool = spark.range(60).withColumnRenamed("id", "row_id").select(
        "row_id", F.when(F.col("row_id") % 5 == 0, "1").otherwise("0").alias(TARGET), ((F.col("row_id") + 0.5) / 60).alias("u_util"), (F.col("row_id") * 100.0).alias(INCOME), F.lit(0.4).alias(DEBT_RATIO), (F.col("row_id") % 3 == 0).cast("int").alias(INCOME_MISSING), *z,
    )
    cfg = simulate.SimulationConfig(batch_rows=20, n_months=1, stress_extra=0.4)
    want = simulate.simulate_arms(pool, cfg)
    got = simulate.simulate_drawn(simulate.draw_arms(pool, cfg).localCheckpoint(), cfg)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_midranks_of_the_fitted_rows(spark):
    rows = spark.range(40).select(F.col("id").alias("row_id"), F.when(F.col("id") < 20, "a").otherwise("b").alias("feature"), (F.col("id") % 7).cast("double").alias("value"))
    fitted = ecdf.fit_ecdf(rows.drop("row_id"))
    as_set = lambda df: {tuple(r) for r in df.select("row_id", "feature", "value", "u").collect()}
    assert as_set(ecdf.midrank_of_own(rows, fitted, "row_id")) == as_set(ecdf.midrank(rows, fitted, "row_id"))


def test_ablation_keeps_no_plan_of_what_is_before_it(spark, sf_dir):
    out = catalogue.queries()["ablation_metrics"](spark, sf_dir)
    assert "InMemoryRelation" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.select("scenario", "month").distinct().count() == 16


@pytest.mark.parametrize("name", ["impact_from_model", "seed_refits"])
def test_boosted_candidate_has_all_its_trees(name, spark, sf_dir, monkeypatch):
    """Only the number that is asked for is tested here; two trees are fitted."""
    asked, fitted = [], models._boosted
    monkeypatch.setattr(models, "_boosted", lambda seed, trees: asked.append(trees) or fitted(seed, 2))
    assert catalogue.queries()[name](spark, sf_dir).count() > 0
    assert set(asked) == {400} and spark.sparkContext.getCheckpointDir()
