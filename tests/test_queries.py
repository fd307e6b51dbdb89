"""Every registered query of the library proper against its SQL, or as a smoke run where it has none."""

import pytest

from gaugemill.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same):
    same(QUERIES[name], SQL[name])


#: The slowest are left to the driver's own run.
@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys() - {"ablation_metrics", "model_calibration"}))
def test_query_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["feature", "psi"]
