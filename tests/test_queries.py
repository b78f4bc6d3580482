"""Every query of the engine against its SQL on the smallest tables."""

import pytest
from chronoloom.plans import queries as core
from helpers import same_rows


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    same_rows(core.QUERIES[name](spark, sf_dir), core.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert core.QUERIES[name](spark, sf_dir).schema.fieldNames()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from chronoloom.sources import archive
    from chronoloom.sources.workspace import work_path

    a = archive.Archive(spark, work_path(spark, "pushdown"))
    a.append(spark.createDataFrame([(0, 1, 7, 1.0, 2.0), (0, 1, 8, 1.5, 2.0)], "snapshot_seq long, ts long, item_id long, price double, quantity double"))
    plan = a.item(7).select("price")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(item_id,7)" in plan
    assert "quantity" not in plan.split("ReadSchema")[1]
