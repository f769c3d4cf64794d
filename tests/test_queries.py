import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from sqlcheck import DATA, same  # noqa: E402

from quadmill.queries import ORACLES, QUERIES, mixed_features  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(QUERIES[name](spark, DATA), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_plans_have_no_cross_join_and_prune_columns(spark):
    plan = QUERIES["tiles_of_box"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "props" not in plan and "event_type" not in plan


def test_whole_job_reads_the_box_of_every_event(spark):
    ids = lambda df, c: sorted(r[0] for r in df.select(c).collect())
    assert ids(mixed_features(spark, DATA).where("kind = 'box'"), "num") == ids(spark.read.parquet(f"{DATA}/events.parquet"), "event_id")
