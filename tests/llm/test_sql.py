import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from sqlcheck import DATA, same  # noqa: E402

from quadmill.llm.queries import ORACLES, QUERIES  # noqa: E402

NATIVE = ["op1_urls", "op2_decontamination", "op6_quality", "op8_mixing", "op10_licenses"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(QUERIES[name](spark, DATA), ORACLES[name])


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_run_no_python(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


@pytest.mark.parametrize("name", ["op2_decontamination", "op8_mixing", "op9_toxicity", "op3_simhash"])
def test_reruns_agree(spark, name):
    rows = lambda: sorted(map(str, QUERIES[name](spark, DATA).collect()))
    assert rows() == rows()
