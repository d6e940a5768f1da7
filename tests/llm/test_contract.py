"""The registered queries against their SQL on the smallest tables."""

import check_oracle
import pytest

import __spark_entry__ as contract
from cubegraph.llm.registered import llm_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, q in llm_queries().items() if q.sql))
def test_query_matches_its_sql(spark, name):
    status, note = check_oracle.compare(spark, check_oracle.connect(SF_DIR), name, SF_DIR)
    assert status == "ok", note


def test_all_operators_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in llm_queries())
    assert numbers == list(range(1, 14))
    assert {"pipeline", *llm_queries()} <= set(contract.queries())
