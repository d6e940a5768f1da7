"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import check_oracle
import pytest

import __spark_entry__ as contract
from cubegraph.plans.registered import all_queries
from cubegraph.plans.registered.base import context

SF_DIR = "/root/testdata/sf0.001"
NAMES = list(all_queries())  # the other queries are tested beside their operators
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def outcomes(spark):
    """All comparisons, a few at a time: small queries are bound by planning, not by data."""
    con = check_oracle.connect(SF_DIR)
    tables = context(spark, SF_DIR)
    for name in ("star", "mart", "edges", "nearest", "graph", "reduced"):
        getattr(tables, name)

    def run(name):
        try:
            return check_oracle.compare(spark, con.cursor(), name, SF_DIR)
        except Exception as exc:
            return "ERROR", str(exc)

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(NAMES, pool.map(run, NAMES)))


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns[:2] == ["anio", "bimestre"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(NAMES))
def test_query_matches_its_sql(outcomes, name):
    status, note = outcomes[name]
    assert status in ("ok", "rows"), note


def test_sql_belongs_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(NAMES) <= set(contract.queries())
    assert set(NAMES) <= set(contract.oracle_sql())


def test_no_forbidden_calls():
    root = Path(check_oracle.__file__).resolve().parents[1] / "cubegraph"
    for path in root.rglob("*.py"):
        source = path.read_text(encoding="utf-8")
        assert not re.search(r"localCheckpoint|crossJoin|toPandas|\.rdd\b", source), path
