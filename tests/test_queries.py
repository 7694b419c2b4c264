import pytest

import __spark_entry__ as entry
from splitframe.workload import ORACLES, QUERIES
from tests.check_oracles import compare, connect

# A spread of queries; ``python tests/check_oracles.py`` runs them all.
CHECKED = [
    "psi_join_duplicates",
    "psi_row_index",
    "psi_shares",
    "quantile_edges_lines",
    "bin_before_join",
    "gh_histogram",
    "best_split",
    "gbt_fit",
    "lr_fit",
    "svm_fit",
    "mat_mul",
    "batch_assign",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, name):
    assert compare(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLES) == {"quantile_edges_approx", "baseline_svm"}


def test_flagship(spark):
    assert entry.entry(spark).count() == 1
