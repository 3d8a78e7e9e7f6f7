"""A cross-section of the check queries on the smallest tables; ``tools/check.py`` runs them all."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as driver  # noqa: E402
import check  # noqa: E402

from .conftest import SMALL_TABLES  # noqa: E402

SAMPLE = [
    "canonical_projection", "null_profile", "clean_records", "selected_quantiles", "rule_target_rate", "explanations",
    "psi_by_feature", "chi_squared", "group_forecast", "regression_leave_one_out", "risk_history", "alert_dedupe",
    "run_partitions", "known_files", "rollback_target", "champions", "stratified_folds",
]


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL_TABLES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, con, name):
    verdict = check.compare(driver.queries()[name](spark, SMALL_TABLES), con, driver.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_entry_and_names(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
