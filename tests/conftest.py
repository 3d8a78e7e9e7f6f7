import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyward.operators import settling  # noqa: E402
from tallyward.session import local_session  # noqa: E402

SMALL_TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("8", shuffle_partitions=4, app="tests")


@pytest.fixture(params=["small", "large"])
def path_taken(request, monkeypatch):
    """Every test using this runs on the small-table path and on the one a large table takes."""
    if request.param == "large":
        monkeypatch.setattr(settling, "SMALL_ROWS", 0)
    return request.param


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
