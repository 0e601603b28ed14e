import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsloom.session import get_session  # noqa: E402

AS_OF = "2024-04-01 00:00:00"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[*]", app="newsloom-tests", shuffle_partitions=8)
    yield s


@pytest.fixture()
def tmp_dir(spark):
    from newsloom.session import scratch_path

    return scratch_path(spark, "test")
