import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from codeweft.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", "local[4]", 4, **{"spark__sql__autoBroadcastJoinThreshold": "1m"})


@pytest.fixture
def frame(spark):
    """A frame from rows and a schema; works for no rows too."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
