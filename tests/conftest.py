import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from helpers import D  # noqa: E402
from ledgerflow.session import local_session  # noqa: E402

TX = "user_id long, date timestamp_ntz, brand string, amount double"


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, shuffle_partitions=8, app="ledgerflow-tests")
    yield s


@pytest.fixture
def tx(spark):
    def make(rows):
        return spark.createDataFrame(
            [(u, D(d) if isinstance(d, str) else d, b, None if a is None else float(a)) for u, d, b, a in rows], TX)
    return make
