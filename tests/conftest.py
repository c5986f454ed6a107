import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from caseflow.session import get_session
    s = get_session("local[4]", 4, app_name="caseflow-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="caseflow-test-ckpt-"))
    yield s
    s.stop()


T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def ts(sec):
    return None if sec is None else T0 + dt.timedelta(seconds=sec)


@pytest.fixture
def make_log(spark):
    """rows: (case_id, activity, seconds, index, *attrs); extra column names in ``attrs``."""
    def _make(rows, attrs=(), types=()):
        cols = ["case_id string", "activity string", "timestamp timestamp", "_event_index bigint"]
        cols += [f"`{a}` {t}" for a, t in zip(attrs, types or ["string"] * len(attrs))]
        data = [(r[0], r[1], ts(r[2]), r[3], *r[4:]) for r in rows]
        return spark.createDataFrame(data, ", ".join(cols))
    return _make
