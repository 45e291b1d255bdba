import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from jobtally.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "jobtally-tests", "6g")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples, columns in order."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(row) for row in picked.collect()), key=repr)

    return collect


POLL_1 = """job_stats:
- job_id:          dd.0.n1
  snapshot_time:   1700000010.123456789
  start_time:      1700000000.1
  elapsed_time:    10.0
  read_bytes:      { samples:           3, unit: bytes, min:    4096, max: 4194304, sum: 9000, hist: { 4K: 1, 4M: 2 } }
  write:           { samples:           5, unit: usecs, min: 1, max: 9, sum: 20, sumsq: 80 }
  open:            { samples:           0, unit:  usecs }
- job_id:          cp.0.n2
  snapshot_time:   1700000011
  getattr:         { samples: 7, unit: reqs }
"""

POLL_2 = """job_stats:
- job_id:          dd.0.n1
  snapshot_time:   1700000020.9
  write:           { samples: 35, unit: usecs }
- job_id:          new.1.n3
  snapshot_time:   1700000020
  open:            { samples: 4, unit: reqs }
"""

TIME_1 = "2024-01-01T00:00:00.123456789+00:00"
TIME_2 = "2024-01-01T00:00:10+00:00"


def framed(host, param, time, dump):
    return f"### HOST: {host} | PARAM: {param} | TIMESTAMP: {time} ###\n{dump}\n### END ###\n\n"


@pytest.fixture
def golden_log(tmp_path):
    text = (
        framed("oss1", "obdfilter.x.job_stats", TIME_1, POLL_1)
        + framed("mds1", "mdt.x.job_stats", TIME_1, POLL_1)
        + framed("oss1", "obdfilter.x.job_stats", TIME_2, POLL_2)
    )
    path = tmp_path / "golden.raw.log"
    path.write_text(text)
    return str(path)
