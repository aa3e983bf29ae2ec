from __future__ import annotations

import datetime as dt
import itertools
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cartlane.session import build_session  # noqa: E402
from cartlane.sources.raw_events import RAW_EVENTS_SCHEMA  # noqa: E402
from cartlane.operators.events import normalize_events  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=8)
    yield s
    s.stop()


class Events:
    """Builder of raw-event micro fixtures: minutes since midnight UTC of the
    stored date (or an explicit micro timestamp), auto-increasing seq."""

    def __init__(self):
        self.rows = []
        self._seq = itertools.count(1)

    def add(self, user, name, minute=0.0, date="20240105", title=None, browser="Chrome",
            os_="Windows", rev=None, us=None, ts_date=None, seq=None):
        d = dt.datetime.strptime(ts_date or date, "%Y%m%d").replace(tzinfo=dt.timezone.utc)
        if us is None:
            us = int(d.timestamp()) * 1_000_000 + int(round(minute * 60_000_000))
        if rev is None and name == "purchase":
            rev = 10.0
        self.rows.append((user, name, title, date, us, browser, os_, rev, seq or next(self._seq)))
        return self

    def raw(self, spark):
        return spark.createDataFrame(self.rows, RAW_EVENTS_SCHEMA)

    def norm(self, spark):
        return normalize_events(self.raw(spark))


@pytest.fixture
def events():
    return Events()
