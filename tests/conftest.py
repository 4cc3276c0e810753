"""Shared local session and the small panel of the unit tests."""

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidepanel.session import drop_saved, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    drop_saved(session)
    session.stop()


def day(n: int, start: str = "2017-01-01") -> dt.date:
    return dt.date.fromisoformat(start) + dt.timedelta(days=n)


def panel(spark, sales, family="A", store=1, start="2017-01-01"):
    rows = [(store, family, day(i, start), None if y is None else float(y), 0) for i, y in enumerate(sales)]
    return spark.createDataFrame(rows, "store_nbr int, family string, date date, sales double, onpromotion int")


def column(df, name, by="date"):
    return [r[name] for r in df.orderBy(by).collect()]


@pytest.fixture(scope="session")
def tiny_panel(spark):
    rows = [
        (1, f, day(i), float(i % 7 + 1), i % 5) for f in "AB" for i in range(40)
    ]
    return spark.createDataFrame(
        rows, "store_nbr int, family string, date date, sales double, onpromotion int"
    ).persist()
