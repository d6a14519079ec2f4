import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfcast.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", partitions=4)
    yield s
    s.stop()


@pytest.fixture
def days():
    """n consecutive days from 2023-01-01."""
    return lambda n, start=dt.date(2023, 1, 1): [start + dt.timedelta(days=i) for i in range(n)]


@pytest.fixture
def series(spark, days):
    """One series from a list of sales, with optional further columns."""

    def make(sales, store="S1", item="I1", **more):
        names = ["date", "store_id", "item_id", "sales", *more]
        rows = [(d, store, item, None if v is None else float(v), *(more[c][i] for c in more)) for i, (d, v) in enumerate(zip(days(len(sales)), sales))]
        kinds = {"on_promo": "int", "price": "double", "temperature": "double", "precipitation": "double", "holiday_name": "string"}
        schema = "date date, store_id string, item_id string, sales double" + "".join(f", {c} {kinds.get(c, 'double')}" for c in more)
        assert len(names) == 4 + len(more)
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
