"""Every query builds and agrees with its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import compare, connect

NAMES = list(entry.oracle_sql())


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, folder, name):
    got = entry.queries()[name](spark, folder).toArrow()
    assert compare(got, con.sql(entry.oracle_sql()[name]).to_arrow_table()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() == 15
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["gbt_forecast", "boosted_depth_forecast", "quantile_forecast", "feature_importance", "score_all_series", "scoring_run"])
def test_boosted_queries_use_the_default_rounds(spark, folder, name, monkeypatch):
    from shelfcast.operators.models import GbtForecaster

    asked = []

    class Stop(Exception):
        pass

    def fit(self, *args):
        asked.append(self.max_iter)
        raise Stop

    monkeypatch.setattr(GbtForecaster, "fit", fit)
    with pytest.raises(Stop):
        entry.queries()[name](spark, folder)
    assert asked == [100]


def test_tuning_query_has_no_time_budget(spark, folder, monkeypatch):
    from shelfcast.operators import tuning

    asked = []

    class Stop(Exception):
        pass

    def search(panel, candidates, data, make, budget_sec):
        asked.append((len(candidates), budget_sec))
        raise Stop

    monkeypatch.setattr(tuning, "_search", search)
    with pytest.raises(Stop):
        entry.queries()["tune_seasonal_ar"](spark, folder)
    assert asked == [(20, float("inf"))]
