"""The registered searches fit every step ahead."""

import pytest

from loadloom.operators import sweep
from loadloom.plans import queries


class Fitted(Exception):
    pass


@pytest.mark.parametrize("name", ["ridge_grid_search", "history_sweep"])
def test_searches_fit_all_steps(spark, monkeypatch, name):
    def fit(kind, table, cfg, names, horizons=None, **params):
        raise Fitted(list(horizons or range(1, cfg.horizon + 1)))

    monkeypatch.setattr(sweep, "fit_forecaster", fit)
    with pytest.raises(Fitted) as steps:
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert steps.value.args[0] == list(range(1, queries.CFG.horizon + 1))
