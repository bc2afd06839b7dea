import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from conftest import hourly_pandas, to_spark
from loadloom.config import Battery
from loadloom.operators import scan, storage
from loadloom.operators.pieces import Pieces

BATTERY = Battery(cost=1.0)


def one_by_one(zones, most, low, high, soc, battery):
    """The dispatch rule, hour by hour."""
    out = []
    for zone, d in zip(zones, most):
        if zone == "night" and soc < high - storage.SLACK:
            soc += min(battery.max_power, high - soc)
        elif zone == "peak" and soc > low + storage.SLACK:
            soc -= min(d, soc - low)
        soc = min(max(soc, 0.0), battery.capacity)
        out.append(soc)
    return out


def columns(zones, load, low, high):
    n = len(zones)
    return {"zone": np.array(zones, dtype=object), "load": np.array(load, float),
            "soc_low": np.full(n, low), "soc_high": np.full(n, high)}


hours = st.lists(st.tuples(st.sampled_from(["night", "peak", "day"]), st.floats(-3.0, 200.0)), min_size=1, max_size=60)


@given(hours, st.floats(0.0, 0.45), st.floats(0.5, 1.0), st.floats(0.0, 1.0), st.booleans(), st.sampled_from([0.05, 7.0, 75.0]))
@settings(max_examples=200, deadline=None)
def test_map_and_lanes_equal_the_rule(rows, low, high, start, cap, power):
    battery = Battery(cost=1.0, max_power=power)
    low, high, soc = low * battery.capacity, high * battery.capacity, start * battery.capacity
    zones, load = zip(*rows)
    most = [min(power, x / np.sqrt(battery.efficiency)) if cap else power for x in load]
    want = one_by_one(zones, most, low, high, soc, battery)
    table = columns(zones, load, low, high)
    made, end = storage._dispatch_step(battery, cap)(table, soc)
    assert list(made["soc"]) == want and end == want[-1]
    assert list(made["soc_before"]) == [soc, *want[:-1]]
    # The map moves states by sums of distances, the rule by one after the other: equal up to rounding, and
    # where the rounding decides whether the battery rests, up to the slack.
    assert storage._dispatch_map(battery, cap)(table)(soc) == pytest.approx(want[-1], abs=storage.SLACK + 1e-6)


@given(st.lists(st.tuples(st.sampled_from(["night", "peak", "day"]), st.integers(0, 90)), min_size=1, max_size=60),
       st.integers(0, 300))
@settings(max_examples=200, deadline=None)
def test_map_is_exact_in_whole_numbers(rows, soc):
    battery = Battery(cost=1.0, max_power=64.0, efficiency=1.0)
    zones, load = zip(*rows)
    most = [min(64.0, float(x)) for x in load]
    want = one_by_one(zones, most, 32.0, 256.0, float(soc), battery)
    assert storage._dispatch_map(battery, True)(columns(zones, load, 32.0, 256.0))(float(soc)) == want[-1]


def test_map_meets_in_one_state_after_a_full_cycle():
    zones = ["night"] * 8 + ["peak"] * 8
    made = storage._dispatch_map(BATTERY, False)(columns(zones, [1e9] * 16, 30.0, 270.0))
    assert made.constant == 30.0


def test_composition():
    up = Pieces(((0.0, False, 3.0), (7.0, True, 10.0)), 10.0)
    down = Pieces(((0.0, True, 0.0), (4.0, False, -4.0)), 10.0)
    both = up.then(down)
    for s in np.linspace(0, 10, 41):
        assert both(s) == down(up(s))
    assert Pieces.identity(0.0, 10.0).then(up).pieces == up.pieces


@pytest.mark.parametrize("cap", [False, True])
def test_chunks_equal_one_chunk_and_nothing_is_repeated(spark, monkeypatch, cap):
    monkeypatch.setattr(scan, "_settle", None)
    df = to_spark(spark, hourly_pandas(40))
    order = ["series_id", "strategy", "pos"]
    whole = storage.dispatch(df, BATTERY, cap_to_demand=cap).toPandas().sort_values(order, ignore_index=True)
    parts = storage.dispatch(df, BATTERY, cap_to_demand=cap, chunk_rows=100).toPandas().sort_values(order, ignore_index=True)
    assert len(whole) == 2 * 3 * 960
    for c in ("soc_before", "soc", "charged", "discharged", "grid_kwh"):
        np.testing.assert_array_equal(whole[c], parts[c])
