"""Daily partials: adding a day rewrites that day only, and the reports equal those over all events."""

import datetime as dt
import os

import pytest

from cartlane.config import DEFAULTS
from cartlane.operators import daily, duration, funnel, population, revenue
from cartlane.plans.catalog import normalized
from cartlane.plans.inspect import plan_text
from conftest import SF001, SF01

CUTOFF = dt.date(2024, 1, 25)


def _same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def _files(path):
    return {d: {f: os.stat(os.path.join(path, d, f)).st_mtime_ns for f in os.listdir(os.path.join(path, d)) if f.endswith("parquet")}
            for d in os.listdir(path) if d.startswith("event_date=")}


def test_refresh_by_day(spark, tmp_path):
    events, path = normalized(spark, SF001), str(tmp_path / "days")
    days = sorted(r[0] for r in events.select("event_date").distinct().collect())
    day = days[len(days) // 2]
    # All days but one, that one with half of its events; then the day is complete.
    daily.write_days(events.where(f"event_date <> DATE'{day}' OR event_seq % 2 = 0"), path)
    before = _files(path)
    assert len(before) == len(days)
    daily.write_days(events.where(f"event_date = DATE'{day}'"), path)
    after = _files(path)
    assert {d for d in after if after[d] != before.get(d)} == {f"event_date={day}"}
    held = daily.read_days(spark, path)
    _same(daily.purchase_duration(held, CUTOFF), duration.purchase_duration(events, CUTOFF))
    _same(daily.purchase_duration(held, CUTOFF, DEFAULTS.segment.keys), duration.purchase_duration_by(events, cutoff=CUTOFF))
    _same(daily.funnel_counts(held), funnel.funnel_counts(events))
    _same(daily.average_order_value(held, CUTOFF), revenue.average_order_value(events, CUTOFF))
    # A cutoff prunes days at the scan.
    assert "PartitionFilters: [isnotnull(event_date" in plan_text(daily.purchase_duration(held, CUTOFF))


def test_a_new_day_is_added(spark, tmp_path):
    events, path = normalized(spark, SF001), str(tmp_path / "days")
    days = sorted(r[0] for r in events.select("event_date").distinct().collect())
    daily.write_days(events.where(f"event_date < DATE'{days[-1]}'"), path)
    before = _files(path)
    daily.write_days(events.where(f"event_date = DATE'{days[-1]}'"), path)
    after = _files(path)
    assert set(after) - set(before) == {f"event_date={days[-1]}"} and all(after[d] == before[d] for d in before)
    _same(daily.funnel_counts(daily.read_days(spark, path)), funnel.funnel_counts(events))


def test_approximate_users(spark):
    """Within four standard errors of the exact counts, over days and over segments."""
    events = normalized(spark, SF01)
    partials = daily.daily_partials(events)
    error = 4 * 1.04 / 2 ** (daily.SKETCH_BITS / 2)
    exact, near = population.population_counts(events, CUTOFF).first(), daily.approximate_population(partials, CUTOFF).first()
    assert exact.asDict().keys() == near.asDict().keys() and exact.unique_users > 500
    for k, v in exact.asDict().items():
        assert abs(near[k] - v) <= max(1, error * v), k
    want = {(r.browser, r.operating_system): r for r in funnel.funnel_users(events).collect()}
    got = {(r.browser, r.operating_system): r for r in daily.approximate_funnel_users(partials).collect()}
    assert want.keys() == got.keys()
    for k, r in want.items():
        for step in DEFAULTS.funnel.steps:
            assert abs(got[k][step] - r[step]) <= max(1, error * r[step]), (k, step)


def test_empty_table(spark, events):
    events.add("u", "purchase", 1)
    none = daily.daily_partials(events.norm(spark).limit(0))
    assert daily.purchase_duration(none).count() == 0 or daily.purchase_duration(none).first().no_of_purchases is None
    assert daily.approximate_population(none).first().unique_users == 0
    assert daily.average_order_value(none).first().purchase_events == 0


def test_other_segment_keys_are_refused(spark, events):
    from cartlane.config import SegmentSpec
    with pytest.raises(ValueError, match="browser"):
        daily.daily_partials(events.add("u", "purchase", 1).norm(spark), SegmentSpec(keys=("browser",)))
