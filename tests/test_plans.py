"""Plan shape: one scan per chain, partial aggregation, no Python or
nested-loop operators, exchange reuse where branches share a shuffle."""

import pytest

import __spark_entry__ as E
from cartlane.plans.catalog import CATALOG
from cartlane.plans.inspect import plan_stats, plan_text
from conftest import SF001

SINGLE_SCAN = ["daily_purchase_duration", "user_day_facts", "funnel_counts", "population_counts", "aov",
               "segment_gaps", "checkpoint_counts", "clean_path_user_days", "clean_vs_overall",
               "clean_vs_overall_session", "aov_candidates", "clean_path_speedup"]
HISTORY = ["prior_event_sequence", "completer_sequences", "friction_segments", "shipping_redirects"]
TAILS = ["checkout_churners", "churner_sequences", "churn_summary", "churner_shares", "payment_step_churners"]


@pytest.mark.parametrize("name", SINGLE_SCAN)
def test_single_scan(spark, name):
    assert plan_stats(E.queries()[name](spark, SF001))["scans"] == 1


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_no_slow_path(spark, name):
    st = plan_stats(E.queries()[name](spark, SF001), execute=False)
    assert st["slow_path"] == 0


def test_facts_are_partially_aggregated(spark):
    df = E.queries()["user_day_facts"](spark, SF001)
    assert "partial_min" in plan_text(df)
    assert plan_stats(df)["windows"] == 0


@pytest.mark.parametrize("name", ["clean_path_user_days", "checkpoint_counts", "clean_vs_overall"])
def test_clean_path_has_no_join(spark, name):
    df = CATALOG[name](spark, SF001)
    assert "Join" not in plan_text(df)
    assert plan_stats(df)["exchanges"] <= 8


def test_latest_checkpoints_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_text(CATALOG["clean_path_user_days"](spark, SF001))


@pytest.mark.parametrize("name", HISTORY + TAILS)
def test_history_of_ordinary_users_is_one_scan(spark, name):
    """Without a hot user: one scan, no join, and the labelled rows (or the tails) pass one exchange by user."""
    df = CATALOG[name](spark, SF001)
    stats, text = plan_stats(df), plan_text(df).split("== Initial Plan ==")[0]
    assert stats["scans"] == 1 and "Join" not in text
    assert ("WindowGroupLimit" in text) == (name in TAILS)


def test_cutoff_pushed_to_raw_scan(spark, tmp_path):
    import datetime as dt
    from cartlane.sources.fixture import load_raw_events
    from cartlane.sources.raw_events import read_raw_events
    path = str(tmp_path / "raw")
    load_raw_events(spark, SF001).write.parquet(path)
    text = plan_text(read_raw_events(spark, path, cutoff=dt.date(2024, 1, 25)).select("user_pseudo_id"))
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "LessThanOrEqual(event_date,20240125)" in pushed
    assert "ReadSchema: struct<user_pseudo_id:string,event_date:string>" in text


def test_partitioned_raw_table_prunes_and_matches(spark, tmp_path):
    """Production path: raw events stored partitioned by event_date. The
    cutoff prunes partitions at the scan and the operator result equals the
    catalog query over the fixture."""
    import datetime as dt
    from cartlane.operators.duration import purchase_duration
    from cartlane.operators.events import normalize_events
    from cartlane.sources.fixture import load_raw_events
    from cartlane.sources.raw_events import read_raw_events
    path = str(tmp_path / "raw_by_day")
    load_raw_events(spark, SF001).write.partitionBy("event_date").parquet(path)
    cutoff = dt.date(2024, 1, 25)
    raw = read_raw_events(spark, path, cutoff=cutoff)
    text = plan_text(raw.select("user_pseudo_id"))
    assert "PartitionFilters: [isnotnull(event_date" in text or "PartitionFilters: [(event_date" in text
    got = sorted(map(tuple, purchase_duration(normalize_events(raw), cutoff=cutoff).collect()), key=repr)
    want = sorted(map(tuple, E.queries()["daily_purchase_duration"](spark, SF001).collect()), key=repr)
    assert got == want
