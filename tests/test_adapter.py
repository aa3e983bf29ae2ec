"""The fixture adapter reproduces the cardinalities recorded in FIXTURES.md."""

from pyspark.sql import functions as F

from cartlane.sources.fixture import load_raw_events
from cartlane.operators.events import normalize_events
from conftest import SF001, SF01


def test_adapter_counts_sf001(spark):
    raw = load_raw_events(spark, SF001)
    assert raw.count() == 3872
    assert raw.select("user_pseudo_id").distinct().count() == 149
    assert raw.agg(F.min("event_date"), F.max("event_date")).first() == ("20240101", "20240130")


def test_adapter_counts_sf01(spark):
    raw = load_raw_events(spark, SF01)
    assert raw.count() == 38453
    assert raw.select("user_pseudo_id").distinct().count() == 1499
    assert raw.groupBy("event_seq").count().where("count > 1").count() == 0


def test_normalize_types(spark):
    ev = normalize_events(load_raw_events(spark, SF001))
    types = dict(ev.dtypes)
    assert types["event_date"] == "date"
    assert types["event_timestamp"] == "timestamp"
    assert types["event_us"] == "bigint"


def test_session_time_zone_does_not_matter(spark):
    """Adapter and operators use epoch microseconds and zone-free date text,
    so results are the same under any session time zone."""
    from cartlane.plans.catalog import CATALOG
    results = []
    try:
        for tz in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            raw = load_raw_events(spark, SF001)
            chk = raw.agg(F.sum(F.xxhash64("event_timestamp", "event_date", "user_pseudo_id") % 1000003)).first()[0]
            daily = sorted(map(tuple, CATALOG["daily_purchase_duration"](spark, SF001).collect()), key=repr)
            churn = sorted((r.user_pseudo_id, r.churn_event) for r in CATALOG["checkout_churners"](spark, SF001).collect())
            results.append((chk, daily, churn))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert results[0] == results[1] == results[2]
