"""Every registered query equals its DuckDB oracle at sf0.001 (the driver
checks sf0.01; ``scripts/check_oracle.py`` runs that locally)."""

import pytest

import __spark_entry__ as E
from cartlane.plans.catalog import CATALOG
from cartlane.plans.oracle_base import query
from cartlane.plans.verify import compare, duck_connection
from conftest import SF001


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF001)


#: Sketch estimates have no exact SQL; tests/test_daily.py holds them to their error.
APPROXIMATE = {"population_counts_approx", "funnel_users_approx"}


def test_every_query_has_an_oracle():
    assert set(CATALOG) <= set(E.queries()) and set(CATALOG) - APPROXIMATE <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(CATALOG) - APPROXIMATE))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF001), con, E.oracle_sql()[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["purchase_date", "avg_minutes_to_purchase", "no_of_purchases", "result_type"]


def test_money_agrees_with_plain_doubles(spark, con):
    """The checks hold money as integers, as the operators hold it as decimals; a plain AVG of doubles is a third way."""
    aov = CATALOG["aov"](spark, SF001).collect()[0].aov
    sql = query() + "SELECT avg(purchase_revenue_in_usd) FROM typed WHERE event_name = 'purchase' AND event_date <= DATE '2024-01-25'"
    plain = con.sql(sql).fetchall()[0][0]
    assert aov == pytest.approx(plain, rel=1e-9)


def _first_rows_in_order(rows, key):
    return rows == sorted(rows, key=key)


def test_results_are_ordered(spark):
    """O1, O2: the final order, which the comparison above does not see."""
    none_first = lambda d: (d is not None, d)
    rows = CATALOG["daily_purchase_duration"](spark, SF001).collect()
    assert len(rows) > 5 and _first_rows_in_order(rows, lambda r: none_first(r.purchase_date))
    rows = CATALOG["clean_vs_overall"](spark, SF001).collect()
    assert _first_rows_in_order(rows, lambda r: (none_first(r.purchase_date), r.result_type))
    rows = CATALOG["funnel_counts"](spark, SF001).collect()
    assert _first_rows_in_order(rows, lambda r: (r.browser, r.operating_system))


@pytest.mark.parametrize("name", ["friction_segments", "clean_vs_overall", "user_day_facts"])
def test_production_reader_matches_oracle(spark, con, tmp_path, monkeypatch, name):
    """The same checks with raw events stored by day and read by ``read_raw_events``."""
    from cartlane.plans import catalog
    from cartlane.sources.fixture import load_raw_events
    from cartlane.sources.raw_events import read_raw_events
    path = str(tmp_path / "raw")
    load_raw_events(spark, SF001).write.partitionBy("event_date").parquet(path)
    monkeypatch.setattr(catalog, "load_raw_events", lambda s, d: read_raw_events(s, path))
    ok, msg = compare(CATALOG[name](spark, SF001), con, E.oracle_sql()[name])
    assert ok, msg
