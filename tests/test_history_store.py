"""One stored history serves all reports that need lags: same results, and the events are read once."""

import pytest
from pyspark.sql import functions as F

from cartlane.config import DEFAULTS
from cartlane.operators import friction, sequences as S
from cartlane.plans.catalog import CATALOG, labeled
from cartlane.plans.inspect import plan_text
from cartlane.sources import read_history, write_history
from cartlane.sources.history_store import versions
from conftest import SF001

REPORTS = {
    "prior_event_sequence": S.prior_events,
    "checkout_churners": S.checkout_churners,
    "completer_sequences": S.completer_sequences,
    "churner_sequences": S.churner_sequences,
    "completer_friction": lambda h: S.friction_counts(S.completer_sequences(h)),
    "churner_friction": lambda h: S.friction_counts(S.churner_sequences(h)),
    "friction_segments": lambda h: friction.friction_segments(h, aov=DEFAULTS.aov),
    "churn_summary": friction.churn_summary,
    "friction_revenue_total": lambda h: friction.friction_revenue_total(h, aov=DEFAULTS.aov),
    "churners_by_last_event": S.churners_by_last_event,
    "churner_shares": S.churner_shares,
    "payment_step_churners": S.payment_step_churners,
    "payment_return_churners": S.payment_return_churners,
    "shipping_redirects": S.shipping_redirects,
}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "history")
    assert write_history(labeled(spark, SF001), path, files=6) == 1
    return path


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports_from_the_store(spark, store, name):
    df = REPORTS[name](read_history(spark, store))
    text = plan_text(df)
    # One scan of the store, none of the events, and no window over histories.
    assert text.count("FileScan") == 1 and "version-000001" in text and "events.parquet" not in text
    assert "Window" not in text.split("HashAggregate")[-1]
    want = CATALOG[name](spark, SF001)
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_files_hold_contiguous_users(spark, store):
    spans = read_history(spark, store).groupBy(F.input_file_name().alias("f")).agg(
        F.min(S.USER).alias("a"), F.max(S.USER).alias("b")).orderBy("a", "b").collect()
    assert len(spans) > 1 and all(x["b"] <= y["a"] for x, y in zip(spans, spans[1:], strict=False))


def test_versions(spark, store, tmp_path):
    path = str(tmp_path / "own")
    assert versions(spark, path).count() == 0
    with pytest.raises(ValueError, match="versions"):
        read_history(spark, path)
    events = labeled(spark, SF001)
    assert write_history(events.where("event_date <= DATE'2024-01-10'"), path, n=2) == 1
    first = sorted(map(tuple, read_history(spark, path).collect()), key=repr)
    # A writer that failed half-way leaves the last version in force.
    events.limit(3).write.parquet(f"{path}/version-000002")
    assert sorted(map(tuple, read_history(spark, path).collect()), key=repr) == first
    assert write_history(events, path, n=2) == 2
    assert read_history(spark, path).count() == events.count() > read_history(spark, path, version=1).count()
    with pytest.raises(ValueError, match="versions"):
        read_history(spark, path, version=7)


def test_scope_and_lags_are_checked(spark, store, tmp_path):
    history = read_history(spark, store)
    with pytest.raises(ValueError, match="scope"):
        S.checkout_churners(history, partition_by=S.SESSION)
    with pytest.raises(ValueError, match="lags"):
        S.prior_events(history, 6)
    assert S.prior_events(history, 2).count() == history.count()
    path = str(tmp_path / "sessions")
    write_history(labeled(spark, SF001), path, partition_by=S.SESSION)
    got = friction.friction_segments(read_history(spark, path), aov=DEFAULTS.aov, partition_by=S.SESSION)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, CATALOG["friction_segments_session"](spark, SF001).collect()))
