"""Rejected rows beside the events, counted by reason in the pass that writes them."""

from cartlane.operators.events import normalize_events
from cartlane.operators.population import population_counts
from cartlane.plans.inspect import plan_text
from cartlane.sources import read_accepted, read_rejects, write_checked


def _bad(events):
    for k in range(20):
        events.add(f"u{k % 4}", "begin_checkout" if k % 3 else "purchase", k)
    events.add(None, "purchase", 3).add(None, "scroll", 4).add("u1", "purchase", 5).add("u2", "scroll", 6).add(None, "scroll", 7)
    for at, date in ((22, "2024-01-05"), (23, None), (24, "no date")):
        events.rows[at] = (*events.rows[at][:3], date, *events.rows[at][4:])
    return events


def test_counts_events_and_rejects(spark, events, tmp_path):
    raw, path = _bad(events).raw(spark), str(tmp_path / "checked")
    # Rows 20, 21 and 24 lack the user (24 has a bad date, too), 22 has a bad date, 23 a NULL date, which is no reason.
    assert write_checked(raw, path) == {"none": 21, "null_user": 3, "bad_date": 1}
    rejects = read_rejects(spark, path)
    assert sorted((r.reject_reason, r.stored_date, r.event_seq) for r in rejects.collect()) == [
        ("bad_date", "2024-01-05", 23), ("null_user", "20240105", 21), ("null_user", "20240105", 22), ("null_user", "no date", 25)]
    assert all(r.user_pseudo_id is None for r in rejects.where("reject_reason = 'null_user'").collect())
    good = read_accepted(spark, path)
    want = normalize_events(raw.where("user_pseudo_id IS NOT NULL AND (event_seq <= 20 OR event_seq = 24)"))
    assert good.columns == want.columns
    assert sorted(map(tuple, good.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert population_counts(good).first() == population_counts(want).first()
    # Rejected files are not read.
    assert "reject_reason=bad_date" not in plan_text(good) and "PartitionFilters: [isnotnull(reject_reason" in plan_text(good)


def test_clean_and_empty_tables(spark, events, tmp_path):
    events.add("u", "purchase", 1)
    raw = events.raw(spark)
    assert write_checked(raw, str(tmp_path / "clean")) == {"none": 1, "null_user": 0, "bad_date": 0}
    assert read_rejects(spark, str(tmp_path / "clean")).count() == 0
    # A table without a sequence is checked, too.
    assert write_checked(raw.drop("event_seq"), str(tmp_path / "bare"))["none"] == 1
