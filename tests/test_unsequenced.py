"""A raw table without ``event_seq``: ties are ordered by content, whatever the files and partitions."""

import random

from cartlane.operators import friction, sequences as S
from cartlane.operators.events import label_checkout_events, normalize_events
from cartlane.functions.labels import lag_names
from cartlane.sources.raw_events import read_raw_events

NAMES = ["begin_checkout", "add_shipping_info", "add_payment_info", "page_view", "purchase", "scroll"]


def _events(events, seed=3):
    r = random.Random(seed)
    for _ in range(900):
        name = r.choice(NAMES)
        title = r.choice(["Payment Method", "Shopping Cart", "Home", None]) if name == "page_view" else None
        user = f"u{r.randrange(25)}"
        if user < "u2" and name == "purchase":
            name = "begin_checkout"
        events.add(user, name, r.randrange(0, 200, 20), title=title)  # many ties
    return events


def _results(raw):
    lab = label_checkout_events(normalize_events(raw))
    key = [S.USER, "event_timestamp", "event_seq", "event_label", *lag_names(5)]
    return (sorted(map(tuple, S.prior_events(lab).select(*key).collect()), key=repr),
            sorted(map(tuple, S.prior_events(lab, split_rows=7).select(*key).collect()), key=repr),
            sorted(map(tuple, S.checkout_churners(lab).collect()), key=repr),
            sorted(map(tuple, friction.friction_segments(lab).collect()), key=repr))


def test_same_result_under_any_partitioning(spark, events):
    raw = _events(events).raw(spark).drop("event_seq")
    first = _results(raw.coalesce(1))
    assert first[0] == first[1]  # split histories, too
    assert first[2]
    for n in (3, 11):
        assert _results(raw.repartition(n)) == first
        assert _results(raw.orderBy("page_title", "browser").repartition(n, "event_timestamp")) == first


def test_ties_are_ordered_by_content(spark, events):
    events.add("u", "purchase", 5).add("u", "page_view", 5, title="Payment Method").add("u", "add_payment_info", 5)
    lab = label_checkout_events(normalize_events(events.raw(spark).drop("event_seq")))
    rows = {r.event_label: r.one_event_before for r in S.prior_events(lab, 1).collect()}
    assert rows == {"add_payment_info": None, "Payment Method": "add_payment_info", "purchase": "Payment Method"}


def test_reader_takes_tables_without_the_column(spark, events, tmp_path):
    raw = _events(events).raw(spark)
    raw.drop("event_seq").write.parquet(str(tmp_path / "bare"))
    raw.write.parquet(str(tmp_path / "full"))
    bare = read_raw_events(spark, str(tmp_path / "bare"))
    assert "event_seq" not in bare.columns and "event_seq" in read_raw_events(spark, str(tmp_path / "full")).columns
    assert _results(bare) == _results(raw.drop("event_seq"))
