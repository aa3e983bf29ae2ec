"""Micro fixtures for the semantic traps of the reference.

Every expected value is worked out by hand from the rows in the test."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from cartlane.config import CheckoutSpec, FunnelSpec
from cartlane.operators import clean_path, duration, friction, funnel, population, revenue, sequences
from cartlane.operators.events import label_checkout_events, normalize_events
from cartlane.operators.facts import user_day_facts

D5 = dt.date(2024, 1, 5)


def test_t1_whole_minutes(spark, events):
    events.add("u1", "session_start", minute=59 / 60).add("u1", "purchase", minute=2)
    r = user_day_facts(events.norm(spark)).first()
    assert r.minutes_to_purchase == 1


def test_t2_half_up_on_exact_mean(spark, events):
    for i in range(8):
        events.add(f"u{i}", "session_start", minute=0).add(f"u{i}", "purchase", minute=1 if i == 0 else 0)
    daily = duration.purchase_duration(events.norm(spark)).where("result_type = 'Daily'").first()
    assert daily.avg_minutes_to_purchase == 0.13  # 1/8 = 0.125 -> 0.13
    assert daily.no_of_purchases == 8


def test_t3_overall_is_mean_of_daily_means(spark, events):
    events.add("u1", "session_start", 0).add("u1", "purchase", 10)
    for u in ("u2", "u3", "u4"):
        events.add(u, "session_start", 0, date="20240106").add(u, "purchase", 0, date="20240106")
    rows = {r.result_type + str(r.purchase_date): r for r in duration.purchase_duration(events.norm(spark)).collect()}
    overall = rows["OverallNone"]
    assert overall.avg_minutes_to_purchase == 5.0  # (10 + 0) / 2, not 10 / 4
    assert overall.no_of_purchases == 4


def test_cutoff_inclusive(spark, events):
    events.add("u1", "session_start", 0, date="20240125").add("u1", "purchase", 3, date="20240125")
    events.add("u2", "session_start", 0, date="20240126").add("u2", "purchase", 3, date="20240126")
    cutoff = dt.date(2024, 1, 25)
    daily = duration.purchase_duration(events.norm(spark), cutoff=cutoff).where("result_type = 'Daily'").collect()
    assert [r.purchase_date for r in daily] == [cutoff]


def test_no_date_is_dropped_by_default(spark, events):
    """A cutoff is asked for or not there: later rows count in every operator that can take one."""
    for i, step in enumerate(["begin_checkout", "add_shipping_info", "add_payment_info", "purchase"]):
        events.add("u1", step, i, date="20251231", rev=0.125)
    events.add("u1", "page_view", 2, title="Payment Method", date="20251231")
    events.add("u2", "purchase", 0, date="20251231", rev=0.125)
    ev = events.norm(spark)
    day = dt.date(2025, 12, 31)
    assert {r.purchase_date for r in duration.purchase_duration(ev).collect()} == {None, day}
    assert {r.purchase_date for r in duration.purchase_duration_by(ev).collect()} == {None, day}
    assert duration.slowest_segment(ev).first().no_of_purchases == 2
    assert revenue.average_order_value(ev).first() == (0.125, 2)
    assert population.population_counts(ev).first().purchasers == 2
    assert {r.purchase_date for r in clean_path.clean_vs_overall(ev).collect()} == {None, day}
    assert clean_path.aov_candidates(ev).where("chosen").first().value == 0.125
    assert clean_path.clean_path_speedup(ev).first().overall_avg_minutes == 1.5


def test_amounts_of_three_decimals_average_exactly(spark, events):
    events.add("u1", "purchase", 0, rev=1.125).add("u1", "purchase", 1, rev=1.126).add("u2", "purchase", 1, rev=0.0004)
    ev = events.norm(spark)
    facts = {r.user_pseudo_id: r for r in user_day_facts(ev).collect()}
    assert facts["u1"].avg_purchase_revenue == 1.1255 and facts["u2"].revenue_micros == 400
    assert revenue.average_order_value(ev).first().aov == pytest.approx(2.2514 / 3, rel=1e-15)


def test_lenient_dates(spark, events):
    events.add("u1", "purchase", 0).add("u2", "purchase", 0)
    raw = events.raw(spark).withColumn("event_date", F.expr("if(user_pseudo_id = 'u2', '2024-13-99', event_date)"))
    with pytest.raises(Exception):
        normalize_events(raw).collect()
    dates = {r.user_pseudo_id: r.event_date for r in normalize_events(raw, lenient_dates=True).collect()}
    assert dates == {"u1": D5, "u2": None}


def test_t8_paired_browser_and_os(spark, events):
    events.add("u1", "session_start", 0, browser="Safari", os_="Windows")
    events.add("u1", "purchase", 5, browser="Chrome", os_="Windows")
    events.add("u1", "purchase", 6, browser="Safari", os_="Macintosh")
    r = user_day_facts(events.norm(spark), paired=True).first()
    assert (r.browser, r.operating_system) == ("Safari", "Macintosh")


def test_t3_weighted_duration(spark, events):
    events.add("u1", "session_start", 0).add("u1", "purchase", 10)
    for u in ("u2", "u3", "u4"):
        events.add(u, "session_start", 0, date="20240106").add(u, "purchase", 0, date="20240106")
    assert duration.purchase_weighted_duration(events.norm(spark)).first() == (2.5, 4)


def test_every_segment_has_its_gap(spark, events):
    for user, minutes, browser in (("a", 30, "Chrome"), ("b", 10, "Safari"), ("c", 20, "Firefox")):
        events.add(user, "session_start", 0, browser=browser).add(user, "purchase", minutes, browser=browser)
    rows = {r.browser: (r.overall_avg_minutes, r.gap_minutes) for r in duration.segment_gaps(events.norm(spark)).collect()}
    assert rows == {"Chrome": (20.0, 10.0), "Safari": (20.0, -10.0)}


def test_t7_strict_rates_raise(spark, events):
    for _ in range(2):
        events.add("a", "add_to_cart", 0, os_="iOS")
    with pytest.raises(Exception, match="without first_visit"):
        funnel.funnel_rates(events.norm(spark), strict=True).collect()


def test_friction_follows_the_spec(spark, events):
    """Own churn steps, payment steps and history length."""
    spec = CheckoutSpec(churn_steps=("view_cart",), payment_steps=("pay_by_card",), begin="open_till", history=3)
    for i, step in enumerate(["view_cart", "open_till", "pay_by_card", "view_cart"]):
        events.add("x", step, i)
    for i, step in enumerate(["view_cart", "add_to_cart", "add_to_cart", "add_to_cart", "view_cart"]):
        events.add("far", step, i)
    for i, step in enumerate(["begin_checkout", "begin_checkout"]):
        events.add("other", step, i)
    for i, step in enumerate(["begin_checkout", "begin_checkout", "purchase", "view_cart", "view_cart", "purchase"]):
        events.add("buyer", step, i)
    lab = label_checkout_events(events.norm(spark), spec)
    rows = {r.user_pseudo_id: r.is_friction for r in sequences.churner_rows_with_friction(lab, spec).collect()}
    assert rows == {"x": True, "far": False}
    seg = {s.segment: s for s in friction.friction_segments(lab, spec=spec).collect()}
    assert (seg["Friction Churners"].sequences, seg["Friction Churners"].max_payment_touches,
            seg["Friction Churners"].max_begin_checkout) == (1, 1, 1)
    assert seg["Friction Completers"].sequences == 1
    pay = CheckoutSpec(churn_steps=("view_cart", "pay_by_card"), payment_steps=("view_cart",))
    assert sequences.payment_step_churners(lab, pay).first() == (2, 2, 2)


def test_session_scoped_friction(spark, events):
    """A step that repeats on another day is friction of the user, not of the session."""
    events.add("u", "begin_checkout", 0, date="20240105").add("u", "begin_checkout", 0, date="20240106")
    lab = label_checkout_events(events.norm(spark))
    by_user = {s.segment: s.sequences for s in friction.friction_segments(lab).collect()}
    by_day = {s.segment: s.sequences for s in friction.friction_segments(lab, partition_by=sequences.SESSION).collect()}
    assert by_user["Friction Churners"] == 1 and by_day["Friction Churners"] == 0
    assert len(sequences.checkout_churners(lab, partition_by=sequences.SESSION).collect()) == 2


def test_churner_shares(spark, events):
    for user in ("a", "b", "c"):
        events.add(user, "begin_checkout", 0).add(user, "begin_checkout", 1)
    events.add("d", "add_payment_info", 0).add("d", "add_payment_info", 1)
    shares = {r.last_event: r.share_prct for r in sequences.churner_shares(label_checkout_events(events.norm(spark))).collect()}
    assert shares == {"begin_checkout": 75.0, "add_payment_info": 25.0}


def test_t16_stored_date_is_the_session(spark, events):
    # the first event's timestamp is on Jan 4 (UTC) but it is stored under Jan 5
    events.add("u1", "session_start", 23 * 60 + 50, date="20240105", ts_date="20240104")
    events.add("u1", "purchase", 10, date="20240105")
    rows = user_day_facts(events.norm(spark)).collect()
    assert len(rows) == 1 and rows[0].event_date == D5 and rows[0].minutes_to_purchase == 20


def test_t18_segment_filter_applies_to_first_event(spark, events):
    events.add("u1", "session_start", 0, browser="Firefox", os_="Linux")
    events.add("u1", "view_item", 5).add("u1", "purchase", 15)
    ev = events.norm(spark)
    all_ = duration.purchase_duration(ev).where("result_type = 'Daily'").first()
    seg = duration.purchase_duration_by(ev).where("result_type = 'Daily'").first()
    assert all_.avg_minutes_to_purchase == 15.0
    assert seg.avg_minutes_to_purchase == 10.0


def test_t8_browser_and_os_maxed_independently(spark, events):
    events.add("u1", "session_start", 0)
    events.add("u1", "purchase", 5, browser="Chrome", os_="Windows")
    events.add("u1", "purchase", 6, browser="Safari", os_="Macintosh")
    r = duration.purchase_duration_by(events.norm(spark)).where("result_type = 'Daily'").first()
    assert (r.browser, r.operating_system) == ("Safari", "Windows")


def test_t5_funnel_counts_events_and_drops_single_cells(spark, events):
    for _ in range(3):
        events.add("a", "first_visit", 0)
    events.add("a", "add_to_cart", 1)
    events.add("a", "purchase", 2).add("b", "purchase", 2)
    events.add("c", "first_visit", 0, browser="Safari", os_="iOS").add("c", "purchase", 1, browser="Safari", os_="iOS")
    events.add("d", "first_visit", 0, browser="Firefox", os_="Windows")
    rows = funnel.funnel_counts(events.norm(spark)).collect()
    assert len(rows) == 1
    r = rows[0].asDict()
    assert (r["browser"], r["operating_system"]) == ("Chrome", "Windows")
    assert (r["first_visit"], r["add_to_cart"], r["purchase"]) == (3, 0, 2)
    users = funnel.funnel_users(events.norm(spark)).where("browser = 'Chrome'").first()
    assert (users.first_visit, users.purchase) == (1, 2)


def test_t7_rates_null_without_base(spark, events):
    for _ in range(2):
        events.add("a", "add_to_cart", 0, os_="iOS")
    r = funnel.funnel_rates(events.norm(spark)).first()
    assert r.prct_first_visit is None and r.prct_add_to_cart is None


def test_funnel_rates_base_is_100(spark, events):
    for _ in range(4):
        events.add("a", "first_visit", 0)
    for _ in range(3):
        events.add("a", "purchase", 1)
    r = funnel.funnel_rates(events.norm(spark), FunnelSpec(min_count=0)).first()
    assert r.prct_first_visit == 100.0 and r.prct_purchase == 75.0


def test_t6_null_user_contract(spark, events):
    events.add(None, "purchase", 0).add("u1", "purchase", 1)
    with pytest.raises(Exception):
        normalize_events(events.raw(spark)).collect()
    assert normalize_events(events.raw(spark), on_null_user="drop").count() == 1


def test_label_nulls(spark, events):
    events.add("u", "page_view", 0, title=None).add("u", None, 1).add("u", "page_view", 2, title="Home")
    events.add("u", "page_view", 3, title="Shopping Cart").add("u", "scroll", 4).add("u", "add_to_cart", 5)
    labels = [r.event_label for r in label_checkout_events(events.norm(spark)).orderBy("event_us").collect()]
    assert labels == ["Shopping Cart", "add_to_cart"]


def _churn_fixture(events):
    # u1 churns; its last two events are tied (same microsecond)
    events.add("u1", "begin_checkout", 0).add("u1", "add_shipping_info", 1)
    events.add("u1", "page_view", 2, title="Payment Method", seq=100).add("u1", "add_payment_info", 2, seq=101)
    # u2 purchases: never a churner
    events.add("u2", "begin_checkout", 0).add("u2", "purchase", 1)
    # u3: history crosses midnight, churns on add_shipping_info
    events.add("u3", "begin_checkout", 23 * 60 + 59, date="20240105")
    events.add("u3", "add_shipping_info", 1, date="20240106")
    return events


def test_t9_t10_ties_kept_and_ordered(spark, events):
    rows = sequences.checkout_churners(label_checkout_events(_churn_fixture(events).norm(spark))).collect()
    by = {(r.user_pseudo_id, r.churn_event): r for r in rows}
    assert set(by) == {("u1", "Payment Method"), ("u1", "add_payment_info"), ("u3", "add_shipping_info")}
    assert by[("u1", "add_payment_info")].one_event_before == "Payment Method"
    assert by[("u1", "Payment Method")].one_event_before == "add_shipping_info"
    assert by[("u1", "Payment Method")].two_events_before == "begin_checkout"
    assert by[("u1", "Payment Method")].three_events_before is None


def test_t12_history_crosses_days(spark, events):
    rows = sequences.checkout_churners(label_checkout_events(_churn_fixture(events).norm(spark))).collect()
    u3 = [r for r in rows if r.user_pseudo_id == "u3"][0]
    assert u3.one_event_before == "begin_checkout" and u3.event_date == dt.date(2024, 1, 6)


def test_t11_t15_friction_segments(spark, events):
    # completer with friction twice (two sequences), and one without friction
    for i, step in enumerate(["begin_checkout", "begin_checkout", "purchase"]):
        events.add("c1", step, i)
    for i, step in enumerate(["add_payment_info", "add_payment_info", "purchase"]):
        events.add("c1", step, 10 + i)
    for i, step in enumerate(["begin_checkout", "add_shipping_info", "purchase"]):
        events.add("c2", step, i)
    # churners: last step seen before (friction) / not seen before (no friction)
    for i, step in enumerate(["begin_checkout", "add_shipping_info", "begin_checkout"]):
        events.add("x1", step, i)
    for i, step in enumerate(["add_to_cart", "begin_checkout"]):
        events.add("x2", step, i)
    out = {r.segment: r for r in friction.friction_segments(label_checkout_events(events.norm(spark))).collect()}
    comp, churn = out["Friction Completers"], out["Friction Churners"]
    assert comp.sequences == 2 and comp.affected_users == 2  # one user, counted per sequence (T11)
    assert comp.revenue_at_risk == 133.08
    assert churn.sequences == 1 and churn.affected_users == 1
    assert churn.max_begin_checkout == 1 and churn.avg_begin_checkout == 1.0


def test_a19_empty_segment_row(spark, events):
    for i, step in enumerate(["begin_checkout", "begin_checkout", "purchase"]):
        events.add("c1", step, i)
    out = {r.segment: r for r in friction.friction_segments(label_checkout_events(events.norm(spark))).collect()}
    churn = out["Friction Churners"]
    assert churn.sequences == 0
    assert churn.affected_users is None and churn.revenue_at_risk is None and churn.max_payment_touches is None


def _clean_fixture(events):
    def day(user, steps, date="20240105"):
        for minute, step in steps:
            if step == "PM":
                events.add(user, "page_view", minute, title="Payment Method", date=date)
            else:
                events.add(user, step, minute, date=date)
    base = [(0, "begin_checkout"), (1, "add_shipping_info"), (2, "PM"), (2, "add_payment_info"), (3, "purchase")]
    day("clean", base)
    day("twice", base[:2] + [(1.5, "add_shipping_info")] + base[2:])
    day("before", [(0, "add_shipping_info"), (1, "begin_checkout"), (2, "add_shipping_info"), (3, "PM"),
                   (3, "add_payment_info"), (4, "purchase")])
    day("purchase_first", [(0, "purchase"), (1, "begin_checkout"), (2, "add_shipping_info"), (3, "PM"),
                           (3, "add_payment_info")])
    day("no_checkout", base[1:])
    day("after_purchase", base + [(4, "add_shipping_info")])
    day("no_purchase", base[:4])
    events.add("tie", "add_shipping_info", 1, seq=1)
    events.add("tie", "begin_checkout", 1, seq=2)
    day("tie", [(2, "PM"), (2, "add_payment_info"), (3, "purchase")])
    return events


def test_w8_clean_variants_and_t17(spark, events):
    lab = label_checkout_events(_clean_fixture(events).norm(spark))
    got = {r.user_pseudo_id for r in clean_path.clean_path_user_days(lab).collect()}
    assert got == {"clean", "before", "purchase_first", "tie"}


def test_t4_fanout_reference_vs_session(spark, events):
    base = [(0, "begin_checkout"), (1, "add_shipping_info"), (2, "PM"), (2, "add_payment_info"), (3, "purchase")]
    for date in ("20240105", "20240126"):
        for minute, step in base:
            if step == "PM":
                events.add("u", "page_view", minute, title="Payment Method", date=date)
            else:
                events.add("u", step, minute, date=date)
    ev = events.norm(spark)
    cutoff = dt.date(2024, 1, 25)
    ref = clean_path.clean_vs_overall(ev, cutoff, fanout="reference").where("result_type = 'Clean Path'").collect()
    ses = clean_path.clean_vs_overall(ev, cutoff, fanout="session").where("result_type = 'Clean Path'").collect()
    assert [(r.purchase_date, r.no_of_purchases) for r in ref] == [(D5, 2)]
    assert [(r.purchase_date, r.no_of_purchases) for r in ses] == [(D5, 1)]


def test_t14_funnel_and_friction_have_no_date_filter(spark, events):
    for _ in range(2):
        events.add("a", "first_visit", 0, date="20240130").add("a", "purchase", 1, date="20240130")
    r = funnel.funnel_counts(events.norm(spark)).first()
    assert (r.first_visit, r.purchase) == (2, 2)  # dated after the 2024-01-25 cutoff, still counted
    for i, step in enumerate(["begin_checkout", "begin_checkout", "purchase"]):
        events.add("c", step, 10 + i, date="20240130")
    seg = {s.segment: s for s in friction.friction_segments(label_checkout_events(events.norm(spark))).collect()}
    assert seg["Friction Completers"].sequences >= 1
