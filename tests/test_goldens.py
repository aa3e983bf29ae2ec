"""Golden values at sf0.01 recorded in FIXTURES.md §5 (cutoff 2024-01-25
for durations, clean path and AOV; no cutoff for funnel and friction)."""

import pytest

import __spark_entry__ as E
from conftest import SF01


@pytest.fixture(scope="module")
def q(spark):
    return lambda name: E.queries()[name](spark, SF01).collect()


def test_daily_duration(q):
    rows = q("daily_purchase_duration")
    assert len(rows) == 26
    overall = [r for r in rows if r.result_type == "Overall"][0]
    assert (overall.avg_minutes_to_purchase, overall.no_of_purchases) == (47.35, 1638)


def test_duration_by_segment(q):
    rows = q("purchase_duration_by_segment")
    assert len(rows) == 158
    got = {(r.browser, r.operating_system): (r.avg_minutes_to_purchase, r.no_of_purchases)
           for r in rows if r.result_type == "Overall"}
    assert got == {
        ("Chrome", "Macintosh"): (52.09, 176), ("Chrome", "Windows"): (44.95, 232),
        ("Chrome", "iOS"): (47.45, 208), ("Chrome", "Android"): (52.39, 186),
        ("Safari", "Macintosh"): (46.58, 214), ("Safari", "iOS"): (38.01, 202),
        ("Safari", "Windows"): (17.0, 1),
    }


@pytest.mark.parametrize("name,clean", [("clean_vs_overall", (41.88, 1566, 49.10)),
                                        ("clean_vs_overall_session", (38.00, 919, 48.73))])
def test_clean_vs_overall(q, name, clean):
    rows = q(name)
    assert len(rows) == 52
    s = {r.result_type: (r.avg_minutes_to_purchase, r.no_of_purchases, r.overall_avg_revenue_purchase)
         for r in rows if r.purchase_date is None}
    assert s["Overall Average"] == (47.35, 1638, 48.24)
    assert s["Clean Path Average"] == clean


def test_friction_segments(q):
    s = {r.segment: r for r in q("friction_segments")}
    ch, co = s["Friction Churners"], s["Friction Completers"]
    assert (ch.sequences, ch.affected_users, ch.revenue_at_risk) == (76, 147, 9781.38)
    assert (ch.user_avg_begin_checkout, ch.max_begin_checkout) == (1.48, 4)
    assert (ch.user_avg_payment_touches, ch.max_payment_touches) == (1.42, 3)
    assert abs(ch.avg_begin_checkout - 1.6710526) < 1e-7 and abs(ch.avg_payment_touches - 0.7894737) < 1e-7
    assert (co.sequences, co.affected_users, co.revenue_at_risk) == (27, 1056, 70266.24)
    assert (co.user_avg_begin_checkout, co.max_begin_checkout) == (1.34, 2)
    assert (co.user_avg_payment_touches, co.max_payment_touches) == (2.52, 5)


def test_aov_and_churners(q):
    assert abs(q("aov")[0].aov - 48.018330341113106) < 1e-12
    rows = q("checkout_churners")
    assert len(rows) == 253 and len({r.user_pseudo_id for r in rows}) == 203
    by = {r.last_event: r.churn_rows for r in q("churners_by_last_event")}
    assert by == {"begin_checkout": 63, "add_shipping_info": 20, "Payment Method": 32, "add_payment_info": 32}


def test_clean_user_days(q):
    rows = q("clean_path_user_days")
    assert len(rows) == 1089 and len({r.user_pseudo_id for r in rows}) == 778


def test_funnel_counts(q):
    got = {(r.browser, r.operating_system): tuple(r)[2:] for r in q("funnel_counts")}
    assert got == {
        ("Chrome", "Android"): (245, 393, 746, 474, 430, 236),
        ("Chrome", "Macintosh"): (238, 382, 750, 455, 430, 218),
        ("Chrome", "Windows"): (285, 409, 790, 496, 448, 269),
        ("Chrome", "iOS"): (239, 419, 784, 471, 436, 247),
        ("Safari", "Macintosh"): (255, 409, 806, 495, 452, 255),
        ("Safari", "iOS"): (280, 409, 766, 458, 418, 239),
    }
