"""Invariants of SURVEY §5 item 3, on the sf0.01 fixture."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF01


@pytest.fixture(scope="module")
def q(spark):
    return lambda name: E.queries()[name](spark, SF01)


def test_first_visit_rate_is_100_or_null(q):
    assert all(r.prct_first_visit in (100.0, None) for r in q("funnel_rates").collect())


@pytest.mark.parametrize("name,keys", [("daily_purchase_duration", ()),
                                       ("purchase_duration_by_segment", ("browser", "operating_system"))])
def test_daily_purchases_sum_to_summary(q, name, keys):
    df = q(name)
    daily = df.where("result_type = 'Daily'").groupBy(*keys).agg(F.sum("no_of_purchases").alias("n"))
    overall = df.where("result_type = 'Overall'").select(*keys, F.col("no_of_purchases").alias("n"))
    assert sorted(map(tuple, daily.collect())) == sorted(map(tuple, overall.collect()))


def test_churners_never_purchased(q):
    churners = q("checkout_churners").select("user_pseudo_id").distinct()
    purchasers = q("checkout_labels").where("event_label = 'purchase'").select("user_pseudo_id").distinct()
    assert churners.join(purchasers, "user_pseudo_id").count() == 0


def test_friction_churners_within_churners(q):
    s = q("churn_summary").first()
    assert s.friction_churners_distinct <= s.checkout_churners
    assert s.friction_churners_distinct <= s.friction_affected_users
    assert s.churner_rows >= s.checkout_churners


def test_session_clean_path_not_above_reference(q):
    def clean_total(name):
        return q(name).where("result_type = 'Clean Path Average'").first().no_of_purchases
    assert clean_total("clean_vs_overall_session") <= clean_total("clean_vs_overall")


def test_clean_days_are_purchase_days(q):
    clean = q("clean_path_user_days")
    facts = q("user_day_facts").select("user_pseudo_id", "event_date")
    assert clean.join(facts, ["user_pseudo_id", "event_date"], "left_anti").count() == 0
