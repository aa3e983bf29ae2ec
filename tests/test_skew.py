"""A (user, day) holding a third of all rows: the clean path cuts its checkpoint
rows to a few per map task before they are shuffled, and finds the same days as
a count of all of them."""

from pyspark.sql import functions as F

from cartlane.operators import clean_path
from cartlane.operators.events import label_checkout_events, normalize_events
from cartlane.operators.skew import hot_keys
from cartlane.plans.inspect import plan_text

STEPS = ["begin_checkout", "add_shipping_info", "add_payment_info", "add_to_cart", "purchase"]


def _hot_raw(spark, n=60000):
    hot = F.col("id") % 3 == 0
    steps = F.array(*[F.lit(s) for s in STEPS])
    return spark.range(0, n, 1, 8).select(
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("u"), (F.col("id") % 5000).cast("string")))
        .alias("user_pseudo_id"),
        F.element_at(steps, (F.col("id") % 5 + 1).cast("int")).alias("event_name"),
        F.lit(None).cast("string").alias("page_title"),
        F.lit("20240112").alias("event_date"),  # one busy day; the hot user-day is a third of it
        # scrambled times: realistic, poorly compressible shuffle blocks
        (F.lit(1705017600000000) + F.pmod(F.xxhash64("id"), F.lit(86_400_000_000))).alias("event_timestamp"),
        F.lit("Chrome").alias("browser"),
        F.lit("Windows").alias("operating_system"),
        F.lit(None).cast("double").alias("purchase_revenue_in_usd"),
        F.col("id").alias("event_seq"))


def test_hot_user_day_leaves_map_tasks_as_a_few_rows(spark):
    lab = label_checkout_events(normalize_events(_hot_raw(spark)))
    counts = clean_path.checkpoint_counts(lab)
    clean = counts.where("purchased AND add_shipping_count = 1 AND payment_info_count = 1 AND payment_page_count = 1")
    want = sorted(tuple(r) for r in clean.select("user_pseudo_id", "event_date").collect())
    df = clean_path.clean_path_user_days(lab)
    assert sorted(map(tuple, df.collect())) == want
    # A partial limit stands below an exchange, a final one above it.
    text = plan_text(df)
    assert "WindowGroupLimit" in text and "Partial" in text and "Final" in text


def test_counts_of_a_hot_user_day(spark):
    lab = label_checkout_events(normalize_events(_hot_raw(spark))).where("user_pseudo_id = 'hot'")
    rows = lab.collect()
    start = min(r.event_us for r in rows if r.event_label == "begin_checkout")
    got = clean_path.checkpoint_counts(lab).first()
    assert got.add_shipping_count == sum(r.event_label == "add_shipping_info" and r.event_us >= start for r in rows)
    assert got.payment_info_count == sum(r.event_label == "add_payment_info" and r.event_us >= start for r in rows)


def test_hot_user_days_are_counted_where_they_are_read(spark):
    """Hot user-days, found on a sample, get their checkout by a broadcast; counts are the same, no window holds them."""
    lab = label_checkout_events(normalize_events(_hot_raw(spark)))
    want = sorted(map(tuple, clean_path.checkpoint_counts(lab, most_rows=None).collect()))
    for most in (20, 1000):
        df = clean_path.checkpoint_counts(lab, most_rows=most)
        assert sorted(map(tuple, df.collect())) == want
        text = plan_text(df)
        assert "BroadcastHashJoin" in text and "Window" not in text and "SortMergeJoin" not in text
    # The hot branch alone is counted map-side before its exchange.
    assert "partial_count" in text
    assert "Join" not in plan_text(clean_path.checkpoint_counts(lab, most_rows=10_000_000))


def test_lists_of_ordinary_days_are_bounded(spark):
    """The user-days that become lists hold no hot one."""
    lab = label_checkout_events(normalize_events(_hot_raw(spark)))
    hot = hot_keys(lab, clean_path.KEY, 1000)
    assert [r["user_pseudo_id"] for r in hot.collect()] == ["hot"]
    assert hot_keys(lab, clean_path.KEY, 1_000_000) is None
