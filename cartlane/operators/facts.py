"""One row per purchasing (user, day) with first event, first purchase,
minutes between them, purchase browser/OS and average purchase revenue.

The reference builds this from two or three aggregates joined on
(user, date). Here it is one ``groupBy(user, date)`` with conditional
aggregates: one scan, one shuffle, partial aggregation on the map side (a
hot user collapses to one row per map task before the exchange), no join.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlane.config import PURCHASE, SegmentSpec
from cartlane.functions.numeric import MICRO_DOLLARS, minutes_between, money, money_sum, round_money
from cartlane.operators.events import until


def segment_filter(spec: SegmentSpec) -> Column:
    return F.col("browser").isin(*spec.browsers) & F.col("operating_system").isin(*spec.systems)


def _segment_of_purchases(paired: bool) -> list[Column]:
    if not paired:
        return [F.max("_pb").alias("browser"), F.max("_po").alias("operating_system")]
    # The rows of other events carry two NULLs and lose against any purchase.
    best = F.max(F.struct(F.col("_pb").alias("browser"), F.col("_po").alias("operating_system")))
    return [best["browser"].alias("browser"), best["operating_system"].alias("operating_system")]


def user_day_facts(events: DataFrame, segment: SegmentSpec | None = None,
                   cutoff: _dt.date | None = None, with_segment_columns: bool = True,
                   paired: bool = False) -> DataFrame:
    """Per purchasing user-day facts from normalised events.

    ``segment`` filters events on browser/OS *before* both the first event
    and the first purchase are taken (the by-segment analysis). ``cutoff``
    may be applied to all events up front: first event and first purchase
    are required on the same date, so this equals the reference's late
    filter on the purchase date.

    Browser and OS of the purchases are a MAX over strings, which has no
    fixed-width aggregation buffer (Spark would sort every event row for it).
    They are therefore taken in two levels: a hash aggregate keyed by
    (user, day, purchase browser, purchase OS) collapses the events map-side,
    and the string MAX runs over those few rows per user-day only. Callers
    that do not need the columns (``with_segment_columns=False``) get the
    single-level aggregate. The two MAX are independent, so they can form a
    pair that no purchase had; ``paired=True`` takes the greatest pair.
    """
    ev = events.where(segment_filter(segment)) if segment is not None else events
    ev = until(ev, cutoff)
    is_purchase = F.col("event_name") == PURCHASE
    rev = F.when(is_purchase, F.col("purchase_revenue_in_usd"))
    partial = [
        F.min("event_us").alias("first_event_us"),
        F.min(F.when(is_purchase, F.col("event_us"))).alias("first_purchase_us"),
        F.count(rev).alias("revenue_events"),
        money_sum(money(rev)).alias("revenue"),
    ]
    if with_segment_columns:
        lvl1 = ev.groupBy("user_pseudo_id", "event_date",
                          F.when(is_purchase, F.col("browser")).alias("_pb"),
                          F.when(is_purchase, F.col("operating_system")).alias("_po")).agg(*partial)
        agg = lvl1.groupBy("user_pseudo_id", "event_date").agg(
            F.min("first_event_us").alias("first_event_us"),
            F.min("first_purchase_us").alias("first_purchase_us"),
            *_segment_of_purchases(paired),
            F.sum("revenue_events").alias("revenue_events"),
            money_sum(F.col("revenue")).alias("revenue"),
        )
        seg_cols = ["browser", "operating_system"]
    else:
        agg = ev.groupBy("user_pseudo_id", "event_date").agg(*partial)
        seg_cols = []
    agg = agg.where(F.col("first_purchase_us").isNotNull())
    micros = round_money(F.col("revenue"), F.col("revenue_events"), 6)
    return agg.select(
        "user_pseudo_id",
        "event_date",
        F.timestamp_micros("first_event_us").alias("first_event_time"),
        F.timestamp_micros("first_purchase_us").alias("first_purchase_time"),
        minutes_between(F.col("first_event_us"), F.col("first_purchase_us")).alias("minutes_to_purchase"),
        *seg_cols,
        micros.alias("revenue_micros"),
        (micros.cast("double") / MICRO_DOLLARS).alias("avg_purchase_revenue"),
    )


def purchase_revenue_user_day(events: DataFrame, cutoff: _dt.date | None = None) -> DataFrame:
    """Average purchase revenue per (user, day) over purchase rows."""
    is_purchase = F.col("event_name") == PURCHASE
    rev = until(events, cutoff).where(is_purchase).groupBy("user_pseudo_id", "event_date").agg(
        F.count("purchase_revenue_in_usd").alias("revenue_events"),
        money_sum(money(F.col("purchase_revenue_in_usd"))).alias("revenue"),
    )
    micros = round_money(F.col("revenue"), F.col("revenue_events"), 6)
    return rev.select("user_pseudo_id", "event_date",
                      (micros.cast("double") / MICRO_DOLLARS).alias("purchase_revenue_in_usd"),
                      "revenue_events")
