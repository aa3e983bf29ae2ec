"""W4 / W5 time to purchase per day (and per segment) with summary rows, D9.

Summary rows are the reference's estimator: the mean of the already rounded
daily means, not a mean over purchases. Detail and summary are two small
aggregates stacked by name (not a ROLLUP, whose total would be the mean over
purchases).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlane.config import DEFAULTS, PURCHASE, SegmentSpec
from cartlane.functions.numeric import cents_of, round2_ratio, round_half_up_ratio
from cartlane.functions.numeric import minutes_between
from cartlane.operators.events import until
from cartlane.operators.facts import segment_filter, user_day_facts


def present(df: DataFrame, *order) -> DataFrame:
    """Final ORDER BY of a result (a distributed range-partitioned sort)."""
    return df.orderBy(*order)


def daily_duration(facts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per (date, *keys): purchases and rounded mean minutes, plus the cents
    integer of the mean (input of the summary)."""
    return daily_rows(facts.groupBy("event_date", *keys).agg(
        F.count(F.lit(1)).alias("no_of_purchases"),
        F.sum("minutes_to_purchase").alias("total_minutes"),
    ), keys)


def daily_rows(d: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Daily means from (event_date, *keys, no_of_purchases, total_minutes)."""
    return d.select(
        F.col("event_date").alias("purchase_date"),
        round2_ratio(F.col("total_minutes"), F.col("no_of_purchases")).alias("avg_minutes_to_purchase"),
        "no_of_purchases",
        *keys,
        cents_of(F.col("total_minutes"), F.col("no_of_purchases")).alias("avg_cents"),
    )


def summarize_daily(daily: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of rounded daily means (rounded) and total purchases per *keys."""
    s = daily.groupBy(*keys).agg(
        F.sum("avg_cents").alias("sum_cents"),
        F.count(F.lit(1)).alias("days"),
        F.sum("no_of_purchases").alias("no_of_purchases"),
    )
    return s.select(
        F.lit(None).cast("date").alias("purchase_date"),
        round2_ratio(F.col("sum_cents"), F.col("days") * 100).alias("avg_minutes_to_purchase"),
        "no_of_purchases",
        *keys,
        round_half_up_ratio(F.col("sum_cents"), F.col("days"), 1).alias("avg_cents"),
    )


def purchase_duration_from_facts(facts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    daily = daily_duration(facts, keys)
    cols = ["purchase_date", "avg_minutes_to_purchase", "no_of_purchases", *keys]
    out = daily.select(*cols, F.lit("Daily").alias("result_type")).unionByName(
        summarize_daily(daily, keys).select(*cols, F.lit("Overall").alias("result_type")))
    return present(out, F.asc_nulls_first("purchase_date"), *keys)


def purchase_duration(events: DataFrame, cutoff: _dt.date | None = None) -> DataFrame:
    """Daily mean minutes from first event of the day to first purchase
    of the day, and one 'Overall' row."""
    return purchase_duration_from_facts(user_day_facts(events, cutoff=cutoff, with_segment_columns=False))


def purchase_duration_by(events: DataFrame, segment: SegmentSpec = DEFAULTS.segment,
                         cutoff: _dt.date | None = None) -> DataFrame:
    """As W4 per browser/OS segment; the segment filter applies to the
    first event as well as to the purchase."""
    facts = user_day_facts(events, segment=segment, cutoff=cutoff)
    return purchase_duration_from_facts(facts, tuple(segment.keys))


def purchase_weighted_duration(events: DataFrame, cutoff: _dt.date | None = None) -> DataFrame:
    """Mean minutes to purchase over purchasing user-days (one row), beside
    the mean of rounded daily means that the summary rows give."""
    facts = user_day_facts(events, cutoff=cutoff, with_segment_columns=False)
    total = facts.agg(F.sum("minutes_to_purchase").alias("m"), F.count(F.lit(1)).alias("no_of_purchases"))
    return total.select(round2_ratio(F.col("m"), F.col("no_of_purchases")).alias("avg_minutes_to_purchase"),
                        "no_of_purchases")


def purchase_views(ev: DataFrame, segment: SegmentSpec = DEFAULTS.segment) -> DataFrame:
    """Minutes to purchase of every purchasing user-day, once for all traffic
    (``_all``) and once for the segment-filtered traffic with its segment.

    A single ``groupBy(user, day)`` computes both side by side; a generator
    splits them into two views."""
    keys = tuple(segment.keys)
    is_p = F.col("event_name") == PURCHASE
    in_seg = segment_filter(segment)
    # Two levels so that the string MAX runs on collapsed rows (see
    # facts.user_day_facts): hash aggregate keyed by the purchase segment
    # values first, then the per-day aggregate.
    lvl1 = ev.groupBy("user_pseudo_id", "event_date",
                      *[F.when(is_p & in_seg, F.col(k)).alias(f"_{k}") for k in keys]).agg(
        F.min("event_us").alias("fe_all"),
        F.min(F.when(is_p, F.col("event_us"))).alias("fp_all"),
        F.min(F.when(in_seg, F.col("event_us"))).alias("fe_seg"),
        F.min(F.when(is_p & in_seg, F.col("event_us"))).alias("fp_seg"),
    )
    per_day = lvl1.groupBy("user_pseudo_id", "event_date").agg(
        *[F.min(c).alias(c) for c in ("fe_all", "fp_all", "fe_seg", "fp_seg")],
        *[F.max(f"_{k}").alias(k) for k in keys],
    )
    views = F.array(
        F.struct(F.lit(True).alias("_all"), F.col("fe_all").alias("fe"), F.col("fp_all").alias("fp"),
                 *[F.lit(None).cast("string").alias(k) for k in keys]),
        F.struct(F.lit(False).alias("_all"), F.col("fe_seg").alias("fe"), F.col("fp_seg").alias("fp"),
                 *[F.col(k).alias(k) for k in keys]),
    )
    return per_day.select("event_date", F.inline(views)).where(F.col("fp").isNotNull()).select(
        "_all", "event_date", *keys, minutes_between(F.col("fe"), F.col("fp")).alias("minutes_to_purchase"))


def _segment_summaries(events: DataFrame, segment: SegmentSpec, cutoff: _dt.date | None) -> DataFrame:
    """Summary rows of all traffic (``_all``) and of every segment in one pass;
    both views share the daily and summary aggregates."""
    keys = ("_all", *segment.keys)
    return summarize_daily(daily_duration(purchase_views(until(events, cutoff), segment), keys), keys)


def segment_gaps(events: DataFrame, segment: SegmentSpec = DEFAULTS.segment,
                 cutoff: _dt.date | None = None) -> DataFrame:
    """Every segment's summary time to purchase and its gap to the all-traffic
    summary. One global aggregate over the segment summaries (at most browsers
    x systems rows) puts the all-traffic row beside the others: no join."""
    keys = tuple(segment.keys)
    entry = F.struct(*keys, "avg_minutes_to_purchase", "no_of_purchases", "avg_cents")
    red = _segment_summaries(events, segment, cutoff).agg(
        F.collect_list(F.when(~F.col("_all"), entry)).alias("_segments"),
        F.max(F.when(F.col("_all"), F.col("avg_minutes_to_purchase"))).alias("overall_avg_minutes"),
        F.max(F.when(F.col("_all"), F.col("avg_cents"))).alias("_oc"))
    rows = red.select("overall_avg_minutes", "_oc", F.inline("_segments"))
    return rows.select(*keys, "avg_minutes_to_purchase", "no_of_purchases", "overall_avg_minutes",
                       ((F.col("avg_cents") - F.col("_oc")).cast("double") / 100).alias("gap_minutes"))


def slowest_segment(events: DataFrame, segment: SegmentSpec = DEFAULTS.segment,
                    cutoff: _dt.date | None = None) -> DataFrame:
    """The segment with the highest summary time to purchase (ties: the
    first by name) and its gap to the all-traffic summary."""
    gaps = segment_gaps(events, segment, cutoff)
    top = gaps.agg(F.min_by(F.struct(*gaps.columns), F.struct(-F.col("gap_minutes"), *segment.keys)).alias("_top"))
    return top.where("_top is not null").select("_top.*")
