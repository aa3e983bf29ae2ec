"""W8 clean-path user-days, W9 clean path vs overall, W15 AOV candidates,
D10 clean-path speed-up.

A user-day is *clean* when it has a begin_checkout, each checkpoint
(add_shipping_info, Payment Method, add_payment_info) occurs exactly once
at or after the first begin_checkout of that day, and the user purchased on
that day (at any time of the day).

Plan: one scan, no join. "Exactly once at or after the checkout" needs only the
first checkout time and, per checkpoint, the two latest timestamps: the latest
must not be before the checkout, the second latest must be. So a first partial
aggregate keeps one row per (user, day) with the day's facts and one per
checkpoint timestamp, a rank keeps the two latest of them (Spark cuts them
map-side, before the shuffle), and a last aggregate puts them beside the facts.
A hot user-day leaves every map task as a few rows.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlane.config import BEGIN_CHECKOUT, DEFAULTS, PURCHASE, CheckoutSpec
from cartlane.functions.labels import keep_predicate, label_expr
from cartlane.functions.numeric import (MONEY, mean_money, minutes_between, money, money_sum, round2_ratio,
                                        round_half_up_ratio, round_money)
from cartlane.operators.duration import present
from cartlane.operators.events import until
from cartlane.operators.skew import hot_keys, renamed, same

KEY = ["user_pseudo_id", "event_date"]
#: Rows of a user-day that one task takes as a list.
DAY_ROWS = 1_000_000
# --- fixed values: output names of the checkpoint counters --------------------
COUNT_NAMES = {"add_shipping_info": "add_shipping_count", "Payment Method": "payment_page_count",
               "add_payment_info": "payment_info_count"}
# ------------------------------------------------------------------------------


def _count_name(label: str) -> str:
    return COUNT_NAMES.get(label, label.lower().replace(" ", "_") + "_count")


def checkout_start(labeled: DataFrame) -> DataFrame:
    """First begin_checkout per (user, day)."""
    return labeled.where(F.col("event_label") == BEGIN_CHECKOUT).groupBy(*KEY).agg(
        F.min("event_us").alias("checkout_us"))


def checkpoint_counts(labeled: DataFrame, spec: CheckoutSpec = DEFAULTS.checkout,
                      most_rows: int | None = DAY_ROWS) -> DataFrame:
    """Per user-day with a begin_checkout: checkpoint occurrences at or after
    the first begin_checkout, and whether the user purchased that day.

    An ordinary user-day is one row of an aggregate: its first checkout beside
    the times of its checkpoints, which are then counted in place (one scan, one
    shuffle, no join, no window). A user-day of more than about ``most_rows`` rows
    would be a list too long for a task: those (found on a sample) get their
    first checkout by a broadcast of the few hot days' facts, and their
    occurrences are counted map-side. With None no user-day is taken as hot."""
    label, begin = F.col("event_label"), F.col("event_label") == BEGIN_CHECKOUT
    rows = labeled.where(label.isin(BEGIN_CHECKOUT, PURCHASE, *spec.checkpoints)).select(*KEY, "event_label", "event_us")
    first = F.min(F.when(begin, F.col("event_us"))).alias("checkout_us")
    purchased = F.bool_or(label == PURCHASE).alias("purchased")
    names = [_count_name(c) for c in spec.checkpoints]
    hot = hot_keys(rows, KEY, most_rows) if most_rows else None
    keys = None if hot is None else F.broadcast(renamed(hot, KEY, "_h_"))

    def listed(rows: DataFrame) -> DataFrame:
        times = [F.collect_list(F.when(label == c, F.col("event_us"))).alias(name)
                 for c, name in zip(spec.checkpoints, names, strict=True)]
        days = rows.groupBy(*KEY).agg(first, purchased, *times).where("checkout_us IS NOT NULL")
        after = [F.size(F.filter(name, lambda us: us >= F.col("checkout_us"))).cast("long").alias(name) for name in names]
        return days.select(*KEY, "checkout_us", *after, "purchased")

    def counted(rows: DataFrame) -> DataFrame:
        facts = rows.groupBy(*KEY).agg(first, purchased).where("checkout_us IS NOT NULL")
        dated = rows.join(F.broadcast(renamed(facts, [*KEY, "purchased"], "_f_")), same(KEY, "_f_"))
        counts = [F.count_if((label == c) & (F.col("event_us") >= F.col("checkout_us"))).alias(name)
                  for c, name in zip(spec.checkpoints, names, strict=True)]
        return dated.groupBy(*KEY).agg(F.first("checkout_us").alias("checkout_us"), *counts,
                                       F.first("_f_purchased").alias("purchased"))

    if keys is None:
        days = listed(rows)
    else:
        days = listed(rows.join(keys, same(KEY, "_h_"), "left_anti")).unionByName(
            counted(rows.join(keys, same(KEY, "_h_"), "left_semi")))
    return days.select(*KEY, F.timestamp_micros("checkout_us").alias("checkout_time"), *names, "purchased")


def _day_paths(rows: DataFrame, label: Column, checkpoint: Column, facts: dict[str, Column],
               spec: CheckoutSpec) -> DataFrame:
    """Per (user, day): the partial aggregates ``facts``, the first checkout
    and ``clean`` (without the purchase condition). ``checkpoint`` marks the
    rows that also count as a checkpoint occurrence."""
    kinds = F.when(checkpoint, F.array(F.lit(None).cast("string"), label)).otherwise(F.array(F.lit(None).cast("string")))
    split = rows.withColumn("_cp", F.explode(kinds))
    split = split.withColumn("_us", F.when(F.col("_cp").isNotNull(), F.col("event_us")))
    own = {**facts, "checkout_us": F.min(F.when(label == BEGIN_CHECKOUT, F.col("event_us")))}
    partial = split.groupBy(*KEY, "_cp", "_us").agg(*[f.alias(k) for k, f in own.items()],
                                                    F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*KEY, "_cp").orderBy(F.desc("_us")))
    latest = partial.withColumn("_rank", rank).where(F.col("_rank") <= 2)

    def at(c: str, k: int, value: str) -> Column:
        return F.max(F.when((F.col("_cp") == c) & (F.col("_rank") == k), F.col(value)))

    days = latest.groupBy(*KEY).agg(
        *[F.max(F.when(F.col("_cp").isNull(), F.col(k))).alias(k) for k in own],
        *[at(c, k, v).alias(f"{v}{k}_{i}") for i, c in enumerate(spec.checkpoints)
          for k, v in ((1, "_us"), (1, "_n"), (2, "_us"))])
    once = [(F.col(f"_us1_{i}") >= F.col("checkout_us")) & (F.col(f"_n1_{i}") == 1)
            & (F.col(f"_us2_{i}").isNull() | (F.col(f"_us2_{i}") < F.col("checkout_us")))
            for i in range(len(spec.checkpoints))]
    clean = reduce(lambda a, b: a & b, once, F.col("checkout_us").isNotNull())
    return days.select(*KEY, *own, F.coalesce(clean, F.lit(False)).alias("clean"))


def clean_path_user_days(labeled: DataFrame, spec: CheckoutSpec = DEFAULTS.checkout) -> DataFrame:
    """Clean (user, day) pairs (no date filter)."""
    label = F.col("event_label")
    rows = labeled.where(label.isin(BEGIN_CHECKOUT, PURCHASE, *spec.checkpoints)).select(*KEY, "event_label", "event_us")
    days = _day_paths(rows, label, label.isin(*spec.checkpoints), {"purchased": F.bool_or(label == PURCHASE)}, spec)
    return days.where(F.col("clean") & F.col("purchased")).select(*KEY)


def purchase_day_paths(events: DataFrame, spec: CheckoutSpec = DEFAULTS.checkout) -> DataFrame:
    """Per purchasing (user, day), at every date: the duration facts, the
    average purchase revenue and whether the day is a clean path."""
    is_purchase = F.col("event_name") == PURCHASE
    # A row's label where it is kept, else NULL; rows of no label still have facts.
    rows = events.select(*KEY, "event_us", F.when(is_purchase, F.col("event_us")).alias("_bought_us"),
                         F.when(is_purchase, money(F.col("purchase_revenue_in_usd"))).alias("_rev"),
                         F.when(keep_predicate(spec), label_expr(spec)).alias("_label"))
    label = F.col("_label")
    facts = {"first_event_us": F.min("event_us"), "first_purchase_us": F.min("_bought_us"),
             "revenue_events": F.count("_rev"), "revenue": money_sum(F.col("_rev"))}
    days = _day_paths(rows, label, F.coalesce(label.isin(*spec.checkpoints), F.lit(False)), facts, spec)
    return days.where(F.col("first_purchase_us").isNotNull()).select(
        *KEY,
        minutes_between(F.col("first_event_us"), F.col("first_purchase_us")).alias("minutes_to_purchase"),
        mean_money(F.col("revenue"), F.col("revenue_events")).cast(MONEY).alias("revenue_mean"),
        "revenue", "revenue_events", "clean")


# --- fixed values: result labels -----------------------------------------------
_KINDS = (("all", "Overall", "Overall Average"), ("cln", "Clean Path", "Clean Path Average"))
# ------------------------------------------------------------------------------


def _daily_both(paths: DataFrame, cutoff: _dt.date | None, fanout: str) -> DataFrame:
    """One row per purchase date with the statistics of both groups.

    ``fanout="reference"`` reproduces the reference, which joins the clean
    daily rows to the clean user-days on the user only: a purchase of a
    user with k clean days (on any date, also after the cutoff) counts k
    times. The multiplicity is applied as a weight (a window over the user's
    purchasing days, bounded by the number of dates), never by materialising
    the pairs. ``fanout="session"`` counts each clean user-day once."""
    if fanout == "reference":
        weight = F.when(F.col("clean"), F.count_if("clean").over(Window.partitionBy("user_pseudo_id")))
    elif fanout == "session":
        weight = F.when(F.col("clean"), F.lit(1))
    else:
        raise ValueError("fanout must be 'reference' or 'session'")
    p = paths.select("event_date", "minutes_to_purchase", "revenue_mean", "revenue", "revenue_events",
                     F.lit(1).cast("long").alias("w_all"), weight.cast("long").alias("w_cln"))
    p = until(p, cutoff)
    has_rev = F.col("revenue_mean").isNotNull()
    aggs = []
    for k, _, _ in _KINDS:
        w = F.col(f"w_{k}")
        aggs += [F.sum(w).alias(f"n_{k}"),
                 F.sum(F.col("minutes_to_purchase") * w).alias(f"m_{k}"),
                 F.sum(F.when(has_rev, w)).alias(f"nr_{k}"),
                 money_sum(F.col("revenue_mean") * w.cast("decimal(9,0)")).alias(f"r_{k}")]
    aggs += [money_sum(F.col("revenue")).alias("revenue"), F.sum("revenue_events").alias("purchase_events")]
    return p.groupBy("event_date").agg(*aggs)


def _kind_rows(daily: DataFrame) -> DataFrame:
    """Daily rows of both groups (a group's row only where it has purchases)."""
    parts = F.array(*[F.struct(
        F.lit(label).alias("result_type"),
        F.col(f"n_{k}").alias("n"), F.col(f"m_{k}").alias("m"),
        F.col(f"nr_{k}").alias("nr"), F.col(f"r_{k}").alias("r"),
        # purchase revenue and count ride on the all-traffic row only (AOV)
        (F.col("revenue") if k == "all" else F.lit(None).cast(MONEY)).alias("revenue"),
        (F.col("purchase_events") if k == "all" else F.lit(None).cast("long")).alias("purchase_events"))
        for k, label, _ in _KINDS])
    rows = daily.select(F.col("event_date").alias("purchase_date"), F.inline(parts)).where(F.col("n") > 0)
    return rows.select(
        "purchase_date",
        round2_ratio(F.col("m"), F.col("n")).alias("avg_minutes_to_purchase"),
        F.col("n").alias("no_of_purchases"),
        (round_money(F.col("r"), F.col("nr"), 2) / 100).alias("avg_revenue"),
        "result_type",
        round_half_up_ratio(F.col("m"), F.col("n"), 100).alias("_mc"),
        round_money(F.col("r"), F.col("nr"), 2).alias("_rc"),
        "revenue", "purchase_events",
    )


def _summary_row(rows: DataFrame) -> DataFrame:
    """One global aggregate over the daily rows of both groups: the inputs
    of both summary rows and of the transaction-weighted AOV."""
    aggs = [money_sum(F.col("revenue")).alias("revenue"), F.sum("purchase_events").alias("purchase_events")]
    for _, label, _ in _KINDS:
        is_k = F.col("result_type") == label
        aggs += [F.sum(F.when(is_k, F.col("_mc"))).alias(f"mc_{label}"),
                 F.count_if(is_k).alias(f"d_{label}"),
                 F.sum(F.when(is_k, F.col("no_of_purchases"))).alias(f"n_{label}"),
                 F.sum(F.when(is_k, F.col("_rc"))).alias(f"rc_{label}"),
                 F.count(F.when(is_k, F.col("_rc"))).alias(f"rd_{label}")]
    return rows.agg(*aggs)


def _summary_structs(s: DataFrame) -> list:
    return [F.struct(
        F.lit(summary).alias("result_type"),
        round2_ratio(F.col(f"mc_{label}"), F.col(f"d_{label}") * 100).alias("avg_minutes_to_purchase"),
        F.col(f"n_{label}").alias("no_of_purchases"),
        round2_ratio(F.col(f"rc_{label}"), F.col(f"rd_{label}") * 100).alias("avg_revenue"),
        round_half_up_ratio(F.col(f"mc_{label}"), F.col(f"d_{label}"), 1).alias("_mc"))
        for _, label, summary in _KINDS]


def _summaries(rows: DataFrame) -> DataFrame:
    """Mean of the rounded daily means per group (one global aggregate)."""
    s = _summary_row(rows)
    return s.select(F.lit(None).cast("date").alias("purchase_date"), F.inline(F.array(*_summary_structs(s))))


def clean_vs_overall(events: DataFrame, cutoff: _dt.date | None = None, fanout: str = "reference",
                     spec: CheckoutSpec = DEFAULTS.checkout) -> DataFrame:
    """Daily 'Overall' and 'Clean Path' rows plus their two summary rows
    (mean of rounded daily means), ordered by date then result type. Takes
    normalised events; checkout labels are derived inside the pass."""
    rows = _kind_rows(_daily_both(purchase_day_paths(events, spec), cutoff, fanout))
    cols = ["purchase_date", "avg_minutes_to_purchase", "no_of_purchases",
            F.col("avg_revenue").alias("overall_avg_revenue_purchase"), "result_type"]
    out = rows.select(*cols).unionByName(_summaries(rows).select(*cols))
    return present(out, F.asc_nulls_first("purchase_date"), "result_type")


def aov_candidates(events: DataFrame, cutoff: _dt.date | None = None,
                   spec: CheckoutSpec = DEFAULTS.checkout) -> DataFrame:
    """The transaction-weighted AOV next to the two rejected
    estimators (mean of daily mean revenue, overall and clean path). All
    three come out of the same one-row summary aggregate; the AOV is the
    exact sum of purchase revenue over the purchase count."""
    s = _summary_row(_kind_rows(_daily_both(purchase_day_paths(events, spec), cutoff, "reference")))
    overall, clean = _summary_structs(s)
    aov = F.col("revenue").cast("double") / F.col("purchase_events")
    rows = F.array(
        F.struct(F.lit("transaction_weighted").alias("candidate"), aov.alias("value"), F.lit(True).alias("chosen")),
        F.struct(F.lit("overall_daily_mean").alias("candidate"), overall["avg_revenue"].alias("value"),
                 F.lit(False).alias("chosen")),
        F.struct(F.lit("clean_path_daily_mean").alias("candidate"), clean["avg_revenue"].alias("value"),
                 F.lit(False).alias("chosen")))
    return s.select(F.inline(rows))


def clean_path_speedup(events: DataFrame, cutoff: _dt.date | None = None, fanout: str = "reference",
                       spec: CheckoutSpec = DEFAULTS.checkout) -> DataFrame:
    """Summary minutes of both groups and the speed-up of the clean
    path in percent, 1 - clean / overall (from the one-row summary)."""
    s = _summary_row(_kind_rows(_daily_both(purchase_day_paths(events, spec), cutoff, fanout)))
    overall, clean = _summary_structs(s)
    return s.select(
        overall["avg_minutes_to_purchase"].alias("overall_avg_minutes"),
        clean["avg_minutes_to_purchase"].alias("clean_avg_minutes"),
        round2_ratio((overall["_mc"] - clean["_mc"]) * 100, overall["_mc"]).alias("speedup_prct"))
