"""Mergeable daily partials: reports that are refreshed by day instead of being computed anew.

``daily_partials`` reduces the events of some days to a few rows a day. Rows of different days never depend on each
other, so ``write_days`` replaces exactly the days that it is given (dynamic partition overwrite) and leaves the others'
files alone. The reports add the partials up and equal those over all events:

- time to purchase per day and per segment (W4, W5, A10-A12): purchases and whole minutes;
- funnel counts (W6): events per step and segment;
- average order value (W14): exact revenue and purchase events;
- distinct users, approximately (A8, D1, the user sibling of W6): sketches that merge over days. A user of several days
  counts once, which counts per day cannot give. Opt-in: the exact operators stay the default. The estimate's relative
  standard error is ``1.04 / sqrt(2 ** SKETCH_BITS)``, 1.6 % at 12 bits (about 4 KB a sketch); small sets are exact.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlane.config import BEGIN_CHECKOUT, DEFAULTS, PURCHASE, FunnelSpec, SegmentSpec
from cartlane.functions.numeric import MONEY, money, money_sum
from cartlane.operators.duration import present, purchase_views, summarize_daily, daily_rows
from cartlane.operators.events import until
from cartlane.operators.facts import segment_filter
from cartlane.operators.funnel import pivot

SKETCH_BITS = 12
# --- what a partial row is about ---
DURATION, SEGMENT_DURATION, FUNNEL, PURCHASES, USERS = "duration", "segment_duration", "funnel", "purchases", "users"
ALL_USERS = "all"
COLUMNS = {"kind": "string", "step": "string", "browser": "string", "operating_system": "string", "n": "long",
           "minutes": "long", "revenue": MONEY, "users": "binary"}


def _rows(df: DataFrame, kind: str | Column) -> DataFrame:
    """Partial rows of a kind: the columns that it lacks are NULL."""
    held = {**{c: F.col(c) for c in df.columns}, "kind": F.lit(kind)}
    return df.select("event_date", *[held.get(c, F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def _sketch(user: Column) -> Column:
    return F.hll_sketch_agg(user, SKETCH_BITS)


def daily_partials(events: DataFrame, segment: SegmentSpec = DEFAULTS.segment, funnel: FunnelSpec = DEFAULTS.funnel) -> DataFrame:
    """Per day: event_date, kind, step, browser, operating_system, n, minutes, revenue, users. ``events`` holds whole
    days."""
    if tuple(segment.keys) != ("browser", "operating_system") or tuple(funnel.segment.keys) != tuple(segment.keys):
        raise ValueError("partials are kept by browser and operating_system")
    keys, name = list(segment.keys), F.col("event_name")
    views = purchase_views(events, segment).groupBy("_all", "event_date", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("minutes_to_purchase").alias("minutes"))
    timed = _rows(views, F.when(F.col("_all"), DURATION).otherwise(SEGMENT_DURATION))
    cells = events.where(segment_filter(funnel.segment) & name.isin(*funnel.steps)).groupBy(
        "event_date", name.alias("step"), *keys).agg(F.count("user_pseudo_id").alias("n"), _sketch(F.col("user_pseudo_id")).alias("users"))
    paid = events.where(name == PURCHASE).groupBy("event_date").agg(
        F.count("purchase_revenue_in_usd").alias("n"), money_sum(money(F.col("purchase_revenue_in_usd"))).alias("revenue"))
    steps = F.when(name.isin(BEGIN_CHECKOUT, PURCHASE), F.array(F.lit(ALL_USERS), name)).otherwise(F.array(F.lit(ALL_USERS)))
    users = events.select("event_date", "user_pseudo_id", F.explode(steps).alias("step")).groupBy("event_date", "step").agg(
        _sketch(F.col("user_pseudo_id")).alias("users"))
    return reduce(DataFrame.unionByName, [timed, _rows(cells, FUNNEL), _rows(paid, PURCHASES), _rows(users, USERS)])


def write_days(events: DataFrame, path: str) -> str:
    """Compute the partials of the days in ``events`` and replace those days in the table at ``path``, no others."""
    daily_partials(events).repartition("event_date").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    return path


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _of(partials: DataFrame, kind: str, cutoff: _dt.date | None = None) -> DataFrame:
    return until(partials.where(F.col("kind") == kind), cutoff)


def purchase_duration(partials: DataFrame, cutoff: _dt.date | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """W4 from partials; with the segment's keys W5."""
    rows = _of(partials, SEGMENT_DURATION if keys else DURATION, cutoff)
    daily = daily_rows(rows.groupBy("event_date", *keys).agg(
        F.sum("n").alias("no_of_purchases"), F.sum("minutes").alias("total_minutes")), keys)
    cols = ["purchase_date", "avg_minutes_to_purchase", "no_of_purchases", *keys]
    out = daily.select(*cols, F.lit("Daily").alias("result_type")).unionByName(
        summarize_daily(daily, keys).select(*cols, F.lit("Overall").alias("result_type")))
    return present(out, F.asc_nulls_first("purchase_date"), *keys)


def funnel_counts(partials: DataFrame, spec: FunnelSpec = DEFAULTS.funnel) -> DataFrame:
    """W6 from partials."""
    keys = list(spec.segment.keys)
    cells = _of(partials, FUNNEL).groupBy(F.col("step").alias("event_name"), *keys).agg(F.sum("n").alias("user_events"))
    return present(pivot(cells.where(F.col("user_events") > spec.min_count), "user_events", spec), *keys)


def average_order_value(partials: DataFrame, cutoff: _dt.date | None = None) -> DataFrame:
    """W14 from partials."""
    total = _of(partials, PURCHASES, cutoff).agg(money_sum(F.col("revenue")).alias("revenue"), F.sum("n").alias("n"))
    return total.select((F.col("revenue").cast("double") / F.when(F.col("n") > 0, F.col("n"))).alias("aov"),
                        F.coalesce("n", F.lit(0).cast("long")).alias("purchase_events"))


def _users(sketch: str = "users") -> Column:
    return F.hll_sketch_estimate(F.hll_union_agg(sketch))


def approximate_population(partials: DataFrame, cutoff: _dt.date | None = None) -> DataFrame:
    """D1, approximately: distinct users, checkout initiators and purchasers over the days."""
    counts = _of(partials, USERS, cutoff).groupBy("step").agg(_users().alias("n"))
    at = lambda step: F.coalesce(F.max(F.when(F.col("step") == step, F.col("n"))), F.lit(0).cast("long"))
    return counts.agg(at(ALL_USERS).alias("unique_users"), at(BEGIN_CHECKOUT).alias("checkout_initiators"),
                      at(PURCHASE).alias("purchasers"))


def approximate_funnel_users(partials: DataFrame, spec: FunnelSpec = DEFAULTS.funnel) -> DataFrame:
    """Distinct users per funnel step and segment, approximately."""
    keys = list(spec.segment.keys)
    cells = _of(partials, FUNNEL).groupBy(F.col("step").alias("event_name"), *keys).agg(_users().alias("users"))
    return present(pivot(cells, "users", spec), *keys)
