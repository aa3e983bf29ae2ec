"""W6 / W7 funnel counts and rates per browser/OS, D7 drop-off, D8 side by
side, and the user-count sibling of the funnel.

Both aggregations run on partial aggregates: the first collapses events to
(step, browser, OS) cells on the map side, so the shuffles carry a few rows
per task whatever the event volume. The pivot is a conditional sum over a
fixed step list (never a value-discovering ``pivot``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlane.config import DEFAULTS, FunnelSpec
from cartlane.functions.numeric import round2_ratio, round_half_up_ratio
from cartlane.operators.facts import segment_filter
from cartlane.operators.duration import present

# --- fixed values: output names of the rate columns -------------------------
RATE_NAMES = {
    "first_visit": "prct_first_visit",
    "add_to_cart": "prct_add_to_cart",
    "begin_checkout": "prct_begin_checkout",
    "add_shipping_info": "prct_add_shipping",
    "add_payment_info": "prct_add_payment",
    "purchase": "prct_purchase",
}
# -----------------------------------------------------------------------------


def rate_name(step: str) -> str:
    return RATE_NAMES.get(step, f"prct_{step}")


def pivot(cells: DataFrame, value: str, spec: FunnelSpec) -> DataFrame:
    keys = list(spec.segment.keys)
    return cells.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("event_name") == s, F.col(value)).otherwise(F.lit(0))).cast("long").alias(s)
        for s in spec.steps])


def funnel_counts(events: DataFrame, spec: FunnelSpec = DEFAULTS.funnel) -> DataFrame:
    """Events per funnel step and segment; cells with at most
    ``min_count`` events are dropped (they count 0, and a segment with no
    remaining cell disappears) -- the reference's 'single-event' filter."""
    keys = list(spec.segment.keys)
    ev = events.where(segment_filter(spec.segment) & F.col("event_name").isin(*spec.steps))
    cells = ev.groupBy("event_name", *keys).agg(F.count("user_pseudo_id").alias("user_events"))
    cells = cells.where(F.col("user_events") > spec.min_count)
    return present(pivot(cells, "user_events", spec), *keys)


def funnel_users(events: DataFrame, spec: FunnelSpec = DEFAULTS.funnel) -> DataFrame:
    """Distinct users per funnel step and segment (what the reference's
    header describes; its code counts events)."""
    keys = list(spec.segment.keys)
    ev = events.where(segment_filter(spec.segment) & F.col("event_name").isin(*spec.steps))
    pairs = ev.select("event_name", *keys, "user_pseudo_id").distinct()
    cells = pairs.groupBy("event_name", *keys).agg(F.count(F.lit(1)).alias("users"))
    return present(pivot(cells, "users", spec), *keys)


def _rates(counts: DataFrame, spec: FunnelSpec, strict: bool = False) -> list:
    base = F.col(spec.base)
    if strict:
        base = F.when(base == 0, F.raise_error(F.lit(f"funnel segment without {spec.base}")).cast("long")).otherwise(base)
    return [round2_ratio(F.col(s) * 100, base).alias(rate_name(s)) for s in spec.steps]


def funnel_rates(events: DataFrame, spec: FunnelSpec = DEFAULTS.funnel, strict: bool = False) -> DataFrame:
    """Each step as a percentage of the base step (first_visit), two
    decimals; NULL where the base is 0, or an error with ``strict``."""
    counts = funnel_counts(events, spec)
    keys = list(spec.segment.keys)
    return counts.select(*reversed(keys), *_rates(counts, spec, strict))


def funnel_counts_and_rates(events: DataFrame, spec: FunnelSpec = DEFAULTS.funnel) -> DataFrame:
    """Counts and rates side by side. The dashboard joined the two
    results on (browser, OS); both come from the same counts, so here they
    are columns of one plan and no join is needed."""
    counts = funnel_counts(events, spec)
    keys = list(spec.segment.keys)
    return counts.select(*keys, *spec.steps, *_rates(counts, spec))


def funnel_step_dropoff(events: DataFrame, spec: FunnelSpec = DEFAULTS.funnel) -> DataFrame:
    """Step-to-step conversion and drop-off, one row per segment and
    step (from the second step on)."""
    counts = funnel_counts(events, spec)
    keys = list(spec.segment.keys)
    pairs = F.array(*[
        F.struct(F.lit(i + 1).alias("step_index"), F.lit(spec.steps[i]).alias("step"),
                 F.lit(spec.steps[i - 1]).alias("previous_step"),
                 F.col(spec.steps[i]).alias("events"), F.col(spec.steps[i - 1]).alias("previous_events"))
        for i in range(1, len(spec.steps))])
    long = counts.select(*keys, F.inline(pairs))
    conv = round_half_up_ratio(F.col("events") * 100, F.col("previous_events"), 100)
    return long.select(
        *keys, "step_index", "step", "previous_step", "events", "previous_events",
        (conv.cast("double") / 100).alias("prct_of_previous"),
        ((F.lit(10000) - conv).cast("double") / 100).alias("dropoff_prct"),
    )
