"""Checkout-label expressions shared by the sequence operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartlane.config import PAGE_VIEW, CheckoutSpec

# --- fixed values: output names of the lag columns ----------------------------
LAG_NAMES = ("one_event_before", "two_events_before", "three_events_before",
             "four_events_before", "five_events_before")
# ------------------------------------------------------------------------------


def lag_names(n: int) -> list[str]:
    if n <= len(LAG_NAMES):
        return list(LAG_NAMES[:n])
    return list(LAG_NAMES) + [f"event_{i}_before" for i in range(len(LAG_NAMES) + 1, n + 1)]


def keep_predicate(spec: CheckoutSpec) -> Column:
    """Drop noise events and page views of pages outside the checkout list.

    Three-valued logic as in SQL: a NULL event name, or a page view with a
    NULL title, evaluates to NULL and is dropped by the filter."""
    name = F.col("event_name")
    return (~name.isin(*spec.noise)) & ((name != PAGE_VIEW) | F.col("page_title").isin(*spec.pages))


def label_expr(spec: CheckoutSpec) -> Column:
    name = F.col("event_name")
    return F.when((name == PAGE_VIEW) & F.col("page_title").isin(*spec.pages),
                  F.col("page_title")).otherwise(name)


def occurrences(cols: list[str], value: str) -> Column:
    """How many of ``cols`` equal ``value`` (NULL counts as no match)."""
    return reduce(lambda a, b: a + b,
                  [F.when(F.col(c) == value, 1).otherwise(0) for c in cols]).cast("int")
