"""W1 normalisation and W2 checkout labelling (both narrow: no shuffle)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlane.config import DEFAULTS, CheckoutSpec
from cartlane.functions.labels import keep_predicate, label_expr

NORMALIZED_COLUMNS = ("user_pseudo_id", "event_name", "page_title", "event_date", "event_timestamp",
                      "event_us", "browser", "operating_system", "purchase_revenue_in_usd", "event_seq")

#: What orders tied events of a table that has no sequence of its own.
CONTENT_ORDER = "concat_ws('|', event_date, event_name, page_title)"


def normalize_events(raw: DataFrame, on_null_user: str = "raise", lenient_dates: bool = False,
                     also: tuple[str, ...] = ()) -> DataFrame:
    """Typed view of raw events.

    ``event_date`` becomes a DATE parsed from the stored ``yyyyMMdd`` string
    (never recomputed from the timestamp), ``event_timestamp`` a UTC
    TIMESTAMP; ``event_us`` keeps the epoch microseconds for exact
    arithmetic. ``user_pseudo_id`` must be non-NULL (it is the key of every
    operator and makes the reference's ``NOT IN`` equal to an anti-join):
    ``on_null_user`` is ``"raise"`` (default) or ``"drop"``; ``sources.rejects``
    keeps such rows beside the events. Columns in ``also`` stay as they are.

    A table without ``event_seq`` gets one from its content (``CONTENT_ORDER``):
    of events at one time the order is that of date, name and title. These fix an
    event's label, so tied rows that are still equal can change places without
    changing any result, and the order does not depend on files or partitions.
    """
    if "event_seq" not in raw.columns:
        raw = raw.withColumn("event_seq", F.expr(CONTENT_ORDER))
    if on_null_user == "raise":
        user = ("CASE WHEN user_pseudo_id IS NULL THEN raise_error('raw_events: NULL user_pseudo_id') "
                "ELSE user_pseudo_id END AS user_pseudo_id")
    elif on_null_user == "drop":
        raw = raw.where("user_pseudo_id IS NOT NULL")
        user = "user_pseudo_id"
    else:
        raise ValueError("on_null_user must be 'raise' or 'drop'")
    parse = "try_to_date" if lenient_dates else "to_date"
    return raw.selectExpr(
        user,
        "event_name",
        "page_title",
        f"{parse}(event_date, 'yyyyMMdd') AS event_date",
        "timestamp_micros(event_timestamp) AS event_timestamp",
        "event_timestamp AS event_us",
        "browser",
        "operating_system",
        "purchase_revenue_in_usd",
        "event_seq",
        *also,
    )


def until(df: DataFrame, cutoff: _dt.date | None, col: str = "event_date") -> DataFrame:
    """Inclusive upper date bound (no-op for ``None``)."""
    return df if cutoff is None else df.where(F.col(col) <= F.lit(cutoff))


def label_checkout_events(events: DataFrame, spec: CheckoutSpec = DEFAULTS.checkout) -> DataFrame:
    """Drop noise and non-checkout page views; add ``event_label`` (the page
    title for the checkout pages, the event name otherwise)."""
    return events.where(keep_predicate(spec)).select(
        "user_pseudo_id", "event_name", "event_date", "event_timestamp", "event_us", "event_seq",
        "browser", "operating_system", "purchase_revenue_in_usd",
        label_expr(spec).alias("event_label"),
    )
