"""Transaction-weighted average order value."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlane.config import PURCHASE
from cartlane.functions.numeric import money
from cartlane.operators.events import until


def average_order_value(events: DataFrame, cutoff: _dt.date | None = None) -> DataFrame:
    """AVG(revenue) over every purchase row (up to ``cutoff``): one row.

    The sum is exact (DECIMAL), so the value does not depend on partitioning
    or row order; a global aggregate is a partial sum per task plus one tiny
    final merge."""
    rev = until(events, cutoff).where(F.col("event_name") == PURCHASE).select(
        money(F.col("purchase_revenue_in_usd")).alias("rev"))
    return rev.agg(
        (F.sum("rev").cast("double") / F.count("rev")).alias("aov"),
        F.count("rev").alias("purchase_events"),
    ).select(F.when(F.col("purchase_events") > 0, F.col("aov")).alias("aov"), "purchase_events")
