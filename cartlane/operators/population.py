"""D1 population counts and D6 missing-step share.

Both are per-user flags (a partial aggregate on user, then a global count),
instead of several COUNT(DISTINCT ...) with different filters, which Spark
would plan as an Expand that multiplies the rows.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlane.config import BEGIN_CHECKOUT, INFORMATION_PAGE, PAGE_VIEW, PURCHASE
from cartlane.functions.numeric import round2_ratio
from cartlane.operators.events import until


def population_counts(events: DataFrame, cutoff: _dt.date | None = None) -> DataFrame:
    """Unique users, users who began checkout, users who purchased."""
    name = F.col("event_name")
    per_user = until(events, cutoff).groupBy("user_pseudo_id").agg(
        F.bool_or(name == BEGIN_CHECKOUT).alias("_bc"), F.bool_or(name == PURCHASE).alias("_p"))
    return per_user.agg(
        F.count(F.lit(1)).alias("unique_users"),
        F.count_if(F.col("_bc")).alias("checkout_initiators"),
        F.count_if(F.col("_p")).alias("purchasers"),
    )


def missing_step_share(events: DataFrame, page: str = INFORMATION_PAGE,
                       cutoff: _dt.date | None = None) -> DataFrame:
    """Checkout starters with no page view of ``page`` and their share."""
    name = F.col("event_name")
    per_user = until(events, cutoff).where(
        (name == BEGIN_CHECKOUT) | ((name == PAGE_VIEW) & (F.col("page_title") == page))
    ).groupBy("user_pseudo_id").agg(
        F.bool_or(name == BEGIN_CHECKOUT).alias("_bc"), F.bool_or(name == PAGE_VIEW).alias("_page"))
    counts = per_user.agg(
        F.count_if(F.col("_bc")).alias("checkout_starters"),
        F.count_if(F.col("_bc") & ~F.col("_page")).alias("missing_page_starters"),
    )
    return counts.select("checkout_starters", "missing_page_starters",
                         round2_ratio(F.col("missing_page_starters") * 100, F.col("checkout_starters"))
                         .alias("missing_share_prct"))
