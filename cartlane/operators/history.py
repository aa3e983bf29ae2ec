"""W10 event histories: lags that survive a user with a third of all events, and bounded tails for churn.

``history_frame`` gives every labelled event the ``n`` labels before it. Labelled events are shuffled once by user (or
session) and read by one window; ordinary scopes need nothing else. A hot scope (more than ``split_rows`` rows) is cut
into slices of about that many rows:

1. A row sample, sorted per scope, gives splitters over (event_us, event_seq): every ``PER_SLICE``-th sampled row. They
   are quantiles of the rows, so one early event or an empty night moves no slice. At most ``MAX_SLICES`` splitters come
   to the driver; beyond that the sample is thinned, which makes all slices larger alike.
2. Each slice has a window of its own. The last ``n`` labels of every slice, found by a rank that Spark cuts map-side,
   are carried forward over the slices and fill the lags of a slice's first ``n`` rows. They and the scope's last
   timestamp and purchase flag are a table of one row per slice, which is broadcast.

Where slices begin cannot change a result. NULL timestamps sort first, as in an unsplit window. The sample is taken only
where Spark's estimate of the input's size leaves room for a hot scope.

``churn_tails`` serves the operators that look at a user's last events only. A dense rank per scope, purchases first
and then by falling time, is cut to ``n + 1`` levels in every map task, so tails and not histories are shuffled; a scope
that purchased is known by its first row.

The order is total: (event_timestamp, event_seq). The reference orders by timestamp only, which leaves tied events
(Payment Method and add_payment_info fire together) in an arbitrary order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlane.config import DEFAULTS, HISTORY_SPLIT_ROWS, PURCHASE
from cartlane.functions.labels import lag_names
from cartlane.operators.skew import SEED, literal, may_hold, renamed, same

USER = "user_pseudo_id"
LABEL = "event_label"
SESSION = (USER, "event_date")
USER_LAST_US = "_user_last_us"
USER_PURCHASED = "_user_purchased"
BASE = (USER, "event_date", "event_timestamp", "event_us", "event_seq", LABEL)
ORDER = ("event_us", "event_seq")
_SLICE = "_slice"

#: Sampled rows between two splitters, and the most splitters of all hot scopes together.
PER_SLICE, MAX_SLICES = 64, 1 << 16


def hot_slices(base: DataFrame, scope: list[str], split_rows: int) -> DataFrame | None:
    """One row per hot scope: its keys and the sorted array ``_splitters``; None without a hot scope.

    The splitters are collected and put back as a literal table, so every branch of a plan sees the same slices."""
    if not may_hold(base, split_rows):
        return None
    per = min(PER_SLICE, split_rows)
    while True:
        rows = base.select(*scope, *ORDER).sample(fraction=min(1.0, per / split_rows), seed=SEED)
        own = Window.partitionBy(*scope)
        placed = rows.withColumn("_i", F.row_number().over(own.orderBy(*ORDER))).withColumn(
            "_n", F.count(F.lit(1)).over(own))
        # A scope counts as hot from one and a half slices on: a sample's count is off by its square root.
        cuts = placed.where((F.col("_n") * 2 > 3 * per) & (F.col("_i") % per == 0) & (F.col("_i") < F.col("_n")))
        found = cuts.select(*scope, F.struct(*ORDER).alias("_at")).take(MAX_SLICES + 1)
        if len(found) <= MAX_SLICES or per == 1:
            break
        split_rows *= 2
    if not found:
        return None
    by_scope: dict[tuple, list] = {}
    for row in found:
        by_scope.setdefault(tuple(row[k] for k in scope), []).append(row["_at"])
    splitters = T.StructField("_splitters", T.ArrayType(T.StructType([base.schema[c] for c in ORDER])))
    table = literal(base, [(*k, v) for k, v in by_scope.items()], [*(base.schema[k] for k in scope), splitters])
    return table.withColumn("_splitters", F.array_sort("_splitters"))


def _slice_of(splitters: Column, longest: int) -> Column:
    """How many splitters are not after the row, by halving steps."""
    steps = [1 << k for k in reversed(range(max(longest, 1).bit_length()))]
    here = F.struct(*ORDER)

    def further(at: Column, step: Column) -> Column:
        there = at + step
        reached = (there <= F.size(splitters)) & (F.get(splitters, there - 1) <= here)
        return F.when(reached, there).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def _carried(hot_rows: DataFrame, scope: list[str], n: int) -> DataFrame:
    """Per slice of a hot scope: ``_before``, the ``n`` labels before the slice (latest first), and the scope's facts."""
    latest = Window.partitionBy(*scope, _SLICE).orderBy(F.desc_nulls_last(ORDER[0]), F.desc_nulls_last(ORDER[1]))
    tails = hot_rows.select(*scope, _SLICE, *ORDER, LABEL).withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= n)
    slices = tails.groupBy(*scope, _SLICE).agg(F.sort_array(F.collect_list(F.struct("_r", LABEL))).alias("_tail"))
    slices = slices.withColumn("_tail", F.col(f"_tail.{LABEL}"))
    order = Window.partitionBy(*scope).orderBy(_SLICE)
    # Every slice has a row, so the n slices before one have the labels that it can need.
    none = F.array().cast("array<string>")
    earlier = F.flatten(F.array(*[F.coalesce(F.lag("_tail", k).over(order), none) for k in range(1, n + 1)]))
    before = slices.select(*scope, _SLICE, F.slice(earlier, 1, n).alias("_before"))
    facts = hot_rows.groupBy(*scope).agg(F.max("event_us").alias("_last"), F.bool_or(F.col(LABEL) == PURCHASE).alias("_bought"))
    return before.join(F.broadcast(renamed(facts, scope, "_f_")), same(scope, "_f_")).select(
        *scope, _SLICE, "_before", "_last", "_bought")


def marked(frame: DataFrame, n: int, partition_by: tuple[str, ...]) -> DataFrame:
    """``frame`` with its scope and number of lags in a column's metadata, which Parquet keeps."""
    return frame.withMetadata(USER_PURCHASED, {"scope": list(partition_by), "lags": n})


def stored(labeled: DataFrame, n: int, partition_by: tuple[str, ...]) -> DataFrame | None:
    """A stored history (``sources.history_store``) cut to ``n`` lags; None if ``labeled`` is none."""
    if USER_PURCHASED not in labeled.columns:
        return None
    held = labeled.schema[USER_PURCHASED].metadata
    if held.get("scope") != list(partition_by) or held.get("lags", 0) < n:
        raise ValueError(f"the stored history has scope {held.get('scope')} and {held.get('lags')} lags, not {list(partition_by)} and {n}")
    return labeled.select(*BASE, *lag_names(n), USER_LAST_US, USER_PURCHASED)


def history_frame(labeled: DataFrame, n: int = DEFAULTS.checkout.history, partition_by: tuple[str, ...] = (USER,),
                  split_rows: int | None = HISTORY_SPLIT_ROWS) -> DataFrame:
    """Labelled events with ``n`` lag columns, the scope's last timestamp and its purchase flag. ``split_rows`` is how
    many rows of a scope one task takes; with None no scope is split. A stored history is used as it is."""
    if (found := stored(labeled, n, partition_by)) is not None:
        return found
    names, scope = lag_names(n), list(partition_by)
    base = labeled.select(*BASE)
    hot = hot_slices(base, scope, split_rows) if split_rows else None
    keys = scope if hot is None else [*scope, _SLICE]
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lags = [F.lag(LABEL, k).over(w).alias(name) for k, name in enumerate(names, 1)]
    last, bought = F.max("event_us").over(whole), F.bool_or(F.col(LABEL) == PURCHASE).over(whole)
    if hot is None:
        return base.select(*BASE, *lags, last.alias(USER_LAST_US), bought.alias(USER_PURCHASED))

    longest = max(len(r["_splitters"]) for r in hot.collect())
    # The splitters' number is bounded, and so is the table.
    table = F.broadcast(renamed(hot, scope, "_h_"))
    place = _slice_of(F.col("_splitters"), longest)
    sliced = base.join(table, same(scope, "_h_"), "left").select(
        *BASE, F.when(F.col("_splitters").isNotNull(), place).alias(_SLICE))
    hot_rows = base.join(table, same(scope, "_h_")).select(*BASE, place.alias(_SLICE))
    carried = F.broadcast(renamed(_carried(hot_rows, scope, n), [*scope, _SLICE], "_c_"))
    windowed = sliced.select(*BASE, _SLICE, *lags, last.alias("_own_last"), bought.alias("_own_bought"),
                             F.row_number().over(w).alias("_row"))
    found = windowed.join(carried, same([*scope, _SLICE], "_c_"), "left")
    filled = [F.when(F.col(_SLICE).isNull() | (F.col("_row") > k), F.col(name)).otherwise(
        F.get("_before", F.lit(k) - F.col("_row"))).alias(name) for k, name in enumerate(names, 1)]
    split = F.col(_SLICE).isNotNull()
    return found.select(*BASE, *filled,
                        F.when(split, F.col("_last")).otherwise(F.col("_own_last")).alias(USER_LAST_US),
                        F.when(split, F.col("_bought")).otherwise(F.col("_own_bought")).alias(USER_PURCHASED))


def churn_tails(labeled: DataFrame, n: int = DEFAULTS.checkout.history, partition_by: tuple[str, ...] = (USER,)) -> DataFrame:
    """Of scopes that never purchased: the rows at their last ``n + 1`` timestamps (ties kept) with ``n`` lag columns
    and the last timestamp. Lags are right for the rows at the last timestamp. Of a stored history: all rows of such
    scopes."""
    if (found := stored(labeled, n, partition_by)) is not None:
        return found.where(~F.col(USER_PURCHASED)).drop(USER_PURCHASED)
    names, scope = lag_names(n), list(partition_by)
    rows = labeled.select(*BASE).withColumn("_purchase", F.coalesce(F.col(LABEL) == PURCHASE, F.lit(False)))
    level = F.dense_rank().over(Window.partitionBy(*scope).orderBy(F.desc("_purchase"), F.desc_nulls_last("event_us")))
    tails = rows.withColumn("_level", level).where(F.col("_level") <= n + 1)
    w, whole = Window.partitionBy(*scope).orderBy(*ORDER), Window.partitionBy(*scope)
    found = tails.select(
        *BASE, *[F.lag(LABEL, k).over(w).alias(name) for k, name in enumerate(names, 1)],
        F.max("event_us").over(whole).alias(USER_LAST_US), F.bool_or("_purchase").over(whole).alias(USER_PURCHASED))
    return found.where(~F.col(USER_PURCHASED)).drop(USER_PURCHASED)
