"""Event histories, checkout churners, sequence groups.

Histories come from ``operators.history``: the full frame where every event's lags are wanted (W10, completers, D5), the
bounded tails where only a user's last events matter (W11 and all that builds on it: no history is shuffled there).
``partition_by`` scopes both: per user (default, the reference's reading) or per session (``SESSION``, the user's day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlane.config import (ADD_PAYMENT, ADD_SHIPPING, BEGIN_CHECKOUT, DEFAULTS, HISTORY_SPLIT_ROWS, PAYMENT_PAGE, PURCHASE,
                             CheckoutSpec)
from cartlane.functions.labels import lag_names, occurrences
from cartlane.functions.packed import KEY, OTHER, pack, unpack
from cartlane.operators.history import (LABEL, SESSION, USER, USER_LAST_US, USER_PURCHASED, churn_tails,  # noqa: F401
                                        history_frame)


def prior_events(labeled: DataFrame, n: int = DEFAULTS.checkout.history, partition_by: tuple[str, ...] = (USER,),
                 split_rows: int | None = HISTORY_SPLIT_ROWS) -> DataFrame:
    """Every labelled event with the ``n`` previous labels of the same
    user (across days, as in the reference) or of ``partition_by``."""
    return history_frame(labeled, n, partition_by, split_rows).select(
        USER, "event_date", "event_timestamp", "event_seq", LABEL, *lag_names(n))


def churn_row_predicate(spec: CheckoutSpec = DEFAULTS.checkout) -> Column:
    """Row at the scope's last timestamp, label a checkout step, scope without
    a purchase."""
    return ((F.col("event_us") == F.col(USER_LAST_US)) & ~F.col(USER_PURCHASED)
            & F.col(LABEL).isin(*spec.churn_steps))


def checkout_churners(labeled: DataFrame, spec: CheckoutSpec = DEFAULTS.checkout,
                      partition_by: tuple[str, ...] = (USER,)) -> DataFrame:
    """Rows at each user's last labelled timestamp (ties kept) whose
    label is a checkout step, for users who never purchased. No join and no
    history: the users' tails hold all that is asked."""
    tails = churn_tails(labeled, spec.history, partition_by)
    return tails.where((F.col("event_us") == F.col(USER_LAST_US)) & F.col(LABEL).isin(*spec.churn_steps)).select(
        USER, "event_date", "event_timestamp", F.col(LABEL).alias("churn_event"), *lag_names(spec.history))


def group_sequences(rows: DataFrame, event_col: str, out_col: str, n: int = DEFAULTS.checkout.history,
                    extra_keys: list[str] | None = None, dictionary: tuple[str, ...] = DEFAULTS.checkout.labels) -> DataFrame:
    """One row per distinct (event, n previous labels): occurrences and
    distinct users. NULL lags group together. COUNT DISTINCT is planned as a
    two-level aggregate on (sequence, user) then sequence, so a very common
    sequence is spread over users before it is merged. The labels of
    ``dictionary`` travel packed into one 64-bit key (``functions.packed``);
    sequences with others are grouped by the labels themselves."""
    extra, names = extra_keys or [], [out_col, *lag_names(n)]
    packed = rows.select(*extra, USER, *pack([F.col(event_col), *[F.col(c) for c in lag_names(n)]], dictionary))
    groups = packed.groupBy(*extra, KEY, OTHER).agg(
        F.count(F.lit(1)).alias("sequences"),
        F.countDistinct(USER).alias("users"),
    )
    return groups.select(*extra, *unpack(names, dictionary), "sequences", "users")


def completer_sequences(labeled: DataFrame, spec: CheckoutSpec = DEFAULTS.checkout,
                        partition_by: tuple[str, ...] = (USER,), split_rows: int | None = HISTORY_SPLIT_ROWS) -> DataFrame:
    seq = prior_events(labeled, spec.history, partition_by, split_rows).where(F.col(LABEL) == PURCHASE)
    return group_sequences(seq, LABEL, "current_event", spec.history, dictionary=spec.labels)


def churner_sequences(labeled: DataFrame, spec: CheckoutSpec = DEFAULTS.checkout,
                      partition_by: tuple[str, ...] = (USER,)) -> DataFrame:
    rows = checkout_churners(labeled, spec, partition_by)
    return group_sequences(rows, "churn_event", "last_event", spec.history, dictionary=spec.labels)


# --- fixed values: output names of the step counters -------------------------
COUNT_NAMES = {
    "Payment Method": "pay_meth_count",
    "add_payment_info": "add_pay_count",
    "begin_checkout": "begin_checkout_count",
    "add_shipping_info": "shipping_count",
}
# ------------------------------------------------------------------------------


def count_name(step: str) -> str:
    return COUNT_NAMES.get(step, step.lower().replace(" ", "_") + "_count")


def counted_steps(spec: CheckoutSpec) -> list[str]:
    """The steps whose occurrences the friction rules and measures need."""
    order = {step: k for k, step in enumerate(COUNT_NAMES)}
    steps = dict.fromkeys((*spec.payment_steps, spec.begin, *spec.churn_steps))
    return sorted(steps, key=lambda s: order.get(s, len(order)))


def friction_counts(sequences: DataFrame, spec: CheckoutSpec = DEFAULTS.checkout) -> DataFrame:
    """Occurrences of each checkout step among the prior labels."""
    names = lag_names(spec.history)
    return sequences.select("*", *[occurrences(names, s).alias(count_name(s)) for s in counted_steps(spec)])


def churn_friction_predicate(spec: CheckoutSpec = DEFAULTS.checkout) -> Column:
    """the last event is a churn step that the history has already."""
    seen = F.create_map(*[c for s in spec.churn_steps for c in (F.lit(s), F.col(count_name(s)))])
    return F.coalesce(F.element_at(seen, F.col("last_event")) > 0, F.lit(False))


def completer_friction_predicate(spec: CheckoutSpec = DEFAULTS.checkout) -> Column:
    """some churn step occurs more than once in the history."""
    return F.greatest(F.lit(0), *[F.col(count_name(s)) for s in spec.churn_steps]) > 1


def churner_rows_with_friction(labeled: DataFrame, spec: CheckoutSpec = DEFAULTS.checkout,
                               partition_by: tuple[str, ...] = (USER,)) -> DataFrame:
    """Churner rows with their friction counts and the F9 flag (row level)."""
    rows = checkout_churners(labeled, spec, partition_by).withColumnRenamed("churn_event", "last_event")
    return friction_counts(rows, spec).withColumn("is_friction", churn_friction_predicate(spec))


def churners_by_last_event(labeled: DataFrame, spec: CheckoutSpec = DEFAULTS.checkout,
                           partition_by: tuple[str, ...] = (USER,)) -> DataFrame:
    """D3: friction churners by the step they churned on: churn rows,
    sequence groups, affected users (sum over groups, as the reference
    counts) and distinct users.

    One chain of aggregates, each finer than the next: (step, sequence, user)
    pairs, then (step, sequence) and (step, user) side by side as counts of
    distinct values over the pairs."""
    rows = churner_rows_with_friction(labeled, spec, partition_by).where("is_friction")
    pairs = rows.groupBy("last_event", USER, F.struct(*lag_names(spec.history)).alias("_sequence")).agg(
        F.count(F.lit(1)).alias("_rows"))
    return pairs.groupBy("last_event").agg(
        F.sum("_rows").alias("churn_rows"), F.countDistinct("_sequence").alias("sequences"),
        F.count(F.lit(1)).alias("affected_users"), F.countDistinct(USER).alias("distinct_users"))


def churner_shares(labeled: DataFrame, spec: CheckoutSpec = DEFAULTS.checkout,
                   partition_by: tuple[str, ...] = (USER,)) -> DataFrame:
    """Affected users of each last step and their share of all friction
    churners. The steps are few, so one aggregate gathers them for the total."""
    steps = churners_by_last_event(labeled, spec, partition_by)
    total = steps.agg(F.collect_list(F.struct("last_event", "affected_users")).alias("_steps"),
                      F.sum("affected_users").alias("all_affected_users"))
    share = F.round(F.col("affected_users").cast("decimal(20,0)") * 100 / F.col("all_affected_users"), 2)
    return total.select(F.inline("_steps"), "all_affected_users").select(
        "last_event", "affected_users", "all_affected_users", share.cast("double").alias("share_prct"))


def payment_step_churners(labeled: DataFrame, spec: CheckoutSpec = DEFAULTS.checkout,
                          partition_by: tuple[str, ...] = (USER,)) -> DataFrame:
    """Churners whose last event is a payment step, and those among them
    with friction (F9). This is broader than a reading of the prose that asks
    for users who submitted payment info and went back to the payment method
    (``payment_return_churners``): any churner ending on either step counts."""
    rows = churner_rows_with_friction(labeled, spec, partition_by).where(
        F.col("last_event").isin(*spec.payment_steps))
    per_user = rows.groupBy(USER).agg(F.count(F.lit(1)).alias("_rows"), F.bool_or("is_friction").alias("_fr"))
    return per_user.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("payment_churn_rows"),
        F.count(F.lit(1)).alias("payment_churn_users"),
        F.count_if(F.col("_fr")).alias("friction_payment_churn_users"),
    )


def payment_return_churners(labeled: DataFrame, spec: CheckoutSpec = DEFAULTS.checkout,
                            partition_by: tuple[str, ...] = (USER,)) -> DataFrame:
    """D4, the strict reading: churners who left on the payment page after they
    had submitted payment info (among the labels before): rows and users."""
    rows = checkout_churners(labeled, spec, partition_by).where(F.col("churn_event") == PAYMENT_PAGE)
    back = rows.where(occurrences(lag_names(spec.history), ADD_PAYMENT) > 0)
    per_user = back.groupBy(USER).agg(F.count(F.lit(1)).alias("_n"))
    return per_user.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("return_churn_rows"),
                        F.count(F.lit(1)).alias("return_churn_users"))


def shipping_redirects(labeled: DataFrame, partition_by: tuple[str, ...] = (USER,),
                       split_rows: int | None = HISTORY_SPLIT_ROWS) -> DataFrame:
    """begin_checkout immediately after add_shipping_info (a redirect
    back to checkout): events and distinct users."""
    seq = prior_events(labeled, 1, partition_by, split_rows)
    hits = seq.where((F.col(LABEL) == BEGIN_CHECKOUT) & (F.col("one_event_before") == ADD_SHIPPING))
    per_user = hits.groupBy(USER).agg(F.count(F.lit(1)).alias("_n"))
    return per_user.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("redirect_events"),
        F.count(F.lit(1)).alias("redirect_users"),
    )
