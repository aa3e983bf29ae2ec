"""W13 friction segments with revenue at risk, D2 churn summary, D11 total.

Semantics kept from the reference: ``affected_users`` is the sum over
sequence groups of each group's distinct users (a user in two groups counts
twice); thresholds are > 0 for churners (their last event is itself a
step) and > 1 for completers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlane.config import DEFAULTS, HISTORY_SPLIT_ROWS, PURCHASE, CheckoutSpec
from cartlane.functions.labels import lag_names
from cartlane.functions.numeric import round2, round2_ratio
from cartlane.operators import sequences as S

SEGMENT_COLUMNS = ("segment", "revenue_label", "sequences", "affected_users", "revenue_at_risk",
                   "avg_begin_checkout", "user_avg_begin_checkout", "max_begin_checkout",
                   "avg_payment_touches", "user_avg_payment_touches", "max_payment_touches")


def _frictioned_groups(labeled: DataFrame, spec: CheckoutSpec, partition_by: tuple[str, ...],
                       split_rows: int | None) -> DataFrame:
    """Sequence groups of both kinds that pass their kind's friction rule."""
    names = lag_names(spec.history)
    frame = S.history_frame(labeled, spec.history, partition_by, split_rows)
    is_comp = F.col(S.LABEL) == PURCHASE
    is_churn = S.churn_row_predicate(spec)
    rows = frame.where(is_comp | is_churn).select(
        F.when(is_comp, "completer").otherwise("churner").alias("kind"),
        F.col(S.LABEL).alias("last_event"), *names, S.USER)
    # The rule reads a group's labels alone, so it is asked of the rows, before they are packed and grouped.
    rule = F.when(F.col("kind") == "churner", S.churn_friction_predicate(spec)).otherwise(S.completer_friction_predicate(spec))
    frictioned = S.friction_counts(rows, spec).where(rule).select(*rows.columns)
    groups = S.group_sequences(frictioned, "last_event", "last_event", spec.history, ["kind"], spec.labels)
    return S.friction_counts(groups, spec)


# --- fixed values: segment and revenue labels of the result ------------------
SEGMENTS = (
    ("churner", "Friction Churners", "Lost Revenue"),
    ("completer", "Friction Completers", "At-Risk Revenue Retained"),
)
# ------------------------------------------------------------------------------


def friction_segments(labeled: DataFrame, aov: float = DEFAULTS.aov, spec: CheckoutSpec = DEFAULTS.checkout,
                      partition_by: tuple[str, ...] = (S.USER,), split_rows: int | None = HISTORY_SPLIT_ROWS) -> DataFrame:
    """One row per segment (Friction Churners, Friction Completers).

    The reference runs two pipelines over the same history. Here both are
    one chain: history rows are tagged completer (purchase) or churner (last
    event of a never-purchasing user, on a checkout step), grouped by
    (kind, sequence) once, filtered by each kind's friction rule and reduced
    to one row per kind. An empty segment still yields its row (0
    sequences, NULL sums) as the reference's global aggregates do."""
    frictioned = _frictioned_groups(labeled, spec, partition_by, split_rows)
    touches = sum((F.col(S.count_name(s)) for s in spec.payment_steps), F.lit(0))
    begins = F.col(S.count_name(spec.begin))
    # One global aggregate with conditional sums per kind: it returns a row
    # even over empty input, so an empty segment keeps its row (0
    # sequences, NULL sums) without a join to a table of segments.
    aggs = []
    for kind, _, _ in SEGMENTS:
        on = F.col("kind") == kind
        aggs += [
            F.count_if(on).alias(f"{kind}_n"),
            F.sum(F.when(on, F.col("users"))).alias(f"{kind}_users"),
            F.sum(F.when(on, begins)).alias(f"{kind}_bc"),
            F.sum(F.when(on, begins * F.col("users"))).alias(f"{kind}_bc_w"),
            F.max(F.when(on, begins)).alias(f"{kind}_bc_max"),
            F.sum(F.when(on, touches)).alias(f"{kind}_pt"),
            F.sum(F.when(on, touches * F.col("users"))).alias(f"{kind}_pt_w"),
            F.max(F.when(on, touches)).alias(f"{kind}_pt_max"),
        ]
    g = frictioned.agg(*aggs)

    def row(kind: str, segment: str, label: str):
        n, users = F.col(f"{kind}_n"), F.col(f"{kind}_users")
        return F.struct(
            F.lit(segment).alias("segment"),
            F.lit(label).alias("revenue_label"),
            n.alias("sequences"),
            users.alias("affected_users"),
            round2(users.cast("double") * F.lit(float(aov))).alias("revenue_at_risk"),
            (F.col(f"{kind}_bc").cast("double") / n).alias("avg_begin_checkout"),
            round2_ratio(F.col(f"{kind}_bc_w"), users).alias("user_avg_begin_checkout"),
            F.col(f"{kind}_bc_max").alias("max_begin_checkout"),
            (F.col(f"{kind}_pt").cast("double") / n).alias("avg_payment_touches"),
            round2_ratio(F.col(f"{kind}_pt_w"), users).alias("user_avg_payment_touches"),
            F.col(f"{kind}_pt_max").alias("max_payment_touches"),
        )

    # Churners then completers, as the reference stacks them (no ORDER BY).
    return g.select(F.inline(F.array(*[row(*seg) for seg in SEGMENTS])))


def churn_summary(labeled: DataFrame, spec: CheckoutSpec = DEFAULTS.checkout,
                  partition_by: tuple[str, ...] = (S.USER,)) -> DataFrame:
    """Churner rows, distinct checkout churners, friction churners (the
    reference's sum over sequence groups, and distinct), friction share.

    One chain: churner rows -> (user, sequence) pairs -> per user (rows,
    friction pairs, any friction) -> one global aggregate. The reference's
    affected-user count is the number of (user, friction sequence) pairs,
    since each group contributes its distinct users."""
    names = lag_names(spec.history)
    rows = S.churner_rows_with_friction(labeled, spec, partition_by)
    pairs = rows.groupBy(S.USER, "last_event", *names).agg(
        F.count(F.lit(1)).alias("_rows"), F.bool_or("is_friction").alias("_fr"))
    per_user = pairs.groupBy(S.USER).agg(
        F.sum("_rows").alias("_rows"), F.count_if("_fr").alias("_fr_pairs"), F.bool_or("_fr").alias("_fr"))
    users = per_user.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("churner_rows"),
        F.count(F.lit(1)).alias("checkout_churners"),
        F.coalesce(F.sum("_fr_pairs"), F.lit(0)).alias("friction_affected_users"),
        F.count_if(F.col("_fr")).alias("friction_churners_distinct"),
    )
    return users.select(
        "churner_rows", "checkout_churners", "friction_affected_users", "friction_churners_distinct",
        round2_ratio(F.col("friction_affected_users") * 100, F.col("checkout_churners")).alias("friction_share_prct"),
        round2_ratio(F.col("friction_churners_distinct") * 100, F.col("checkout_churners"))
        .alias("distinct_friction_share_prct"),
    )


def friction_revenue_total(labeled: DataFrame, aov: float = DEFAULTS.aov, spec: CheckoutSpec = DEFAULTS.checkout,
                           partition_by: tuple[str, ...] = (S.USER,), split_rows: int | None = HISTORY_SPLIT_ROWS) -> DataFrame:
    """Friction-affected users of both segments and their revenue
    (one global aggregate over the frictioned sequence groups)."""
    total = _frictioned_groups(labeled, spec, partition_by, split_rows).agg(
        F.coalesce(F.sum("users"), F.lit(0)).alias("friction_affected_users"))
    return total.select(
        "friction_affected_users",
        round2(F.col("friction_affected_users").cast("double") * F.lit(float(aov))).alias("revenue_at_risk"),
    )
