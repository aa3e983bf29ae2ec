"""Query catalog: name -> callable(spark, sf_dir) -> DataFrame.

Every entry reads the driver tables (``events`` via the fixture adapter) in
full and runs one operator of the library with the reference's parameters.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlane.config import DEFAULTS
from cartlane.operators import (clean_path, daily, duration, events, facts, friction, funnel, population, revenue,
                                sequences)
from cartlane.session import shared_dir
from cartlane.sources.clustered import Clustered, by_user, clustered_history, read_clustered, write_clustered
from cartlane.sources.fixture import load_raw_events

# The date filter that some of the analyses have, on the dates of the driver's
# fixture (January 2024).
FIXTURE_CUTOFF = _dt.date(2024, 1, 25)

QueryFn = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        CATALOG[name] = fn
        return fn
    return deco


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.normalize_events(load_raw_events(spark, sf_dir))


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.label_checkout_events(normalized(spark, sf_dir))


def labeled_unsequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled events of a raw table that has no ``event_seq``, as the reference's."""
    return events.label_checkout_events(events.normalize_events(load_raw_events(spark, sf_dir).drop("event_seq")))


@query("normalize_events")
def q_normalize_events(spark, sf_dir):
    return normalized(spark, sf_dir)


@query("checkout_labels")
def q_checkout_labels(spark, sf_dir):
    return labeled(spark, sf_dir)


@query("user_day_facts")
def q_user_day_facts(spark, sf_dir):
    return facts.user_day_facts(normalized(spark, sf_dir))


@query("user_day_facts_paired")
def q_user_day_facts_paired(spark, sf_dir):
    return facts.user_day_facts(normalized(spark, sf_dir), paired=True)


@query("purchase_revenue_user_day")
def q_purchase_revenue_user_day(spark, sf_dir):
    return facts.purchase_revenue_user_day(normalized(spark, sf_dir))


@query("daily_purchase_duration")
def q_daily_purchase_duration(spark, sf_dir):
    return duration.purchase_duration(normalized(spark, sf_dir), cutoff=FIXTURE_CUTOFF)


@query("purchase_duration_by_segment")
def q_purchase_duration_by_segment(spark, sf_dir):
    return duration.purchase_duration_by(normalized(spark, sf_dir), cutoff=FIXTURE_CUTOFF)


@query("segment_gaps")
def q_segment_gaps(spark, sf_dir):
    return duration.segment_gaps(normalized(spark, sf_dir), cutoff=FIXTURE_CUTOFF)


@query("purchase_weighted_duration")
def q_purchase_weighted_duration(spark, sf_dir):
    return duration.purchase_weighted_duration(normalized(spark, sf_dir), cutoff=FIXTURE_CUTOFF)


@query("slowest_segment")
def q_slowest_segment(spark, sf_dir):
    return duration.slowest_segment(normalized(spark, sf_dir), cutoff=FIXTURE_CUTOFF)


@query("aov")
def q_aov(spark, sf_dir):
    return revenue.average_order_value(normalized(spark, sf_dir), cutoff=FIXTURE_CUTOFF)


# --- funnel ------------------------------------------------------------------
@query("funnel_counts")
def q_funnel_counts(spark, sf_dir):
    return funnel.funnel_counts(normalized(spark, sf_dir))


@query("funnel_users")
def q_funnel_users(spark, sf_dir):
    return funnel.funnel_users(normalized(spark, sf_dir))


@query("funnel_rates")
def q_funnel_rates(spark, sf_dir):
    return funnel.funnel_rates(normalized(spark, sf_dir))


@query("funnel_step_dropoff")
def q_funnel_step_dropoff(spark, sf_dir):
    return funnel.funnel_step_dropoff(normalized(spark, sf_dir))


@query("funnel_counts_and_rates")
def q_funnel_counts_and_rates(spark, sf_dir):
    return funnel.funnel_counts_and_rates(normalized(spark, sf_dir))


# --- sequences, churn, friction ----------------------------------------------
@query("prior_event_sequence")
def q_prior_event_sequence(spark, sf_dir):
    return sequences.prior_events(labeled(spark, sf_dir))


@query("checkout_churners")
def q_checkout_churners(spark, sf_dir):
    return sequences.checkout_churners(labeled(spark, sf_dir))


@query("checkout_churners_session")
def q_checkout_churners_session(spark, sf_dir):
    return sequences.checkout_churners(labeled(spark, sf_dir), partition_by=sequences.SESSION)


@query("prior_event_sequence_unsequenced")
def q_prior_event_sequence_unsequenced(spark, sf_dir):
    return sequences.prior_events(labeled_unsequenced(spark, sf_dir))


@query("checkout_churners_unsequenced")
def q_checkout_churners_unsequenced(spark, sf_dir):
    return sequences.checkout_churners(labeled_unsequenced(spark, sf_dir))


@query("completer_sequences")
def q_completer_sequences(spark, sf_dir):
    return sequences.completer_sequences(labeled(spark, sf_dir))


@query("churner_sequences")
def q_churner_sequences(spark, sf_dir):
    return sequences.churner_sequences(labeled(spark, sf_dir))


@query("completer_friction")
def q_completer_friction(spark, sf_dir):
    return sequences.friction_counts(sequences.completer_sequences(labeled(spark, sf_dir)))


@query("churner_friction")
def q_churner_friction(spark, sf_dir):
    return sequences.friction_counts(sequences.churner_sequences(labeled(spark, sf_dir)))


@query("friction_segments")
def q_friction_segments(spark, sf_dir):
    return friction.friction_segments(labeled(spark, sf_dir), aov=DEFAULTS.aov)


@query("friction_segments_session")
def q_friction_segments_session(spark, sf_dir):
    return friction.friction_segments(labeled(spark, sf_dir), aov=DEFAULTS.aov, partition_by=sequences.SESSION)


@query("churn_summary")
def q_churn_summary(spark, sf_dir):
    return friction.churn_summary(labeled(spark, sf_dir))


@query("churn_summary_session")
def q_churn_summary_session(spark, sf_dir):
    return friction.churn_summary(labeled(spark, sf_dir), partition_by=sequences.SESSION)


@query("friction_revenue_total")
def q_friction_revenue_total(spark, sf_dir):
    return friction.friction_revenue_total(labeled(spark, sf_dir), aov=DEFAULTS.aov)


@query("churners_by_last_event")
def q_churners_by_last_event(spark, sf_dir):
    return sequences.churners_by_last_event(labeled(spark, sf_dir))


@query("churner_shares")
def q_churner_shares(spark, sf_dir):
    return sequences.churner_shares(labeled(spark, sf_dir))


@query("payment_step_churners")
def q_payment_step_churners(spark, sf_dir):
    return sequences.payment_step_churners(labeled(spark, sf_dir))


@query("payment_return_churners")
def q_payment_return_churners(spark, sf_dir):
    return sequences.payment_return_churners(labeled(spark, sf_dir))


@query("shipping_redirects")
def q_shipping_redirects(spark, sf_dir):
    return sequences.shipping_redirects(labeled(spark, sf_dir))


# --- clean path ----------------------------------------------------------------
@query("checkout_start")
def q_checkout_start(spark, sf_dir):
    cs = clean_path.checkout_start(labeled(spark, sf_dir))
    return cs.select("user_pseudo_id", "event_date", F.timestamp_micros("checkout_us").alias("checkout_time"))


@query("checkpoint_counts")
def q_checkpoint_counts(spark, sf_dir):
    return clean_path.checkpoint_counts(labeled(spark, sf_dir))


@query("clean_path_user_days")
def q_clean_path_user_days(spark, sf_dir):
    return clean_path.clean_path_user_days(labeled(spark, sf_dir))


@query("clean_vs_overall")
def q_clean_vs_overall(spark, sf_dir):
    return clean_path.clean_vs_overall(normalized(spark, sf_dir), cutoff=FIXTURE_CUTOFF)


@query("clean_vs_overall_session")
def q_clean_vs_overall_session(spark, sf_dir):
    return clean_path.clean_vs_overall(normalized(spark, sf_dir), cutoff=FIXTURE_CUTOFF, fanout="session")


@query("aov_candidates")
def q_aov_candidates(spark, sf_dir):
    return clean_path.aov_candidates(normalized(spark, sf_dir), cutoff=FIXTURE_CUTOFF)


@query("clean_path_speedup")
def q_clean_path_speedup(spark, sf_dir):
    return clean_path.clean_path_speedup(normalized(spark, sf_dir), cutoff=FIXTURE_CUTOFF)


# --- population ---------------------------------------------------------------
@query("population_counts")
def q_population_counts(spark, sf_dir):
    return population.population_counts(normalized(spark, sf_dir), cutoff=FIXTURE_CUTOFF)


@query("missing_step_share")
def q_missing_step_share(spark, sf_dir):
    return population.missing_step_share(normalized(spark, sf_dir))


# --- reports from daily partials ------------------------------------------------
def partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.daily_partials(normalized(spark, sf_dir))


@query("purchase_duration_from_partials")
def q_purchase_duration_from_partials(spark, sf_dir):
    return daily.purchase_duration(partials(spark, sf_dir), cutoff=FIXTURE_CUTOFF)


@query("segment_duration_from_partials")
def q_segment_duration_from_partials(spark, sf_dir):
    return daily.purchase_duration(partials(spark, sf_dir), cutoff=FIXTURE_CUTOFF, keys=DEFAULTS.segment.keys)


@query("funnel_counts_from_partials")
def q_funnel_counts_from_partials(spark, sf_dir):
    return daily.funnel_counts(partials(spark, sf_dir))


@query("aov_from_partials")
def q_aov_from_partials(spark, sf_dir):
    return daily.average_order_value(partials(spark, sf_dir), cutoff=FIXTURE_CUTOFF)


@query("population_counts_approx")
def q_population_counts_approx(spark, sf_dir):
    return daily.approximate_population(partials(spark, sf_dir), cutoff=FIXTURE_CUTOFF)


@query("funnel_users_approx")
def q_funnel_users_approx(spark, sf_dir):
    return daily.approximate_funnel_users(partials(spark, sf_dir))


# --- reports from a user-clustered table ----------------------------------------
def clustered(spark: SparkSession, sf_dir: str) -> Clustered:
    """All events, written to a new user-clustered table in the session's shared folder. Buckets follow the session's
    shuffle partitions."""
    path = f"{shared_dir(spark)}/clustered-{uuid.uuid4().hex}"
    write_clustered(normalized(spark, sf_dir), path, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_clustered(spark, path)


@query("user_day_facts_clustered")
def q_user_day_facts_clustered(spark, sf_dir):
    return by_user(clustered(spark, sf_dir), facts.user_day_facts)


@query("friction_segments_clustered")
def q_friction_segments_clustered(spark, sf_dir):
    return friction.friction_segments(clustered_history(clustered(spark, sf_dir)), aov=DEFAULTS.aov)
