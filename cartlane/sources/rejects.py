"""Normalised events and rejected rows from one pass over the raw table.

``normalize_events`` either fails the job on a bad row or drops it. ``write_checked`` reads the raw table once, counts the
rows by reason while they pass (an observation, no second job) and writes accepted and rejected rows to one table that
is partitioned by the reason, so each is read without the other.

Reasons, the first that holds: ``null_user`` (every operator's key is missing), ``bad_date`` (the stored date is no
``yyyyMMdd``). A NULL date or timestamp is no reason: the operators define what it means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cartlane.operators.events import NORMALIZED_COLUMNS, normalize_events

REASON = "reject_reason"
ACCEPTED = "none"
REASONS = ("null_user", "bad_date")


def checked_events(raw: DataFrame) -> DataFrame:
    """Normalised events of all rows (a bad date is NULL), the stored date and the reason (``none`` if accepted)."""
    bad_date = F.col("event_date").isNotNull() & F.try_to_date("event_date", "yyyyMMdd").isNull()
    reason = F.when(F.col("user_pseudo_id").isNull(), "null_user").when(bad_date, "bad_date").otherwise(ACCEPTED)
    rows = raw.withColumns({REASON: reason, "stored_date": F.col("event_date")})
    held = rows.select("*", F.coalesce("user_pseudo_id", F.lit("")).alias("_user")).drop("user_pseudo_id").withColumnRenamed(
        "_user", "user_pseudo_id")
    return normalize_events(held, lenient_dates=True, also=("stored_date", REASON)).withColumn(
        "user_pseudo_id", F.when(F.col(REASON) != "null_user", F.col("user_pseudo_id")))


def write_checked(raw: DataFrame, path: str) -> dict[str, int]:
    """Write accepted and rejected rows; the number of rows by reason, ``none`` for accepted ones."""
    seen = Observation("rejects")
    counts = [F.count_if(F.col(REASON) == r).alias(r) for r in (ACCEPTED, *REASONS)]
    checked_events(raw).observe(seen, *counts).write.mode("overwrite").partitionBy(REASON).parquet(path)
    return {r: seen.get[r] for r in (ACCEPTED, *REASONS)}


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    """The events of :func:`write_checked` as ``normalize_events`` would give them; rejected files are not read."""
    return spark.read.parquet(path).where(F.col(REASON) == ACCEPTED).select(*NORMALIZED_COLUMNS)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The rejected rows with their stored date and reason."""
    return spark.read.parquet(path).where(F.col(REASON) != ACCEPTED)
