"""The raw clickstream table: one row per analytics event.

Types are fixed here instead of being inferred. ``event_date`` is stored as
a ``yyyyMMdd`` string and ``event_timestamp`` as epoch microseconds (UTC),
as in the warehouse export the analysis was written for.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_EVENTS_SCHEMA = T.StructType([
    T.StructField("user_pseudo_id", T.StringType(), True),
    T.StructField("event_name", T.StringType(), True),
    T.StructField("page_title", T.StringType(), True),
    T.StructField("event_date", T.StringType(), True),
    T.StructField("event_timestamp", T.LongType(), True),
    T.StructField("browser", T.StringType(), True),
    T.StructField("operating_system", T.StringType(), True),
    T.StructField("purchase_revenue_in_usd", T.DoubleType(), True),
    # Total-order tie-break for events sharing a timestamp; a table may lack it (last field).
    T.StructField("event_seq", T.LongType(), True),
])

def raw_date_upper_bound(cutoff: _dt.date | None):
    """Predicate on the *stored* date string (order-preserving ``yyyyMMdd``).

    Unlike a predicate on the parsed date it reaches the Parquet scan as a
    pushed filter and prunes ``event_date`` partitions.
    """
    if cutoff is None:
        return None
    return F.col("event_date") <= F.lit(cutoff.strftime("%Y%m%d"))


def read_raw_events(spark: SparkSession, path: str, cutoff: _dt.date | None = None) -> DataFrame:
    """Read a raw-events Parquet table (optionally ``event_date``-partitioned). A table that has no ``event_seq``
    (its footer tells) is read without it; ``normalize_events`` then orders ties by content."""
    sequenced = "event_seq" in spark.read.parquet(path).columns
    schema = RAW_EVENTS_SCHEMA if sequenced else T.StructType(RAW_EVENTS_SCHEMA.fields[:-1])
    df = spark.read.schema(schema).parquet(path)
    pred = raw_date_upper_bound(cutoff)
    return df if pred is None else df.where(pred)
