"""Keys with too many rows for one task, found on a sample.

A literal table of them is small: at most ``MOST_KEYS`` keys. What is done with it never changes a result, only where
rows go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sampled rows of a key at the limit, and the most keys that count as hot.
PER_KEY, MOST_KEYS = 64, 1 << 16
#: A row's least size in Spark's estimates; an input of fewer bytes than the limit's rows is not sampled.
LEAST_ROW_BYTES = 16
SEED = 20210125


def estimated_bytes(df: DataFrame) -> int | None:
    """Spark's size estimate of a plan; None where the session does not tell (Spark Connect)."""
    plan = getattr(df, "_jdf", None)
    return None if plan is None else int(plan.queryExecution().optimizedPlan().stats().sizeInBytes())


def may_hold(df: DataFrame, rows: int) -> bool:
    """Whether one key of ``df`` can have ``rows`` rows, by the size estimate."""
    size = estimated_bytes(df)
    return size is None or size >= rows * LEAST_ROW_BYTES


def same(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def renamed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{prefix}{k}" for k in keys})


def literal(df: DataFrame, rows: list[tuple], fields: list[T.StructField]) -> DataFrame:
    """A table of collected rows, so that every branch of a plan sees the same ones."""
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))


def hot_keys(rows: DataFrame, keys: list[str], most_rows: int) -> DataFrame | None:
    """The keys with more than about one and a half times ``most_rows`` rows; None without one. Where more keys than
    ``MOST_KEYS`` pass, the limit is doubled: none of them has a large share of the rows then."""
    if not may_hold(rows, most_rows):
        return None
    per = min(PER_KEY, most_rows)
    while True:
        sample = rows.select(*keys).sample(fraction=min(1.0, per / most_rows), seed=SEED)
        # A sample's count is off by its square root.
        found = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * 2 > 3 * per).take(MOST_KEYS + 1)
        if len(found) <= MOST_KEYS:
            break
        most_rows *= 2
    if not found:
        return None
    return literal(rows, [tuple(r[k] for k in keys) for r in found], [rows.schema[k] for k in keys])
