"""Events clustered by user: facts and histories without a shuffle.

``write_clustered`` stores normalised events as two bucketed Parquet tables:

* ``ordinary``: bucketed by user, sorted by user and time. Every group-by or window that has the user among its keys
  reads a bucket per task and needs no exchange.
* ``hot``: users with more than about ``most_rows`` rows (found on a sample, ``operators.skew``), bucketed by user, day and
  a salt of ``spread`` values, so that none of them fills one bucket. Reports pre-aggregate these map-side or cut them into slices.

The two hold different users, so a result by user is the union of the two results; ``by_user`` does that for any operator
whose result rows belong to one user each (facts, revenue, histories). Which users count as hot cannot change a result.

``clustered_history`` is the history of both, marked as a stored history: every report that needs lags takes it in
place of labelled events (``sources.history_store``).

The manifest is filled last, so a failed writer leaves no table to read, and a folder is written once. The folder is the table's only state: the reader
declares the buckets to its own session, so any later session finds them. Events need a non-NULL user, as
``normalize_events`` sees to; an empty input gives empty tables; extra columns are not stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlane.config import DEFAULTS, HISTORY_SPLIT_ROWS, CheckoutSpec
from cartlane.operators.events import NORMALIZED_COLUMNS, label_checkout_events
from cartlane.operators.history import ORDER, USER, history_frame, marked
from cartlane.operators.skew import hot_keys, renamed, same

SALT = "_salt"
PARTS = {"ordinary": [USER], "hot": [USER, "event_date", SALT]}
MANIFEST = T.StructType([T.StructField("part", T.StringType()), T.StructField("buckets", T.IntegerType()),
                         T.StructField("fields", T.StringType())])


class Clustered(NamedTuple):
    """Events of ordinary users, by buckets; and of hot ones (None where there are none)."""

    ordinary: DataFrame
    hot: DataFrame | None


def _declared(spark: SparkSession, path: str, part: str, buckets: int, fields: str) -> str:
    """The session's name for a part; declares it where the session does not know it yet."""
    name = f"clustered_{part}_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    keys = ", ".join(PARTS[part])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet OPTIONS (path '{path}/{part}')"
              f" CLUSTERED BY ({keys}) SORTED BY ({', '.join((USER, *ORDER))}) INTO {buckets} BUCKETS")
    return name


def _write(rows: DataFrame, path: str, part: str, buckets: int, fields: str) -> None:
    name = _declared(rows.sparkSession, path, part, buckets, fields)
    # One task per bucket writes it as one file.
    rows.repartition(buckets, *PARTS[part]).write.mode("append").insertInto(name)


def write_clustered(events: DataFrame, path: str, buckets: int, most_rows: int = HISTORY_SPLIT_ROWS, spread: int = 16) -> int:
    """Write normalised events to a new folder; the number of hot users. ``buckets``: tasks that will read each part."""
    spark, root = events.sparkSession, path.rstrip("/")
    if "'" in root:
        raise ValueError("the path holds a quote")
    # An empty manifest claims the folder; it lists the parts only when they are complete.
    spark.createDataFrame([], MANIFEST).write.mode("errorifexists").parquet(f"{root}/manifest")
    rows = events.select(*NORMALIZED_COLUMNS)
    hot = hot_keys(rows, [USER], most_rows)
    parts = {"ordinary": rows}
    if hot is not None:
        # At most 65,536 users.
        table = F.broadcast(renamed(hot, [USER], "_h_"))
        parts["ordinary"] = rows.join(table, same([USER], "_h_"), "left_anti")
        salt = F.pmod(F.xxhash64(*ORDER), F.lit(spread)).cast("int").alias(SALT)
        parts["hot"] = rows.join(table, same([USER], "_h_"), "left_semi").select("*", salt)
    made = []
    for part, held in parts.items():
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema)
        _write(held, root, part, buckets, fields)
        made.append((part, buckets, fields))
    spark.createDataFrame(made, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return 0 if hot is None else hot.count()


def read_clustered(spark: SparkSession, path: str) -> Clustered:
    """The events of a folder that ``write_clustered`` finished."""
    root = path.rstrip("/")
    parts = {r["part"]: r for r in spark.read.schema(MANIFEST).parquet(f"{root}/manifest").collect()}
    if not parts:
        raise ValueError(f"the table at {root} is not complete")
    tables = {part: spark.table(_declared(spark, root, part, r["buckets"], r["fields"])) for part, r in parts.items()}
    return Clustered(tables["ordinary"], tables["hot"].drop(SALT) if "hot" in tables else None)


def by_user(table: Clustered, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operator`` over all events, for one whose result rows belong to one user each."""
    return reduce(DataFrame.unionByName, [operator(part) for part in table if part is not None])


def clustered_history(table: Clustered, n: int = DEFAULTS.checkout.history, spec: CheckoutSpec = DEFAULTS.checkout,
                      partition_by: tuple[str, ...] = (USER,), split_rows: int = HISTORY_SPLIT_ROWS) -> DataFrame:
    """The labelled events' history, for every report that takes one: no exchange for ordinary users, slices for hot ones."""
    if USER not in partition_by:
        raise ValueError(f"the scope {list(partition_by)} does not hold the user")
    parts = [history_frame(label_checkout_events(table.ordinary, spec), n, partition_by, None)]
    if table.hot is not None:
        parts.append(history_frame(label_checkout_events(table.hot, spec), n, partition_by, split_rows))
    return marked(reduce(DataFrame.unionByName, parts), n, partition_by)
