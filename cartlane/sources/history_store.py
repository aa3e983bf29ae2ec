"""A stored, versioned event history for the operators that need lags.

``write_history`` computes the history of labelled events once and writes it as Parquet, range-clustered by user and
time: files hold contiguous users, a user with many events spreads over several, and a user filter skips files by
their statistics. ``read_history`` gives it back as a frame that every history operator takes in place of labelled
events: it is used as it is, so a set of reports reads the events once and shuffles the history once.

A store is a folder. Each version is a table of its own, listed in the store's manifest after it is complete, so readers
never see half a version and a failed writer leaves the last one in force. The scope and the number of lags travel with
the columns; an operator that asks for another scope or for more lags is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from cartlane.config import DEFAULTS, HISTORY_SPLIT_ROWS
from cartlane.operators.history import ORDER, USER, history_frame, marked

MANIFEST = T.StructType([T.StructField("version", T.LongType()), T.StructField("rows", T.LongType()),
                         T.StructField("scope", T.StringType()), T.StructField("lags", T.IntegerType())])


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The complete versions of a store; none where there is no store yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST)


def write_history(labeled: DataFrame, path: str, n: int = DEFAULTS.checkout.history, partition_by: tuple[str, ...] = (USER,),
                  split_rows: int | None = HISTORY_SPLIT_ROWS, files: int | None = None) -> int:
    """Write the next version and return its number. ``files``: how many range partitions; by default the session's
    shuffle partitions."""
    spark, root = labeled.sparkSession, path.rstrip("/")
    version = (versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    frame = marked(history_frame(labeled, n, partition_by, split_rows), n, partition_by)
    keys = [USER, *ORDER]
    clustered = frame.repartitionByRange(files, *keys) if files else frame.repartitionByRange(*keys)
    table = f"{root}/version-{version:06d}"
    # A version that a failed writer began is not in the manifest and is overwritten.
    clustered.sortWithinPartitions(*keys).write.mode("overwrite").parquet(table)
    rows = spark.read.parquet(table).count()
    spark.createDataFrame([(version, rows, ",".join(partition_by), n)], MANIFEST).coalesce(1).write.mode("append").parquet(
        f"{root}/manifest")
    return version


def read_history(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The history of a version, by default the latest."""
    listed = sorted(r["version"] for r in versions(spark, path).select("version").collect())
    chosen = listed[-1] if listed and version is None else version
    if chosen not in listed:
        raise ValueError(f"the store at {path} has versions {listed}, not {version or 'any'}")
    return spark.read.parquet(f"{path.rstrip('/')}/version-{chosen:06d}")
