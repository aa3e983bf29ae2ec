"""Result sinks: the reference exported every result as CSV for a dashboard.

Parquet is the default; CSV with a header reproduces the hand export.
Writes are whole-dataframe, distributed and idempotent (``overwrite``), so a
retried job after executor loss produces the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                 single_file: bool = False) -> str:
    """Write a result. ``single_file`` (one CSV for a dashboard, as the
    reference exported) is only meant for the small report tables, whose rows are
    moved to one task after they are made; large
    outputs keep their partitioning and may be ``partition_by`` a date."""
    out = df.repartition(1) if single_file else df
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return path


def read_result(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(schema).parquet(path)
