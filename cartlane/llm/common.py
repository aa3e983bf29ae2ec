"""Small helpers of the operators: inputs, written intermediate tables, joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlane.session import shared_dir

#: Bytes that a Python task gathers before it hands an Arrow batch to Spark.
BATCH_BYTES = 4 << 20
#: A key is hot when it has more than one row in this many; so at most this many keys are hot.
HOT_SHARE = 1000
#: Spark's setting that removes a query's shuffle files when it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session's context, so that their Python can import it wherever the
    driver runs."""
    context = spark.sparkContext
    if getattr(context, "_cartlane_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="cartlane-")) / "cartlane.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._cartlane_shipped = True


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files lie; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def payload(text: str = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def crc_mod(doc_id: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # The job's shuffle files are of no use once the table is there.
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_SHUFFLES) if before is None else spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def hidden(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    name = f"__{stem}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stand for themselves, the others
    for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def batches(rows: Iterable[tuple], schema: pa.Schema, weigh=None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of row tuples, closed at ``BATCH_BYTES`` (by ``weigh(row)``) or 20,000 rows."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weigh(row) if weigh else 0
        if size >= BATCH_BYTES or len(held) >= 20_000:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)],
                                      schema=schema)


def left_join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (one row per ``key``; ``size`` counts the rows of the key).

    Keys with more than 1 / ``HOT_SHARE`` of all rows, of which there are at most ``HOT_SHARE``, are broadcast;
    their rows are dealt over all tasks. The others are joined by an ordinary shuffle. ``groups`` is read three
    times, so pass a written table.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(1000, total // HOT_SHARE)
    others = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > least).select(
        F.col(key).alias("__hot_key"), F.struct(*others).alias("__hot"))
    cold = groups.where(F.col(size) <= least).select(
        F.col(key).alias("__cold_key"), F.struct(*others).alias("__cold"))
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left")
    dealt = F.when(F.col("__hot_key").isNull(), F.col(key))
    spread = F.when(F.col("__hot_key").isNotNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    found = found.withColumns({"__dealt": dealt, "__spread": spread})
    cold = cold.withColumn("__minus", F.lit(-1).cast("long"))
    both = found.join(cold, F.col("__dealt").eqNullSafe(F.col("__cold_key"))
                      & (F.col("__spread") == F.col("__minus")), "left")
    taken = [F.coalesce(F.col(f"__hot.{c}"), F.col(f"__cold.{c}")).alias(c) for c in others]
    return both.select(*rows.columns, *taken)
