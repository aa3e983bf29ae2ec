"""SparkSession construction and the few session settings operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of this library wants. AQE re-plans joins from runtime
# sizes, coalesces small shuffle partitions and splits skewed join partitions
# (forced even when the split needs an extra shuffle, because the hot-user
# case is assumed, not exceptional).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # Python call-site capture for error messages costs one JVM round trip
    # per Column call while a plan is built; off for batch jobs.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "cartlane",
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in {**SESSION_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session. Where it is unset, a local
    session gets a scratch folder; on a cluster that is an error, since no folder of one machine would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir is not set; with master {master!r} it has to name a shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="cartlane-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
