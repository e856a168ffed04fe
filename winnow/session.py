"""Session settings the operators are written for."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key must be split even when an aggregate on the same key follows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The first rows of a group are found below the shuffle, for the blocks of a large selection too.
    "spark.sql.optimizer.windowGroupLimitThreshold": "32769",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="winnow-ship-"), "winnow"), "zip", root, "winnow")
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session and ship the package to its workers."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def local_session(cores: int | str = 8, app: str = "winnow", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster use spark-submit and tune()."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
