"""Session settings shared by the tests, the benchmark and local runs."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "Etc/UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # page and document jobs are bound by CPU, so a split holds little
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.ui.enabled": "false",
    # Python call sites in error messages cost about a millisecond per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", app: str = "shopfront", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster job brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    On a cluster this is spark.checkpoint.dir. Where that is unset (tests on one
    machine) a fresh temporary folder is taken and remembered in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("shopfront.local.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("shopfront.local.shared.dir", path)
    return path
