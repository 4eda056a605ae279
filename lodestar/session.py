"""Session helpers: how tables are read and where intermediate data may live."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str = "lodestar", cores: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LODESTAR_DRIVER_MEMORY", "6g"))
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, one machine) a local folder takes
    its place. The folder is also made the session's checkpoint directory.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = os.environ.get("LODESTAR_SHARED_DIR") or tempfile.mkdtemp(prefix="lodestar-")
        place = f"file://{place}"
        spark.conf.set("spark.checkpoint.dir", place)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(place)
    return place
