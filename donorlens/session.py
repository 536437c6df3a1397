"""SparkSession defaults for the library.

Only settings that are still unset are filled in, so a cluster's own
configuration (shuffle partitions, checkpoint folder, broadcast threshold)
always wins.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the plans rely on: adaptive execution re-plans joins from runtime
# sizes (small dimension -> broadcast, hot partner keys -> split skewed
# partitions) and coalesces the many small post-shuffle partitions.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply DEFAULTS where the session has no value yet.

    Only runtime settings are touched; a setting the session does not allow
    to change at runtime is left as it is."""
    conf = spark.conf
    for key, value in DEFAULTS.items():
        try:
            if conf.get(key, None) in (None, ""):
                conf.set(key, value)
        except Exception:  # noqa: BLE001 - static or unsupported setting
            continue
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from ``spark.checkpoint.dir``; only a local test session without
    one gets a private scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="donorlens-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the storage that holds ``path``, as Spark sees it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folder_exists(spark: SparkSession, path: str) -> bool:
    system, where = file_system(spark, path)
    return system.exists(where)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("donorlens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("DONORLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        # batch jobs: no Python stack capture on every DataFrame call (it
        # costs milliseconds per call while plans are built); static setting
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
