"""Session settings used by the tests, the bench and interactive runs.

On a cluster the session comes from ``spark-submit``; of this module the library uses
``exchange_dir`` and ``written`` only.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("resurvey")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def exchange_dir(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, below the shared folder the cluster names.

    A session whose tasks run in the driver's own process may do without ``spark.checkpoint.dir``
    and gets a temporary folder; on a cluster an unset folder is an error, since each machine
    would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="resurvey-")
    # the JVM makes the unique part, so two callers never share a path
    unique = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    return f"{root.rstrip('/')}/{name}-{unique}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table computed once, written to a fresh path and read back; for costly tables that are needed more than once."""
    spark, path = df.sparkSession, exchange_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
