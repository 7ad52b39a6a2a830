"""Session builder used by the tests, the benchmark and interactive runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "quarryline", cores: int | None = None) -> SparkSession:
    """A local session with the settings the library is tested under.

    On a cluster, build the session yourself; nothing in the library needs a
    setting from here, it only reads ``spark.checkpoint.dir`` when present.
    """
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUARRYLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
