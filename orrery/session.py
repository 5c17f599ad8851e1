"""SparkSession for tests, the benchmark and interactive use.

A cluster brings its own session; nothing in the library depends on the values set here except the time zone, which
every timestamp comparison assumes to be UTC.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "orrery", cpus: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with adaptive execution on; ``cpus`` defaults to $BENCH_CPUS, then 8."""
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
