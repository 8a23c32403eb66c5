"""A local session for tests, comparisons and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from linkscope.session import configure


def local_session(cpus: int | str | None = None) -> SparkSession:
    cores = cpus or os.environ.get("BENCH_CPUS") or 8
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("linkscope")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
