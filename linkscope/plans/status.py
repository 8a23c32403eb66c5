"""Import status, aggregated from the log of import runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def import_source_status(runs: DataFrame) -> DataFrame:
    """One row per source: its latest run, and sums over all runs.

    The last success and the last batch time carry over from earlier runs.
    """
    order = F.struct("run_utc", "run_id")
    last = F.max_by(
        F.struct(
            "last_error", "last_source_identifier", "discovered", "imported", "skipped", "failed", "backlog"
        ),
        order,
    )
    had_import = F.when(F.col("last_imported_batch_utc").isNotNull(), order)
    return (
        runs.groupBy("source_type")
        .agg(
            F.max("run_utc").alias("last_run_utc"),
            F.max(F.when(F.col("failed") == 0, F.col("run_utc"))).alias("last_success_utc"),
            last.alias("last"),
            F.max_by("last_imported_batch_utc", had_import).alias("last_imported_batch_utc"),
            *[
                F.sum(name).alias(f"cumulative_{name}")
                for name in ("discovered", "imported", "skipped", "failed")
            ],
        )
        .select(
            "source_type",
            "last_run_utc",
            "last_success_utc",
            "last.last_error",
            "last_imported_batch_utc",
            "last.last_source_identifier",
            *[
                F.col(f"last.{name}").alias(f"last_run_{name}")
                for name in ("discovered", "imported", "skipped", "failed", "backlog")
            ],
            *[f"cumulative_{name}" for name in ("discovered", "imported", "skipped", "failed")],
        )
    )


def import_status(source_status: DataFrame, mode: str) -> DataFrame:
    """One row over all sources.

    The error shown is that of the erring source with the newest run; of equally new ones,
    the first by name.
    """
    has_error = F.length("last_error") > 0
    newest_error = F.min_by(
        "last_error",
        F.when(has_error, F.struct(-F.unix_micros(F.col("last_run_utc").cast("timestamp")), F.col("source_type"))),
    )
    return source_status.agg(
        F.lit(mode).alias("mode"),
        F.max("last_run_utc").alias("last_run_utc"),
        F.max("last_success_utc").alias("last_success_utc"),
        newest_error.alias("last_error"),
        *[
            F.coalesce(F.sum(f"cumulative_{name}"), F.lit(0)).alias(f"cumulative_{name}")
            for name in ("discovered", "imported", "skipped", "failed")
        ],
    )


def import_run_result(source_status: DataFrame, mode: str) -> DataFrame:
    """Counters of the latest run of every source, summed."""
    return source_status.agg(
        F.lit(mode).alias("mode"),
        *[
            F.coalesce(F.sum(f"last_run_{name}"), F.lit(0)).alias(name)
            for name in ("discovered", "imported", "skipped", "failed")
        ],
    )
