"""Writers of the stored tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscope import schema
from linkscope.session import remove_folder
from linkscope.sources.batches import BATCH_KEYS
from linkscope.sources.tables import Lake, batch_id


def append_events(lake: Lake, events: DataFrame, run_id: str) -> None:
    """Append events under a run that is not committed yet.

    ``rebalance`` lets Spark size the output at run time: small days share a task, a day with
    a third of all rows is spread over many. Sorting by target makes row groups skippable.
    """
    names = schema.STORED_EVENT_SCHEMA.names
    rows = events.withColumn("event_date", F.to_date("timestamp_utc")).select(*[n for n in names if n != "run_id"])
    (
        rows.hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "agent_id", "target_id", "timestamp_utc")
        .withColumn("run_id", F.lit(run_id))
        .select(*names)
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(lake.path("events"))
    )


def remove_orphans(spark: SparkSession, lake: Lake, written_before: datetime) -> int:
    """Delete event files of runs that never reached the ledger; returns how many.

    Readers do not see their rows, so nothing they return changes. A run that is still on its way is not in
    the ledger either: ``written_before`` (UTC) must lie before the start of any run that may yet commit. A
    file holds rows of one run; only the column that names it is read.
    """
    try:
        stored = spark.read.schema(schema.STORED_EVENT_SCHEMA).parquet(lake.path("events"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    files = stored.select(
        "run_id",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("written"),
    )
    files = files.groupBy("path", "run_id").agg(F.max("written").alias("written"))
    known = lake.ledger(spark).select("run_id").distinct()
    old = F.col("written") < F.lit(written_before.isoformat(sep=" ")).cast("timestamp")
    removed = 0
    for row in files.filter(old).join(known, "run_id", "left_anti").select("path").distinct().toLocalIterator():
        remove_folder(spark, row.path)
        removed += 1
    return removed


def append_ledger(lake: Lake, batches: DataFrame) -> None:
    """Commit batches: from now on readers see their events."""
    rows = batches.select(*schema.LEDGER_SCHEMA.names)
    rows.hint("rebalance").write.mode("append").parquet(lake.path("ledger"))


def append_import_run(lake: Lake, run: DataFrame) -> None:
    run.select(*schema.IMPORT_RUN_SCHEMA.names).hint("rebalance").write.mode("append").parquet(
        lake.path("import_runs")
    )


def with_lineage(events: DataFrame) -> DataFrame:
    """Batch keys and line number as ``batch_id`` and ``seq``."""
    return events.withColumns({"batch_id": batch_id(), "seq": F.col("line_no")}).drop(*BATCH_KEYS, "line_no")
