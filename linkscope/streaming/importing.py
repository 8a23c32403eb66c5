"""Continuous import."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkscope import schema
from linkscope.plans import importing
from linkscope.session import numbered_folders, remove_folder, scratch, shared_folder
from linkscope.sources import batches
from linkscope.sources.tables import Lake, new_batches


def check_interval(seconds: int) -> int:
    if seconds < 1:
        raise ValueError("the import interval is at least one second")
    return seconds


def start_import_cycles(
    spark: SparkSession,
    lake: Lake,
    sources: Iterable[batches.BatchSource],
    checkpoint: str,
    interval_seconds: int = schema.DEFAULT_IMPORT_INTERVAL_SECONDS,
    on_cycle: Callable[[list[importing.ImportResult]], None] | None = None,
) -> StreamingQuery:
    """Run an import cycle at once, and then one every interval.

    Every cycle lists its sources anew, so rewritten files are imported again and failed
    batches are retried. The rate source only keeps the time.
    """
    check_interval(interval_seconds)
    sources = list(sources)

    def cycle(_: DataFrame | None, __: int) -> None:
        results = importing.import_all(spark, lake, sources)
        if on_cycle:
            on_cycle(results)

    cycle(None, -1)
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        clock.writeStream.foreachBatch(cycle)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{interval_seconds} seconds")
        .start()
    )


def start_file_import(
    spark: SparkSession,
    lake: Lake,
    source: batches.FileSource,
    checkpoint: str,
    interval_seconds: int | None = None,
    max_files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Import files as they appear, without listing content again.

    The file stream hands every file to one micro-batch, and only its lines are read. Files that failed are read
    again, as they are then, with the next micro-batch that brings new files, until they are imported or gone; as
    long as there are such files, each micro-batch lists the location. With no interval the stream drains
    what is there and ends. Empty files bring no lines and are not seen here; import cycles report them, and
    files that are rewritten after they were imported.
    """
    lines = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", source.pattern)
        .option("maxFilesPerTrigger", max_files_per_batch)
        .text(source.location)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            batches.stat_fingerprint(
                F.col("_metadata.file_size"), F.col("_metadata.file_modification_time")
            ).alias("fingerprint"),
        )
    )

    def import_batch(batch: DataFrame, epoch: int) -> None:
        import_file_lines(batch.sparkSession, lake, source, batch, epoch)

    writer = lines.writeStream.foreachBatch(import_batch).option("checkpointLocation", checkpoint)
    if interval_seconds is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{check_interval(interval_seconds)} seconds")
    return writer.start()


def _failed_before(spark: SparkSession, folder: str, epoch: int) -> DataFrame | None:
    """Identifiers of the files that failed up to the micro-batch before this one; None if there are none."""
    epochs = numbered_folders(spark, folder).get("epoch", [])
    earlier = [n for n in epochs if n < epoch]
    if not earlier:
        return None
    failed = spark.read.schema("source_identifier string").parquet(f"{folder}/epoch={earlier[-1]}")
    return None if failed.isEmpty() else failed


def import_file_lines(
    spark: SparkSession, lake: Lake, source: batches.FileSource, lines: DataFrame, epoch: int
) -> None:
    """Import one micro-batch of whole files, and the files that failed before.

    A replayed micro-batch is skipped by the ledger. The files that failed are kept under ``stream_retries``, one
    complete list for each micro-batch; a replay writes its own list again, from the one before.
    """
    at, run_id = importing.utc_now(), uuid.uuid4().hex
    retries = lake.path(f"stream_retries/{source.source_type}")
    with scratch(spark, f"stream-{run_id}"):
        # The micro-batch is scanned once; line numbers come from what was stored.
        folder = shared_folder(spark, "lines")
        batches.with_row_numbers(lines).write.parquet(f"{folder}/rows")
        rows = spark.read.parquet(f"{folder}/rows")
        identifier = source.identifier_of_uri(F.col("file_path"))
        batches.line_blocks(rows, ("file_path", "fingerprint")).withColumns(
            {"source_type": F.lit(source.source_type), "source_identifier": identifier}
        ).write.parquet(f"{folder}/blocks")
        blocks = spark.read.parquet(f"{folder}/blocks")
        listing = blocks.select(*batches.BATCH_KEYS).distinct()
        pending = new_batches(listing, lake.ledger(spark)).distinct()
        wanted = blocks.join(pending, importing.KEYS, "left_semi")
        numbered = rows.join(wanted.drop("fingerprint"), ["file_path", "block_start"]).select(
            *batches.BATCH_KEYS, batches.line_number().alias("line_no"), "value"
        )
        failed = _failed_before(spark, retries, epoch)
        if failed is not None:
            again = (
                replace(source, fingerprint="stat")
                .batches(spark)
                .join(failed, "source_identifier", "left_semi")
                .join(listing, "source_identifier", "left_anti")
            )
            again.write.parquet(f"{folder}/again")
            again = new_batches(spark.read.parquet(f"{folder}/again"), lake.ledger(spark))
            keys = again.select(*batches.BATCH_KEYS)
            numbered = numbered.unionByName(source.lines(spark, again).select(*numbered.columns))
            listing, pending = listing.unionByName(keys), pending.unionByName(keys)
        verdicts = importing.commit_batches(spark, lake, importing.check_lines(numbered), pending, run_id, at)
        bad = verdicts.filter(F.col("error").isNotNull()).select("source_identifier").distinct()
        bad.write.mode("overwrite").parquet(f"{retries}/epoch={epoch}")
        record = importing.run_record(verdicts, listing, source.source_type, run_id, at)
        importing.log_run(spark, lake, record.first())
    # The list before this one stays for a replay.
    epochs = numbered_folders(spark, retries).get("epoch", [])
    for old in [n for n in epochs if n < epoch][:-1]:
        remove_folder(spark, f"{retries}/epoch={old}")
