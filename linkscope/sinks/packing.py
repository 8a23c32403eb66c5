"""Merging the small event files that many import runs leave.

A packing copies rows; it does not judge them. Each keeps its run and batch, so the ledger decides as
before which rows are seen. Its rows and the list of the files that they stand for lie in folders of its
own, and one log entry, created once and never overwritten, turns readers from the old files to the new.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkscope import schema
from linkscope.session import claim_file, file_names, remove_folder, scratch, shared_folder
from linkscope.sources.tables import Lake, read_or_empty

TARGET_BYTES = 128 << 20
LEAST_FILES = 8
# A file below this share of the target is small. What one packing writes is above it wherever a day has the
# bytes, so rows are copied again only while a day's files are small: about log(target) / log(least files) times.
SMALL_SHARE = 4
# Beyond so many output files a task writes several.
MOST_TASKS = 100_000


class PackingConflict(RuntimeError):
    """Another packing was committed after this one had chosen its files."""


def small_files(spark: SparkSession, lake: Lake, target_bytes: int, least_files: int) -> DataFrame:
    """The files worth packing, with the number of files (``shares``) that their day is packed into and the number
    of those of earlier days (``first``).

    Days with fewer small files than ``least_files`` are left alone, and so are rows without a date and files with
    a row of a run that is not in the ledger: it may still be writing, or it was lost and its files will be removed. The size is
    a condition on the file's name in the listing, so larger files are not opened; of small ones one column is read.
    """
    rows = lake.stored_events(spark).where(F.col("file_size") < max(1, target_bytes // SMALL_SHARE))
    writers = rows.groupBy("source_pack", "event_date", "file_name", "file_size", "run_id").agg(F.count("*").alias("n"))
    known = lake.ledger(spark).select("run_id", F.lit(True).alias("known")).distinct()
    folder = shared_folder(spark, "small-files")
    (
        writers.join(known, "run_id", "left")
        .groupBy("source_pack", "event_date", "file_name", "file_size")
        .agg(F.count("known").alias("known"), F.count("*").alias("runs"))
        .where("known = runs AND event_date IS NOT NULL")
        .write.parquet(folder)
    )
    files = spark.read.parquet(folder)
    days = (
        files.groupBy("event_date")
        .agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
        .where(F.col("files") >= least_files)
        .select("event_date", F.ceil(F.col("bytes") / target_bytes).cast("int").alias("shares"))
    )
    before = Window.orderBy("event_date").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = days.withColumn("first", F.coalesce(F.sum("shares").over(before), F.lit(0)))
    return files.join(days, "event_date").select("source_pack", "event_date", "file_name", "shares", "first")


def pack_events(
    spark: SparkSession, lake: Lake, target_bytes: int = TARGET_BYTES, least_files: int = LEAST_FILES
) -> int:
    """Copy the rows of small event files into files of about ``target_bytes``; returns how many files it replaced.

    Readers see the same rows before, during and after. The replaced files stay until ``remove_packed``
    deletes them, for readers that began earlier. Imports may go on meanwhile. Of two packings at once the one
    that commits last raises ``PackingConflict`` and changes nothing, nor does one that is lost on its way.
    A day's rows are dealt to its files by a hash of their place in their batch, so no target or batch is too
    large for a task, and are sorted by target inside each.
    """
    if target_bytes < 1 or least_files < 2:
        raise ValueError("target_bytes must be at least 1 and least_files at least 2")
    entry = f"{len(file_names(spark, lake.path('packs/log'))):08d}.json"  # taken before any file is listed
    pack_id = _new_pack_id()
    with scratch(spark, f"packing-{pack_id}"):
        folder = shared_folder(spark, "chosen")
        small_files(spark, lake, target_bytes, least_files).write.parquet(folder)
        chosen = spark.read.parquet(folder)
        totals = chosen.agg(F.count("*").alias("files"), F.max(F.col("first") + F.col("shares")).alias("outputs")).first()
        if not totals.files:
            return 0
        tasks = min(totals.outputs, MOST_TASKS)
        share = F.pmod(F.xxhash64("run_id", "batch_id", "seq"), F.col("shares"))
        rows = lake.stored_events(spark).where(F.col("file_size") < max(1, target_bytes // SMALL_SHARE))
        (
            rows.join(chosen, ["source_pack", "event_date", "file_name"])
            .repartitionById(tasks, F.pmod(F.col("first") + share, F.lit(tasks)).cast("int"))
            .sortWithinPartitions("event_date", "agent_id", "target_id", "timestamp_utc")
            .select(*schema.STORED_EVENT_SCHEMA.names)
            .write.partitionBy("event_date")
            .parquet(lake.path(f"packs/events/pack_id={pack_id}"))
        )
        chosen.select("file_name", "event_date", "source_pack").write.parquet(
            lake.path(f"packs/replaced/pack_id={pack_id}")
        )
        at = datetime.now(timezone.utc).isoformat()
        if not claim_file(spark, lake.path(f"packs/log/{entry}"), json.dumps({"pack_id": pack_id, "packed_utc": at})):
            raise PackingConflict(pack_id)
    return totals.files


def remove_packed(spark: SparkSession, lake: Lake, packed_before: datetime) -> int:
    """Delete the event files that packings replaced before a moment (UTC); returns how many.

    Folders of packings that began before it and never reached the log go as well. ``packed_before`` must lie before the start of any reader or packing that still runs. A call that is
    lost halfway can be repeated: a packing's list goes after the last of its files.
    """
    names = file_names(spark, lake.path("packs/log"))
    log = lake.pack_log(spark) if names else None
    committed = {row.pack_id: row.packed_utc for row in log.collect()} if names else {}  # one row a packing
    listed = [name.partition("=")[2] for name in file_names(spark, lake.path("packs/replaced"))]
    done = [pack_id for pack_id in listed if pack_id in committed and committed[pack_id] < packed_before]
    removed = 0
    if done:
        replaced = read_or_empty(spark, lake.path("packs/replaced"), schema.REPLACED_SCHEMA)
        moment = F.lit(packed_before.isoformat(sep=" ")).cast("timestamp")
        old = log.where(F.col("packed_utc") < moment).select("pack_id")
        for row in replaced.join(old, "pack_id", "left_semi").toLocalIterator():
            home = f"packs/events/pack_id={row.source_pack}" if row.source_pack else "events"
            remove_folder(spark, lake.path(f"{home}/event_date={row.event_date.isoformat()}/{row.file_name}"))
            removed += 1
    for pack_id in file_names(spark, lake.path("packs/events")):
        pack_id = pack_id.partition("=")[2]
        if pack_id not in committed and _started(pack_id) < packed_before:
            done.append(pack_id)
            remove_folder(spark, lake.path(f"packs/events/pack_id={pack_id}"))
    for pack_id in done:
        remove_folder(spark, lake.path(f"packs/replaced/pack_id={pack_id}"))
    return removed


def _new_pack_id() -> str:
    return f"p{datetime.now(timezone.utc):%Y%m%d%H%M%S}-{uuid.uuid4().hex}"


def _started(pack_id: str) -> datetime:
    """When a packing began (UTC), from its name."""
    return datetime.strptime(pack_id[1:15], "%Y%m%d%H%M%S")
