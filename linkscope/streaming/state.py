"""Streams that keep board frames current.

There is no watermark: an event of any age is accepted, and order is by event time, so a late
row may fill in history but never replaces newer state. The streaming aggregate keeps one row
per target; routes keep the newest hops of each path. Both reduce rows within each task before the shuffle.

Changed rows are appended per micro-batch under ``epoch=<id>``; replaying a micro-batch
rewrites its own folder. Readers take the newest epoch per key. Folders are merged in tiers: every 20
epochs become a ``run1``, every 20 of those a ``run2``, and so on, each with the newest rows per key of what it
replaces. A merge so writes rows of its own tier only, however many keys there are in all, and a row
is written again once per tier. What a run replaced is deleted when the next run of its tier is there, so a
reader that began before a merge finds its files, and a merge cut short is simply made again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from linkscope.functions.filters import incident_rows
from linkscope.operators import board, paths, state
from linkscope.session import numbered_folders, remove_folder
from linkscope.streaming import routes


def _start(
    frame: DataFrame, write, checkpoint: str, mode: str, interval_seconds: int | None
) -> StreamingQuery:
    writer = (
        frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    )
    if interval_seconds is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{interval_seconds} seconds")
    return writer.start()


# So many folders of a tier are merged into one of the next.
MERGE_EVERY = 20


def write_epoch(rows: DataFrame, path: str, epoch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")


def _kind(tier: int) -> str:
    return f"run{tier}" if tier else "epoch"


def _current_folders(spark: SparkSession, path: str) -> list[str]:
    """The fewest complete folders that hold all rows: those of the highest tier, then what came after them."""
    found, after, chosen = numbered_folders(spark, path), -1, []
    tiers = [int(kind[3:]) for kind in found if kind.startswith("run")]
    for tier in range(max(tiers, default=0), -1, -1):
        for number in [n for n in found.get(_kind(tier), []) if n > after]:
            chosen.append(f"{_kind(tier)}={number}")
            after = number
    return chosen


def _read_folders(spark: SparkSession, path: str, folders: Sequence[str], rows: T.StructType) -> DataFrame:
    """Rows with their epoch. In a run it is a column, for an epoch it is the folder's name."""
    columns = T.StructType([*rows.fields, T.StructField("epoch", T.LongType())])
    runs = [f"{path}/{name}" for name in folders if name.startswith("run")]
    epochs = [f"{path}/{name}" for name in folders if name.startswith("epoch=")]
    parts = [spark.read.schema(columns).parquet(*runs)] if runs else []
    if epochs:
        parts.append(spark.read.schema(columns).option("basePath", path).parquet(*epochs))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], columns)


def stored_epochs(spark: SparkSession, path: str, rows: T.StructType) -> DataFrame:
    """All rows of a folder written by :func:`write_epoch`, with their epoch."""
    path = path.rstrip("/")
    return _read_folders(spark, path, _current_folders(spark, path), rows)


def merge_epochs(
    spark: SparkSession, path: str, rows: T.StructType, keys: Sequence[str], epoch: int, every: int = MERGE_EVERY
) -> None:
    """Merge the tiers that the epoch completes, and delete what the runs before these replaced.

    All rows of a key's newest epoch stay. A replayed micro-batch makes its runs again, from the same folders.
    """
    path, tier = path.rstrip("/"), 1
    while (epoch + 1) % every**tier == 0:
        first = epoch - every**tier
        below = _kind(tier - 1)
        found = numbered_folders(spark, path).get(below, [])
        parts = [f"{below}={n}" for n in found if first < n <= epoch]
        merged = newest_rows(_read_folders(spark, path, parts, rows), keys)
        merged.write.mode("overwrite").parquet(f"{path}/{_kind(tier)}={epoch}")
        for number in [n for n in found if n <= first]:
            remove_folder(spark, f"{path}/{below}={number}")
        tier += 1


def newest_rows(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of each key's newest epoch."""
    newest = stored.groupBy(*keys).agg(F.max("epoch").alias("epoch"))
    return stored.join(newest, [*keys, "epoch"], "left_semi").select(stored.columns)


def read_latest(
    spark: SparkSession, path: str, rows: T.StructType, keys: Sequence[str]
) -> DataFrame:
    """Newest epoch per key of a folder written by :func:`write_epoch`."""
    stored = stored_epochs(spark, path, rows)
    values = [c for c in rows.names if c not in keys]
    return (
        stored.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), F.col("epoch")).alias("newest"))
        .select(*keys, "newest.*")
    )


# -- latest state ------------------------------------------------------------


def start_latest_state(
    events: DataFrame,
    path: str,
    checkpoint: str,
    interval_seconds: int | None = None,
    merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Keep the current state and latency of every target under ``path``."""
    current = board.target_state(events)

    def write(rows: DataFrame, epoch: int) -> None:
        write_epoch(rows, path, epoch)
        merge_epochs(rows.sparkSession, path, current.schema, state.TARGET_KEYS, epoch, merge_every)

    return _start(current, write, checkpoint, "update", interval_seconds)


def read_latest_state(spark: SparkSession, path: str, events: DataFrame) -> DataFrame:
    return read_latest(spark, path, board.target_state(events).schema, state.TARGET_KEYS)


# -- incidents ---------------------------------------------------------------


def start_incidents(
    events: DataFrame, path: str, checkpoint: str, interval_seconds: int | None = None
) -> StreamingQuery:
    """Append incident rows as they arrive; stateless, exactly once by the file sink."""
    rows = incident_rows(events).select(*board.incident_columns(), *state.tie_columns(events))
    writer = (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if interval_seconds is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{interval_seconds} seconds")
    return writer.start()


# -- path changes ------------------------------------------------------------


def start_path_changes(
    events: DataFrame,
    path: str,
    checkpoint: str,
    interval_seconds: int | None = None,
    merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Keep the path changes of every target under ``path``.

    Routes are kept per target in the state store; see :mod:`linkscope.streaming.routes`. A micro-batch stores the
    changes of the targets whose routes it changed, and reads nothing but its own rows.
    """

    def write(seen: DataFrame, epoch: int) -> None:
        changes = paths.changes_from_sightings(seen)
        write_epoch(changes, path, epoch)
        merge_epochs(seen.sparkSession, path, changes.schema, ("target_key",), epoch, merge_every)

    with routes.state_in_rocksdb(events.sparkSession):
        return _start(routes.sighting_stream(events), write, checkpoint, "update", interval_seconds)


def read_path_changes(spark: SparkSession, path: str) -> DataFrame:
    """Current path changes: per target, those of the newest epoch that touched it."""
    folders = _current_folders(spark, path)
    if folders:
        rows = spark.read.parquet(f"{path.rstrip('/')}/{folders[-1]}").drop("epoch").schema
    else:
        rows = paths.changes_from_sightings(spark.createDataFrame([], routes.SIGHTINGS)).schema
    return newest_rows(stored_epochs(spark, path, rows), ("target_key",)).drop("epoch")
