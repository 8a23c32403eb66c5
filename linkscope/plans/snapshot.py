"""The board snapshot: every list of the fleet board as one set of tables."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscope import schema
from linkscope.operators import board, paths
from linkscope.plans import status
from linkscope.session import numbered_folders, remove_folder, shared_folder


def board_snapshot(
    spark: SparkSession,
    events: DataFrame,
    import_runs: DataFrame,
    as_of: datetime,
    window_minutes: int | None = schema.DEFAULT_WINDOW_MINUTES,
    mode: str = "disabled",
    kind_mode: str = "metadata",
) -> dict[str, DataFrame]:
    """All board frames, from three passes over the events. Only the summary looks back a limited time.

    One aggregate by (site, agent, target) feeds summary, agents, sites and targets, the latest hops feed paths and
    path changes. Both are written once to the shared folder; the raw events are never cached. The third pass
    takes the newest incidents.
    """
    folder = shared_folder(spark, "snapshot")
    board.roll_up(events, as_of, window_minutes).write.parquet(f"{folder}/targets")
    paths.latest_hops(events).write.parquet(f"{folder}/hops")
    rolled = spark.read.parquet(f"{folder}/targets")
    hops = spark.read.parquet(f"{folder}/hops")
    current = board.state_from_roll_up(rolled)
    sources = status.import_source_status(import_runs)
    return {
        "summary": board.summary_from_roll_up(rolled).withColumn(
            "refreshed_utc", F.lit(as_of.isoformat(sep=" ")).cast("timestamp")
        ),
        "agents": board.agents_from_state(current),
        "sites": board.sites_from_roll_up(rolled),
        "targets": board.targets_from_state(current, kind_mode),
        "paths": paths.paths_from_hops(hops, kind_mode),
        "path_changes": paths.newest_changes(
            paths.changes_from_hops(hops, kind_mode), schema.PATH_CHANGE_LIMIT
        ),
        "incidents": board.incidents(events),
        "import_sources": sources,
        "import_status": status.import_status(sources, mode),
    }


# Versions of a snapshot that stay: the one that readers take, and the one they may still read.
KEPT_VERSIONS = 2


def write_snapshot(frames: dict[str, DataFrame], path: str) -> int:
    """Store the frames as a new version, one Parquet table per frame; returns its number.

    ``epoch=<version>`` is written last and names the frames: from then on readers take all of them from the new
    version. A version that was cut short is never read. Versions before the last two are deleted.
    """
    path, version = path.rstrip("/"), time.time_ns() // 1000
    spark = next(iter(frames.values())).sparkSession
    for name, frame in frames.items():
        frame.write.parquet(f"{path}/version={version}/{name}")
    spark.createDataFrame([(name,) for name in frames], "frame string").write.parquet(f"{path}/epoch={version}")
    versions = numbered_folders(spark, path).get("epoch", [])
    for old in versions[:-KEPT_VERSIONS]:
        remove_folder(spark, f"{path}/epoch={old}")
        remove_folder(spark, f"{path}/version={old}")
    return version


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All frames of the newest complete version; none where nothing was written."""
    path = path.rstrip("/")
    versions = numbered_folders(spark, path).get("epoch", [])
    if not versions:
        return {}
    names = spark.read.parquet(f"{path}/epoch={versions[-1]}").collect()
    return {row.frame: spark.read.parquet(f"{path}/version={versions[-1]}/{row.frame}") for row in names}
