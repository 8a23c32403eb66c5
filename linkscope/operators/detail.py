"""Target drilldown.

Every function takes one target key or ``None``. With a key, both key columns are pushed
to the scan and the newest rows are a plain top-n. Without one, the same view is made for
all targets at once with a top-n per target: Spark cuts each task to n rows per target
before the shuffle. For a large n those rows are many, so a target's rows are first cut to n in
each of several shares, and what is left of the shares is cut again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkscope import schema
from linkscope.functions.events import target_key, unwrap_metadata
from linkscope.functions.filters import (
    for_target,
    in_window,
    incident_rows,
    since,
    state_rows,
    utc_moment,
    visible_tests,
)
from linkscope.operators import board, paths, state
from linkscope.session import shared_folder


def _scope(events: DataFrame, key: str | None, as_of: datetime | None, minutes: int | None) -> DataFrame:
    if key is not None:
        events = for_target(events, key)
    return in_window(events, as_of, minutes)


# From this n on, a target's rows are cut in shares first.
LARGE_N = 1000
SHARES = 32


def newest(rows: DataFrame, key: str | None, order: list[Column], n: int) -> DataFrame:
    """First n rows in order: overall for one target, else per target."""
    if key is not None:
        return rows.orderBy(*order).limit(n)

    def cut(frame: DataFrame, *keys: str | Column) -> DataFrame:
        first = Window.partitionBy(*keys).orderBy(*order)
        return frame.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n).drop("rank")

    if n >= LARGE_N:
        share = F.pmod(F.xxhash64(*rows.columns), F.lit(SHARES))
        rows = cut(rows.withColumn("share", share), "agent_id", "target_id", "share").drop("share")
    return cut(rows, "agent_id", "target_id")


def timeline(
    events: DataFrame,
    key: str | None = None,
    limit: int = schema.TIMELINE_LIMIT,
    as_of: datetime | None = None,
    window_minutes: int | None = None,
) -> DataFrame:
    """Newest rows having a latency (INFO rows too), oldest first."""
    measured = _scope(events, key, as_of, window_minutes).filter(F.col("latency_ms").isNotNull())
    order = state.newest_first(events)
    ties = state.tie_columns(events)
    rows = newest(
        measured.select("agent_id", "target_id", "timestamp_utc", "latency_ms", "result", "test_type", *ties),
        key,
        order,
        limit,
    )
    return rows.select(
        target_key().alias("target_key"), "timestamp_utc", "latency_ms", "result", "test_type", *ties
    ).orderBy("target_key", "timestamp_utc", *ties)


def tests(
    events: DataFrame,
    key: str | None = None,
    as_of: datetime | None = None,
    window_minutes: int | None = None,
) -> DataFrame:
    """Latest non-INFO row and row count per test type."""
    latest = state.latest_per_test(_scope(events, key, as_of, window_minutes))
    return latest.select(
        target_key().alias("target_key"),
        "test_type",
        F.col("result").alias("latest_result"),
        F.col("probe_name").alias("latest_probe_name"),
        F.col("target_address").alias("latest_target_address"),
        F.col("latency_ms").alias("last_latency_ms"),
        F.col("timestamp_utc").alias("last_timestamp_utc"),
        "event_count",
    ).orderBy("target_key", "test_type")


def recent_events(
    events: DataFrame,
    key: str | None = None,
    as_of: datetime | None = None,
    window_minutes: int | None = None,
    limit: int = schema.DETAIL_EVENT_LIMIT,
) -> DataFrame:
    """Newest rows of any result, metadata unwrapped."""
    rows = newest(
        _scope(events, key, as_of, window_minutes), key, state.newest_first(events), limit
    )
    return rows.select(
        target_key().alias("target_key"),
        "timestamp_utc",
        "test_type",
        "probe_name",
        "result",
        "target_address",
        "latency_ms",
        "error_code",
        "details",
        "dns_server",
        "path_hash",
        "hop_index",
        "hop_address",
        unwrap_metadata().alias("metadata"),
        *state.tie_columns(events),
    )


def recent_paths(
    events: DataFrame,
    key: str | None = None,
    as_of: datetime | None = None,
    window_minutes: int | None = None,
    limit: int = schema.DETAIL_PATH_LIMIT,
    kind_mode: str = "metadata",
) -> DataFrame:
    """Most recently seen paths of a target."""
    scoped = _scope(events, key, as_of, window_minutes)
    seen = paths.paths_from_hops(paths.latest_hops(scoped), kind_mode)
    order = [F.desc("last_seen_utc"), F.asc("path_hash"), F.asc("fqdn"), F.asc("target_kind")]
    return newest(seen, key, order, limit).drop("agent_id")


def recent_incidents(
    events: DataFrame,
    key: str | None = None,
    as_of: datetime | None = None,
    window_minutes: int | None = None,
    limit: int = schema.DETAIL_INCIDENT_LIMIT,
) -> DataFrame:
    rows = newest(
        incident_rows(_scope(events, key, as_of, window_minutes)), key, state.newest_first(events), limit
    )
    return rows.select(*board.incident_columns(), *state.tie_columns(events))


def feeding_rows(
    events: DataFrame, key: str, as_of: datetime | None, window_minutes: int | None, timeline_limit: int
) -> DataFrame:
    """The rows of one target that its drilldown frames are made of, stored; one scan of the events.

    Every row is tagged with the views it may feed, and each view keeps its newest rows: some hundred rows, one
    for each test type, and one for each hop of each path. Spark cuts each task to these before the shuffle.
    """
    own = for_target(events, key)
    inside = since(events, as_of, window_minutes)
    measured, decides = F.col("latency_ms").isNotNull(), F.col("result") != "INFO"
    incident, hop = ~F.col("result").isin("SUCCESS", "INFO"), F.col("hop_index").isNotNull()
    path = F.when(F.col("path_hash").isNull(), "").otherwise(F.concat(F.lit("="), "path_hash"))
    one = F.lit("")
    views = {
        "timeline": (inside & measured, one, timeline_limit),
        "events": (inside, one, schema.DETAIL_EVENT_LIMIT),
        "incidents": (inside & incident, one, schema.DETAIL_INCIDENT_LIMIT),
        "tests": (inside & decides, F.col("test_type"), 1),
        "hops": (inside & hop & (F.col("test_type") == "traceroute"), F.concat_ws("|", "hop_index", path), 1),
        "state": (decides, one, 1),
        "latency": (decides & measured, one, 1),
    }
    tags = [
        F.when(condition, F.struct(F.lit(name).alias("view"), part.alias("part"), F.lit(n).alias("most")))
        for name, (condition, part, n) in views.items()
    ]
    fed = F.explode_outer(F.filter(F.array(*tags), lambda tag: tag.isNotNull())).alias("tag")
    tagged = own.withColumn("row_id", F.monotonically_increasing_id()).select("*", fed).filter("tag IS NOT NULL")
    first = Window.partitionBy("tag.view", "tag.part").orderBy(*state.newest_first(events))
    most = max(n for _, _, n in views.values())
    kept = tagged.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most)
    kept = kept.filter(F.col("rank") <= F.col("tag.most")).dropDuplicates(["row_id"]).select(events.columns)
    folder = shared_folder(events.sparkSession, "detail")
    kept.coalesce(1).write.parquet(folder)
    return events.sparkSession.read.schema(kept.schema).parquet(folder)


def target_detail(
    events: DataFrame,
    key: str,
    as_of: datetime | None = None,
    window_minutes: int | None = None,
    timeline_limit: int = schema.TIMELINE_LIMIT,
    kind_mode: str = "metadata",
) -> dict[str, DataFrame]:
    """All drilldown frames of one target, from two scans of the events.

    The first, made at once, stores the rows that the frames need (:func:`feeding_rows`); the second counts the
    rows of each test type. The target row ignores the window. A target with only INFO rows does not exist: all
    frames are then empty.
    """
    as_of = utc_moment(as_of)
    own = feeding_rows(events, key, as_of, window_minutes, timeline_limit)
    counted = state_rows(_scope(events, key, as_of, window_minutes)).groupBy("test_type").agg(
        F.count(F.lit(1)).alias("event_count")
    )
    newest_tests = tests(own, key, as_of, window_minutes)
    frames = {
        "latency_series": timeline(own, key, timeline_limit, as_of, window_minutes),
        "tests": newest_tests.drop("event_count").join(counted, "test_type").select(newest_tests.columns),
        "recent_events": recent_events(own, key, as_of, window_minutes),
        "paths": recent_paths(own, key, as_of, window_minutes, kind_mode=kind_mode),
        "incidents": recent_incidents(own, key, as_of, window_minutes),
    }
    # One row with a result is enough to know that the target exists.
    exists = state_rows(own).limit(1).select(target_key().alias("target_key"))
    return {
        "target": board.targets(own, kind_mode),
        **{name: frame.join(exists, "target_key", "left_semi") for name, frame in frames.items()},
    }


def sample_series(
    series: DataFrame, n: int = schema.TIMELINE_SAMPLE, keys: tuple[str, ...] = ("target_key",)
) -> DataFrame:
    """At most n evenly spaced points per series, first and last kept.

    Point i of n sits at row ``round(i / (n - 1) * (length - 1))``, halves rounded up. Each
    row finds out by itself whether some i lands on it. The series are timelines, so they
    are at most a few hundred rows long.
    """
    if n < 2:
        raise ValueError("a sample needs at least two points")
    partition = Window.partitionBy(*keys)
    ordered = partition.orderBy("timestamp_utc", *state.tie_columns(series))
    numbered = series.withColumns(
        {"row": F.row_number().over(ordered) - 1, "length": F.count(F.lit(1)).over(partition)}
    )
    row, last = F.col("row"), F.greatest(F.col("length") - 1, F.lit(1))
    near = F.floor(row * F.lit(float(n - 1)) / last)

    def lands_here(i: Column) -> Column:
        at = F.floor((i / F.lit(n - 1)) * last + F.lit(0.5))
        return (i >= 0) & (i < n) & (at == row)

    hit = F.exists(F.array(near - 1, near, near + 1), lands_here)
    return numbered.filter((F.col("length") <= n) | hit).drop("row", "length")


def event_feed(
    recent: DataFrame, targets: DataFrame, test: str = "all", limit: int = schema.FEED_LIMIT
) -> DataFrame:
    """First visible rows of :func:`recent_events` per target, for one test or all."""
    rows = visible_tests(recent.join(targets.select("target_key", "target_kind"), "target_key"))
    if test != "all":
        rows = rows.filter(F.col("test_type") == test)
    by_target = Window.partitionBy("target_key").orderBy(*state.newest_first(recent))
    return rows.withColumn("rank", F.row_number().over(by_target)).filter(F.col("rank") <= limit).drop("rank")
