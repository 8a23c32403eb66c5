"""Latest row per key.

Events with equal timestamps are ordered by their lineage columns, so that every
result is a function of the data alone.

The latest row is an aggregate (``max_by`` over a struct), not a window: each task
reduces its rows to one per key before the shuffle, so a target that holds a third of
all events still sends one row per task, and state and latency share a single pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope.functions.filters import state_rows

TARGET_KEYS = ("agent_id", "target_id")
SITE_TARGET_KEYS = ("site_id", "agent_id", "target_id")


def tie_columns(events: DataFrame) -> list[str]:
    """Columns that order events of equal timestamp."""
    return [c for c in ("batch_id", "event_id", "seq") if c in events.columns]


def event_order(events: DataFrame, timestamp: str = "timestamp_utc") -> Column:
    return F.struct(timestamp, *tie_columns(events))


def newest_first(events: DataFrame, timestamp: str = "timestamp_utc") -> list[Column]:
    return [F.desc(timestamp), *[F.desc(c) for c in tie_columns(events)]]


def latest_by(events: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """One row per key: the carried columns of its newest event."""
    newest = F.max_by(F.struct(*carry), event_order(events)).alias("newest")
    return events.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def latest_state(
    events: DataFrame, keys: Sequence[str] = TARGET_KEYS, carry: Sequence[str] = ("result", "timestamp_utc")
) -> DataFrame:
    """Newest non-INFO row per key."""
    return latest_by(state_rows(events), keys, carry)


def latest_latency(events: DataFrame, keys: Sequence[str] = TARGET_KEYS) -> DataFrame:
    """Newest non-null latency per key, whatever row the state comes from."""
    measured = state_rows(events).filter(F.col("latency_ms").isNotNull())
    return latest_by(measured, keys, ("latency_ms",)).withColumnRenamed("latency_ms", "last_latency_ms")


def latest_state_and_latency(
    events: DataFrame, keys: Sequence[str] = TARGET_KEYS, carry: Sequence[str] = ("result", "timestamp_utc")
) -> DataFrame:
    """Left join of :func:`latest_state` and :func:`latest_latency`, done in one aggregation."""
    order = event_order(events)
    measured = F.when(F.col("latency_ms").isNotNull(), order)
    return (
        state_rows(events)
        .groupBy(*keys)
        .agg(
            F.max_by(F.struct(*carry), order).alias("newest"),
            F.max_by("latency_ms", measured).alias("last_latency_ms"),
        )
        .select(*keys, "newest.*", "last_latency_ms")
    )


def join_state_latency(state: DataFrame, latency: DataFrame, keys: Sequence[str] = TARGET_KEYS) -> DataFrame:
    """Join separately kept state and latency frames; a target without latency stays."""
    return state.join(latency, list(keys), "left")


def latest_per_test(events: DataFrame, keys: Sequence[str] = TARGET_KEYS) -> DataFrame:
    """Newest non-INFO row per key and test type, with the number of such rows."""
    carry = F.struct("result", "probe_name", "target_address", "latency_ms", "timestamp_utc")
    return (
        state_rows(events)
        .groupBy(*keys, "test_type")
        .agg(
            F.max_by(carry, event_order(events)).alias("newest"),
            F.count(F.lit(1)).alias("event_count"),
        )
        .select(*keys, "test_type", "newest.*", "event_count")
    )


def partition_count(events: DataFrame, keys: Sequence[str], name: str = "event_count") -> DataFrame:
    """Every row with the number of rows of its key.

    A count per key is joined back instead of a window: a window would send all rows of a
    hot key to one task, while the counts are tiny and the join can be split.
    """
    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return events.join(counts, list(keys))
