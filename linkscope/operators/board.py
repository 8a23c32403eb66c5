"""Fleet, agent, site, target and incident views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope import schema
from linkscope.functions.events import target_key, target_kind
from linkscope.functions.filters import in_window, incident_rows, since
from linkscope.operators import state

TARGET_STATE = (
    "fqdn",
    "site_id",
    "target_address",
    "test_type",
    "result",
    "timestamp_utc",
    "metadata",
)


def _count_if(condition: Column) -> Column:
    return F.count_if(condition)


def fleet_summary(
    events: DataFrame, as_of: datetime | None = None, window_minutes: int | None = None
) -> DataFrame:
    """One row of fleet counters; zeros and a null time when there are no events.

    The rows are first reduced to one per (site, agent, target), so the three distinct
    counts run over targets and not over events.
    """
    if window_minutes is not None:
        events = in_window(events, as_of, window_minutes)
    return _summary(events.groupBy(*state.SITE_TARGET_KEYS).agg(*_counters()))


def _counters(inside: Column | None = None) -> list[Column]:
    """Counters of a group's rows, or of those that are ``inside``."""
    inside = F.lit(True) if inside is None else inside
    return [
        _count_if(inside).alias("events"),
        _count_if(inside & F.col("result").isin("FAILURE", "FATAL")).alias("failures"),
        _count_if(inside & (F.col("result") == "TIMEOUT")).alias("timeouts"),
        F.max(F.when(inside, F.col("timestamp_utc"))).alias("latest"),
    ]


def _summary(per_target: DataFrame) -> DataFrame:
    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("long")

    return per_target.agg(
        total("events").alias("total_events"),
        F.countDistinct("agent_id").alias("total_agents"),
        F.countDistinct(target_key()).alias("total_targets"),
        F.countDistinct("site_id").alias("active_sites"),
        total("failures").alias("failure_events"),
        total("timeouts").alias("timeout_events"),
        F.max("latest").alias("latest_timestamp_utc"),
    )


def roll_up(events: DataFrame, as_of: datetime | None = None, window_minutes: int | None = None) -> DataFrame:
    """One row per (site, agent, target) from which summary, agents, sites and targets are made, in one pass.

    State and latency with the order of the events they come from, so that rows can be reduced again to fewer
    keys; and the counters of the rows in the window.
    """
    order, decides = state.event_order(events), F.col("result") != "INFO"
    measured = decides & F.col("latency_ms").isNotNull()
    return events.groupBy(*state.SITE_TARGET_KEYS).agg(
        F.max_by(F.struct(*[c for c in TARGET_STATE if c != "site_id"]), F.when(decides, order)).alias("newest"),
        F.max(F.when(decides, order)).alias("newest_at"),
        F.max_by("latency_ms", F.when(measured, order)).alias("last_latency_ms"),
        F.max(F.when(measured, order)).alias("latency_at"),
        *_counters(since(events, as_of, window_minutes)),
    )


def summary_from_roll_up(rolled: DataFrame) -> DataFrame:
    return _summary(rolled.filter("events > 0"))


def state_from_roll_up(rolled: DataFrame) -> DataFrame:
    """The frame of :func:`target_state`: a target's sites reduced to the newest."""
    return (
        rolled.filter(F.col("newest_at").isNotNull())
        .withColumn("newest", F.col("newest").withField("site_id", F.col("site_id")))
        .groupBy(*state.TARGET_KEYS)
        .agg(
            F.max_by("newest", "newest_at").alias("newest"),
            F.max_by("last_latency_ms", "latency_at").alias("last_latency_ms"),
        )
        .select(*state.TARGET_KEYS, *[F.col("newest")[c].alias(c) for c in TARGET_STATE], "last_latency_ms")
    )


def sites_from_roll_up(rolled: DataFrame) -> DataFrame:
    current = rolled.filter(F.col("newest_at").isNotNull())
    return sites_from_state(
        current.select(*state.SITE_TARGET_KEYS, "newest.result", "newest.timestamp_utc", "last_latency_ms")
    )


def target_state(events: DataFrame) -> DataFrame:
    """Current state per target: the frame behind ``targets`` and ``agents``."""
    return state.latest_state_and_latency(events, state.TARGET_KEYS, TARGET_STATE)


def targets_from_state(current: DataFrame, kind_mode: str = "metadata") -> DataFrame:
    return current.select(
        target_key().alias("target_key"),
        "target_id",
        target_kind(mode=kind_mode).alias("target_kind"),
        "agent_id",
        "fqdn",
        "site_id",
        "target_address",
        F.col("test_type").alias("last_test_type"),
        F.col("result").alias("latest_result"),
        "last_latency_ms",
        F.col("timestamp_utc").alias("last_timestamp_utc"),
    )


def targets(events: DataFrame, kind_mode: str = "metadata") -> DataFrame:
    """Latest non-INFO state per target with its latest latency, ordered for display."""
    return targets_from_state(target_state(events), kind_mode).orderBy(
        "target_kind", "fqdn", "agent_id", "target_id"
    )


def agents_from_state(current: DataFrame) -> DataFrame:
    return current.groupBy("agent_id").agg(
        F.max("site_id").alias("site_id"),
        F.count(F.lit(1)).alias("total_targets"),
        _count_if(F.col("result") == "SUCCESS").alias("healthy_targets"),
        _count_if(F.col("result").isin("FAILURE", "FATAL")).alias("failing_targets"),
        _count_if(F.col("result") == "TIMEOUT").alias("timeout_targets"),
        F.avg("last_latency_ms").alias("average_latency_ms"),
        F.max("timestamp_utc").alias("last_timestamp_utc"),
    )


def agents(events: DataFrame) -> DataFrame:
    """Roll-up of the current target states per agent, most recently heard first.

    EMPTY and SKIPPED targets count in the total only.
    """
    current = state.latest_state_and_latency(events, carry=("site_id", "result", "timestamp_utc"))
    return agents_from_state(current).orderBy(F.desc("last_timestamp_utc"), "agent_id")


def sites(events: DataFrame) -> DataFrame:
    """Roll-up per site; here a timeout counts as failing.

    State is kept per (site, agent, target): a target that moved is current in both sites.
    """
    return sites_from_state(state.latest_state_and_latency(events, state.SITE_TARGET_KEYS))


def sites_from_state(current: DataFrame) -> DataFrame:
    return (
        current.groupBy("site_id")
        .agg(
            F.countDistinct("agent_id").alias("agent_count"),
            F.count(F.lit(1)).alias("target_count"),
            _count_if(F.col("result").isin("FAILURE", "FATAL", "TIMEOUT")).alias("failing_targets"),
            F.avg("last_latency_ms").alias("average_latency_ms"),
            F.max("timestamp_utc").alias("last_timestamp_utc"),
        )
        .orderBy("site_id")
    )


def target_counts(target_rows: DataFrame) -> DataFrame:
    """Number of targets per kind."""
    return target_rows.groupBy("target_kind").agg(F.count(F.lit(1)).alias("target_count"))


def incident_columns() -> list[Column | str]:
    return [
        target_key().alias("target_key"),
        "target_id",
        "fqdn",
        "test_type",
        "result",
        "error_code",
        "details",
        "timestamp_utc",
    ]


def incidents(events: DataFrame, limit: int = schema.INCIDENT_LIMIT) -> DataFrame:
    """Newest incident rows of the fleet."""
    return (
        incident_rows(events)
        .orderBy(*state.newest_first(events))
        .limit(limit)
        .select(*incident_columns())
    )
