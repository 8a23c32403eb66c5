"""Row filters over event and target frames."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope import schema
from linkscope.functions.events import target_key


def resolve_window_minutes(minutes: int | None = None, hours: int | None = None) -> int | None:
    """Look-back in minutes: minutes win over hours, 0 means no bound, both absent 24 hours."""
    for value, factor in ((minutes, 1), (hours, 60)):
        if value is not None:
            if value < 0:
                raise ValueError("a window cannot be negative")
            return value * factor or None
    return schema.DEFAULT_WINDOW_MINUTES


def window_minutes(minutes: Column, hours: Column) -> Column:
    """Column form of :func:`resolve_window_minutes`; null means no bound."""
    minutes, hours = minutes.cast("long"), hours.cast("long")
    asked = F.coalesce(minutes, hours * 60)
    return (
        F.when(asked < 0, F.raise_error(F.lit("a window cannot be negative")).cast("long"))
        .when(asked == 0, F.lit(None).cast("long"))
        .otherwise(F.coalesce(asked, F.lit(schema.DEFAULT_WINDOW_MINUTES).cast("long")))
    )


def utc_moment(as_of: datetime | None = None) -> datetime:
    """A time in UTC without a zone: one with a zone is converted, one without is UTC, none means now."""
    if as_of is None:
        as_of = datetime.now(timezone.utc)
    return as_of if as_of.tzinfo is None else as_of.astimezone(timezone.utc).replace(tzinfo=None)


def since(events: DataFrame, as_of: datetime | None, minutes: int | None) -> Column:
    """Whether a row lies at or after ``as_of - minutes``; no upper bound, ``None`` takes all."""
    if minutes is None:
        return F.lit(True)
    start = utc_moment(as_of) - timedelta(minutes=minutes)
    return F.col("timestamp_utc") >= F.lit(start.isoformat(sep=" ")).cast(events.schema["timestamp_utc"].dataType)


def in_window(events: DataFrame, as_of: datetime | None, minutes: int | None) -> DataFrame:
    """Rows at or after ``as_of - minutes``; see :func:`since` and :func:`utc_moment`.

    Stored tables are partitioned by ``event_date``: the same bound on it prunes folders.
    """
    if minutes is None:
        return events
    as_of = utc_moment(as_of)
    kept = events.filter(since(events, as_of, minutes))
    if "event_date" in events.columns:
        kept = kept.filter(F.col("event_date") >= F.lit((as_of - timedelta(minutes=minutes)).date()))
    return kept


def state_rows(events: DataFrame) -> DataFrame:
    """Rows that decide health: hop rows carry INFO and never do."""
    return events.filter(F.col("result") != "INFO")


def incident_rows(events: DataFrame) -> DataFrame:
    """Everything but SUCCESS and INFO; SKIPPED and EMPTY are incidents."""
    return events.filter(~F.col("result").isin("SUCCESS", "INFO"))


def trace_hop_rows(events: DataFrame, hashed_only: bool = False) -> DataFrame:
    rows = events.filter((F.col("test_type") == "traceroute") & F.col("hop_index").isNotNull())
    return rows.filter(F.col("path_hash").isNotNull()) if hashed_only else rows


def search_targets(
    targets: DataFrame,
    kind: str = "all",
    agent: str = "all",
    site: str = "all",
    status: str = "all",
    text: str = "",
) -> DataFrame:
    """Targets matching every filter (``all`` = off) and a case-insensitive text."""
    for column, wanted in (("target_kind", kind), ("agent_id", agent), ("site_id", site)):
        if wanted != "all":
            targets = targets.filter(F.col(column) == wanted)
    if status != "all":
        targets = targets.filter(F.upper("latest_result") == status)
    needle = text.strip().lower()
    if needle:
        haystack = F.lower(
            F.concat_ws(" ", "fqdn", "target_address", "agent_id", "site_id", "target_id")
        )
        targets = targets.filter(F.contains(haystack, F.lit(needle)))
    return targets


def visible_tests(rows: DataFrame, kind: str = "target_kind") -> DataFrame:
    """Traceroute rows are shown for external targets only."""
    return rows.filter((F.col(kind) == "external") | (F.col("test_type") != "traceroute"))


def for_target(events: DataFrame, key: str) -> DataFrame:
    """Events of one target; none for a malformed key. Both predicates reach the scan."""
    agent, separator, target = key.partition("::")
    if not (separator and agent and target):
        return events.filter(F.lit(False))
    return events.filter((F.col("agent_id") == agent) & (F.col("target_id") == target))


def with_target_key(events: DataFrame) -> DataFrame:
    return events.withColumn("target_key", target_key())
