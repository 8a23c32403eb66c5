"""Traceroute paths and path changes.

Hop rows are reduced to the newest row per (target, path, hop) before anything else.
What is left is one row per hop that was ever seen, so the later grouping and windows
work on routes and not on events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkscope import schema
from linkscope.functions.events import hop_label, path_change, path_hash_or_unknown, preview_hops, shared_prefix
from linkscope.functions.events import target_key, target_kind
from linkscope.functions.filters import trace_hop_rows
from linkscope.operators import state

HOP_KEYS = ("agent_id", "target_id", "path_hash", "hop_index")
PREVIEW = "listagg(hop_label, ' -> ') WITHIN GROUP (ORDER BY hop_index)"


def latest_hops(events: DataFrame) -> DataFrame:
    """Newest row per hop of each path; a null path hash is a path of its own.

    The ordering columns stay, so that the result can be reduced again.
    """
    ties = state.tie_columns(events)
    carry = (
        "fqdn",
        "site_id",
        "hop_name",
        "hop_address",
        "hop_latency_ms",
        "metadata",
        "timestamp_utc",
        *ties,
    )
    return state.latest_by(trace_hop_rows(events), HOP_KEYS, carry)


def known_hops(hops: DataFrame) -> DataFrame:
    """Latest hops with unhashed paths merged into ``unknown``."""
    merged = hops.withColumn("path_hash", path_hash_or_unknown())
    carry = [c for c in hops.columns if c not in HOP_KEYS]
    return state.latest_by(merged, HOP_KEYS, carry)


def ordered_concat(rows: DataFrame, keys: Sequence[str], label: str, order: str, name: str) -> DataFrame:
    """Labels of each group joined by `` -> `` in order."""
    text = F.expr(f"listagg({label}, ' -> ') WITHIN GROUP (ORDER BY {order})")
    return rows.groupBy(*keys).agg(text.alias(name))


def _labelled(hops: DataFrame, kind_mode: str) -> DataFrame:
    return hops.withColumns(
        {
            "target_key": target_key(),
            "target_kind": target_kind(mode=kind_mode),
            "hop_label": hop_label(),
        }
    )


def paths_from_hops(hops: DataFrame, kind_mode: str = "metadata") -> DataFrame:
    return (
        _labelled(known_hops(hops), kind_mode)
        .groupBy("target_key", "target_id", "target_kind", "agent_id", "fqdn", "path_hash")
        .agg(
            F.expr(PREVIEW).alias("path_preview"),
            F.max("timestamp_utc").alias("last_seen_utc"),
            F.count(F.lit(1)).alias("hop_count"),
            F.avg("hop_latency_ms").alias("average_hop_latency_ms"),
        )
    )


def paths(events: DataFrame, kind_mode: str = "metadata") -> DataFrame:
    """Every path seen per target with its newest hops, ordered for display."""
    return paths_from_hops(latest_hops(events), kind_mode).orderBy(
        "target_kind", "fqdn", "agent_id", F.desc("last_seen_utc"), "path_hash"
    )


def path_sightings(hops: DataFrame, kind_mode: str = "metadata") -> DataFrame:
    """One row per hashed path: its preview and when it was last seen."""
    return (
        _labelled(hops.filter(F.col("path_hash").isNotNull()), kind_mode)
        .groupBy("target_key", "target_id", "target_kind", "fqdn", "site_id", "agent_id", "path_hash")
        .agg(
            F.expr(PREVIEW).alias("path_preview"),
            F.max("timestamp_utc").alias("timestamp_utc"),
            F.count(F.lit(1)).alias("hop_count"),
        )
    )


def lag_path(sightings: DataFrame) -> DataFrame:
    """Each path with the one seen before it on the same target (null for the first)."""
    by_time = Window.partitionBy("target_key").orderBy(
        "timestamp_utc", "path_hash", "fqdn", "site_id", "target_kind"
    )
    return sightings.withColumns(
        {
            "previous_path_hash": F.lag("path_hash").over(by_time),
            "previous_path_preview": F.lag("path_preview").over(by_time),
        }
    )


def changes_from_sightings(sightings: DataFrame) -> DataFrame:
    """Transitions between the paths of each target, unordered."""
    return (
        lag_path(sightings)
        .filter(F.col("previous_path_hash") != F.col("path_hash"))
        .select(
            "target_key",
            "target_id",
            "target_kind",
            "fqdn",
            "site_id",
            "agent_id",
            "previous_path_hash",
            "previous_path_preview",
            "path_hash",
            "path_preview",
            "hop_count",
            "timestamp_utc",
        )
    )


def changes_from_hops(hops: DataFrame, kind_mode: str = "metadata") -> DataFrame:
    """All path transitions, unordered."""
    return changes_from_sightings(path_sightings(hops, kind_mode))


def newest_changes(changes: DataFrame, limit: int) -> DataFrame:
    return changes.orderBy(
        F.desc("timestamp_utc"), "target_key", "path_hash", "fqdn", "site_id", "target_kind"
    ).limit(limit)


def path_changes(
    events: DataFrame, limit: int = schema.PATH_CHANGE_LIMIT, kind_mode: str = "metadata"
) -> DataFrame:
    """Newest path transitions.

    A path counts once, at the time it was last seen: a route that goes A, B, A shows only
    the change from B back to A. Hops without a path hash do not take part.
    """
    return newest_changes(changes_from_hops(latest_hops(events), kind_mode), limit)


def visible_changes(
    changes: DataFrame,
    visible_targets: DataFrame,
    selected_key: str | None = None,
    limit: int = schema.VISIBLE_CHANGE_LIMIT,
) -> DataFrame:
    """Changes of external targets that pass the current filters, and how each route moved."""
    shown = changes.filter(F.col("target_kind") == "external")
    if selected_key:
        shown = shown.filter(F.col("target_key") == selected_key)
    shown = shown.join(visible_targets.select("target_key"), "target_key", "left_semi")
    return with_path_diff(newest_changes(shown, limit))


def with_path_diff(changes: DataFrame) -> DataFrame:
    """Add how a route moved: ``change``, the hops both routes begin with, and the hops there are now."""
    previous = preview_hops("previous_path_preview", "previous_path_hash")
    current = preview_hops("path_preview", "path_hash")
    return changes.withColumns(
        {
            "change": path_change(previous, current),
            "shared_hops": shared_prefix(previous, current),
            "current_hops": F.size(current),
        }
    )
