"""Column functions over event rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


# -- keys --------------------------------------------------------------------


def target_key(agent_id: ColumnOrName = "agent_id", target_id: ColumnOrName = "target_id") -> Column:
    """``agent::target``: target ids are unique only within one agent."""
    return F.concat_ws("::", _c(agent_id), _c(target_id))


def split_target_key(key: ColumnOrName) -> tuple[Column, Column]:
    """Agent and target id of a key, cut at the first ``::``; both null if malformed."""
    key = _c(key)
    at = F.locate("::", key)
    agent = F.substring_index(key, "::", 1)
    target = F.substring(key, at + F.lit(2), F.length(key))
    valid = (at > 1) & (F.length(target) > 0)
    return F.when(valid, agent), F.when(valid, target)


def target_kind(
    metadata: ColumnOrName = "metadata", target_id: ColumnOrName = "target_id", mode: str = "metadata"
) -> Column:
    """``external`` or ``internal`` (or whatever kind the metadata names).

    ``mode="metadata"`` honours ``metadata.targetKind`` and falls back to the id prefix;
    ``mode="prefix"`` looks at the id prefix only.
    """
    by_prefix = F.when(F.startswith(_c(target_id), F.lit("internet-")), F.lit("external")).otherwise(
        F.lit("internal")
    )
    if mode == "prefix":
        return by_prefix
    if mode != "metadata":
        raise ValueError(f"unknown target kind mode: {mode}")
    return F.coalesce(F.get_json_object(_c(metadata), "$.targetKind"), by_prefix)


# -- hops --------------------------------------------------------------------


def hop_label(hop_name: ColumnOrName = "hop_name", hop_address: ColumnOrName = "hop_address") -> Column:
    return F.coalesce(_c(hop_name), _c(hop_address), F.lit("*"))


def path_hash_or_unknown(path_hash: ColumnOrName = "path_hash") -> Column:
    return F.coalesce(_c(path_hash), F.lit("unknown"))


# -- metadata ----------------------------------------------------------------


def is_object(variant: Column) -> Column:
    """True for a variant holding a JSON object, false otherwise (also for null)."""
    return F.coalesce(F.startswith(F.schema_of_variant(variant), F.lit("OBJECT")), F.lit(False))


def unwrap_metadata(metadata: ColumnOrName = "metadata") -> Column:
    """Metadata as the JSON text of an object, without an outer ``{"metadata": {...}}``."""
    value = F.try_parse_json(_c(metadata))
    inner = F.try_variant_get(value, "$.metadata", "variant")
    return F.coalesce(
        F.when(is_object(inner), F.to_json(inner)),
        F.when(is_object(value), F.to_json(value)),
        F.lit("{}"),
    )


def with_json_fields(document: ColumnOrName, fields: dict[str, Column]) -> Column:
    """Add fields to the JSON text of an object; a null value adds nothing.

    Text that is no JSON object counts as an empty one. The caller makes sure that the object does not hold
    the names yet.
    """
    value = F.try_parse_json(_c(document))
    compact = F.when(is_object(value), F.to_json(value)).otherwise(F.lit("{}"))
    added = F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))
    return (
        F.when(added == "{}", compact)
        .when(compact == "{}", added)
        .otherwise(
            F.concat(
                F.substring(compact, F.lit(1), F.length(compact) - 1),
                F.lit(","),
                F.substring(added, F.lit(2), F.length(added)),
            )
        )
    )


# -- time --------------------------------------------------------------------


def utc_timestamp(text: ColumnOrName) -> Column:
    """An ISO date-time as an instant; text without an offset is UTC.

    The session time zone must be UTC. Fractions beyond microseconds are cut off.
    """
    return F.upper(F.trim(_c(text))).try_cast("timestamp")


# -- producer record ---------------------------------------------------------


def blank_to_null(text: ColumnOrName) -> Column:
    text = _c(text)
    return F.when(F.regexp_like(text, F.lit(r"\S")), text)


def nan_to_null(number: ColumnOrName) -> Column:
    number = _c(number)
    return F.when(~F.isnan(number), number)


def negative_to_null(number: ColumnOrName) -> Column:
    number = _c(number)
    return F.when(number >= 0, number)


# -- display classes ---------------------------------------------------------


def status_class(result: ColumnOrName) -> Column:
    upper = F.upper(_c(result))
    return (
        F.when(upper == "SUCCESS", "success")
        .when(upper.isin("FAILURE", "FATAL"), "failure")
        .when(upper == "TIMEOUT", "timeout")
        .when(upper.isin("SKIPPED", "EMPTY"), "skipped")
        .when(upper == "INFO", "info")
        .otherwise("unknown")
    )


def age_seconds(timestamp: ColumnOrName, as_of: ColumnOrName) -> Column:
    """Whole seconds from ``timestamp`` to ``as_of``, never negative."""
    micros = F.unix_micros(_c(as_of).cast("timestamp")) - F.unix_micros(_c(timestamp).cast("timestamp"))
    return F.greatest(F.floor(micros / 1_000_000), F.lit(0)).cast("long")


def freshness(timestamp: ColumnOrName, as_of: ColumnOrName) -> Column:
    """Age label in the largest whole unit, such as ``5m ago``."""
    seconds = age_seconds(timestamp, as_of)

    def label(unit_seconds: int, suffix: str) -> Column:
        return F.concat(F.floor(seconds / unit_seconds).cast("string"), F.lit(f"{suffix} ago"))

    return (
        F.when(_c(timestamp).isNull(), F.lit("No data"))
        .when(seconds < 60, label(1, "s"))
        .when(seconds < 3_600, label(60, "m"))
        .when(seconds < 86_400, label(3_600, "h"))
        .otherwise(label(86_400, "d"))
    )


def agent_badge(failing_targets: ColumnOrName) -> Column:
    """Timeouts alone leave an agent at SUCCESS."""
    return F.when(_c(failing_targets) > 0, F.lit("FAILURE")).otherwise(F.lit("SUCCESS"))


def source_badge(last_error: ColumnOrName) -> Column:
    return F.when(F.length(_c(last_error)) > 0, F.lit("FAILURE")).otherwise(F.lit("SUCCESS"))


# -- path difference ---------------------------------------------------------


def preview_hops(preview: ColumnOrName, fallback: ColumnOrName) -> Column:
    """Hop labels of a ``a -> b -> c`` preview; an empty preview falls back to the hash."""
    preview = _c(preview)
    text = F.when(F.length(preview) > 0, preview).otherwise(F.coalesce(_c(fallback), F.lit("")))
    parts = F.transform(F.split(text, "->"), lambda part: F.regexp_replace(part, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda part: F.length(part) > 0)


def shared_prefix(left: Column, right: Column) -> Column:
    """Number of leading hops two hop arrays have in common."""
    same = F.transform(left, lambda hop, i: F.coalesce(hop == F.get(right, i), F.lit(False)))
    first_difference = F.array_position(same, F.lit(False))
    return F.when(first_difference > 0, first_difference - 1).otherwise(F.size(left)).cast("int")


def path_change(previous: Column, current: Column) -> Column:
    """Where a route turns, from two arrays of hop labels: ``unknown`` without hops on one side, ``start`` at
    the first hop, ``length`` if one continues the other, else ``branch``."""
    shared = shared_prefix(previous, current)
    shorter = F.least(F.size(previous), F.size(current))
    return (
        F.when(shorter == 0, F.lit("unknown"))
        .when(shared == 0, F.lit("start"))
        .when(shared >= shorter, F.lit("length"))
        .otherwise(F.lit("branch"))
    )
