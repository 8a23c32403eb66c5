"""User-defined probes.

A probe is a function from a frame of targets to a frame of partial events. The frame it gets
has one row per (agent, target) the probe runs on; the frame it returns has ``agent_id`` and
``target_id`` and any event columns it wants to set. It may be plain DataFrame code, or use
``mapInPandas`` for Python logic; a Python probe that may fail per target reports the message
in a column ``probe_error`` (see :func:`python_probe`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope import schema
from linkscope.functions.events import blank_to_null, nan_to_null, negative_to_null, with_json_fields

Probe = Callable[[DataFrame], DataFrame]
DEFAULT_ENTRY_POINT = "probe"
NO_DETAILS = "Extension completed without additional details."
TARGET_COLUMNS = ("agent_id", "site_id", "target_id", "fqdn", "target_address", "captured_utc")


@dataclass(frozen=True)
class Extension:
    id: str
    probe: Probe
    targets: tuple[str, ...] = ()
    entry_point: str = DEFAULT_ENTRY_POINT


_REGISTRY: dict[str, Extension] = {}


def register_probe(
    id: str, probe: Probe, targets: Iterable[str] = (), entry_point: str = DEFAULT_ENTRY_POINT
) -> Extension:
    """Make a probe available by id; a target list restricts it to those targets."""
    if not id.strip():
        raise ValueError("an extension needs an id")
    _REGISTRY[id] = Extension(id, probe, tuple(targets), entry_point)
    return _REGISTRY[id]


def registered_probe(id: str) -> Extension:
    return _REGISTRY[id]


def python_probe(
    function: Callable[[dict], list[dict]], columns: T.StructType
) -> Probe:
    """A probe from a Python function of one target to its events, run in Arrow batches.

    ``columns`` are the event columns the function may set. An exception becomes the target's
    ``probe_error``; the other targets are not affected.
    """
    result = T.StructType(
        [T.StructField("agent_id", T.StringType()), T.StructField("target_id", T.StringType())]
        + [f for f in columns.fields if f.name not in ("agent_id", "target_id")]
        + [T.StructField("probe_error", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for target in batch.to_dict("records"):
                key = {"agent_id": target["agent_id"], "target_id": target["target_id"]}
                try:
                    rows += [{**event, **key} for event in function(target)]
                except Exception as error:  # reported as this target's event
                    rows.append({**key, "probe_error": str(error)})
            yield pd.DataFrame(rows, columns=result.names).astype(object).where(lambda f: f.notna(), None)

    return lambda targets: targets.mapInPandas(run, result)


def run_probe(targets: DataFrame, extension: Extension) -> DataFrame:
    """Events of one extension over all its targets.

    A target without any returned event gets an EMPTY event, a failed one a FATAL event.
    """
    if extension.targets:
        targets = targets.filter(F.col("target_id").isin(*extension.targets))
    targets = targets.select(*TARGET_COLUMNS)
    returned = extension.probe(targets).withColumn("returned", F.lit(True))
    return normalize_events(returned, targets, extension.id, extension.entry_point)


def normalize_events(
    returned: DataFrame, targets: DataFrame, extension_id: str, entry_point: str = DEFAULT_ENTRY_POINT
) -> DataFrame:
    """Complete partial events from their target and extension.

    Fields an event sets win. Metadata names the extension, unless the event's does.
    """
    base = targets.select(
        "agent_id", "target_id", *[F.col(c).alias(f"t_{c}") for c in TARGET_COLUMNS if c not in ("agent_id", "target_id")]
    )
    if "returned" not in returned.columns:
        returned = returned.withColumn("returned", F.lit(True))
    if "probe_error" not in returned.columns:
        returned = returned.withColumn("probe_error", F.lit(None).cast("string"))
    rows = base.join(returned, ["agent_id", "target_id"], "left")

    failed = F.col("probe_error").isNotNull()
    empty = F.col("returned").isNull()
    given = set(returned.columns)

    def field(name: str):
        return F.col(name) if name in given else F.lit(None)

    own = F.coalesce(field("metadata").cast("string"), F.lit("{}"))
    names_extension = F.try_variant_get(F.try_parse_json(own), "$.extensionId", "variant").isNotNull()
    defaults = {
        "timestamp_utc": F.col("t_captured_utc"),
        "site_id": F.col("t_site_id"),
        "fqdn": F.col("t_fqdn"),
        "target_address": F.col("t_target_address"),
        "test_type": F.lit(extension_id),
        "probe_name": F.lit(entry_point),
        "result": F.lit("INFO"),
        "details": F.lit(NO_DETAILS),
    }
    columns = {}
    for spec in schema.EVENT_SCHEMA:
        name = spec.name
        if name in ("agent_id", "target_id"):
            columns[name] = F.col(name)
            continue
        value = field(name).cast(spec.dataType)
        if name == "timestamp_utc":
            value = field(name)
            value = F.coalesce(value, F.col("t_captured_utc"))
        elif name in schema.OPTIONAL_TEXT:
            value = blank_to_null(value)
        elif name in schema.OPTIONAL_NUMBER:
            value = nan_to_null(value)
        elif name in schema.OPTIONAL_INTEGER:
            value = negative_to_null(value)
        elif name in defaults:
            value = F.coalesce(value, defaults[name])
        columns[name] = value
    columns["metadata"] = with_json_fields(
        own, {"extensionId": F.when(~names_extension, F.lit(extension_id))}
    )
    columns["result"] = F.when(failed, "FATAL").when(empty, "EMPTY").otherwise(columns["result"])
    columns["error_code"] = F.when(failed, "ExtensionProbeFailure").otherwise(columns["error_code"])
    columns["details"] = (
        F.when(failed, F.col("probe_error"))
        .when(empty, F.lit(f"Extension {extension_id} returned no events."))
        .otherwise(columns["details"])
    )
    return rows.select(*[columns[name].alias(name) for name in schema.EVENT_COLUMNS])
