"""Route state per target in the state store, and the path changes that follow from it.

State of a target is one map from path hash to the path's newest hops, and one from path hash to its sightings
(preview, last seen). A micro-batch reads and writes the entries of the paths it touches, and returns the
sightings of the targets that changed; nothing that was stored before is read again from files. State lives in
RocksDB on the executors and as changes in the checkpoint, so a lost executor's state is rebuilt elsewhere.

There is no watermark: a late hop takes its place by event time like any other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linkscope.functions.events import hop_label, target_key, target_kind
from linkscope.functions.filters import trace_hop_rows
from linkscope.operators import paths, state

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# What a hop row consists of besides its keys and the columns that order it.
HOP_VALUES = ("target_kind", "fqdn", "site_id", "hop_label")
SIGHTINGS = (
    "target_key string, target_id string, target_kind string, fqdn string, site_id string, agent_id string, "
    "path_hash string, path_preview string, timestamp_utc timestamp, hop_count bigint"
)
_SEEN = (
    "agent_id string, target_id string, path_hash string, target_kind string, fqdn string, site_id string, "
    "path_preview string, seen_us bigint, hop_count bigint"
)


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _rank(order: list) -> tuple:
    """Orders like a struct: a null comes before any value."""
    return tuple((value is not None, value) for value in order)


class Routes(StatefulProcessor):
    """Rows (agent_id, target_id, path_hash, hop_index, order columns, values) in, sightings out.

    A stored hop is ``[hop_index, [order], [values]]``; the first order column is the time in microseconds.
    """

    def __init__(self, order: list[str]) -> None:
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hops = handle.getMapState("hops", "path_hash string", "hops string")
        self.seen = handle.getMapState("seen", "path_hash string", "sightings string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        touched: dict[str, dict[int, list]] = {}
        for row in rows:
            hop = [row["hop_index"], [row[name] for name in self.order], [row[name] for name in HOP_VALUES]]
            _keep_newest(touched.setdefault(row["path_hash"], {}), hop)
        changed = False
        for path, new in touched.items():
            held = {}
            if self.hops.containsKey((path,)):
                held = {hop[0]: hop for hop in json.loads(self.hops.getValue((path,))[0])}
            # The list keeps every hop; any() alone would stop at the first.
            if any([_keep_newest(held, hop) for hop in new.values()]):
                changed = True
                self.hops.updateValue((path,), (json.dumps(list(held.values())),))
                self.seen.updateValue((path,), (json.dumps(sightings(list(held.values()))),))
        if changed:
            for (path,), (found,) in self.seen.iterator():
                for kind, fqdn, site, preview, seen_us, count in json.loads(found):
                    yield Row(
                        agent_id=key[0],
                        target_id=key[1],
                        path_hash=path,
                        target_kind=kind,
                        fqdn=fqdn,
                        site_id=site,
                        path_preview=preview,
                        seen_us=seen_us,
                        hop_count=count,
                    )

    def close(self) -> None:
        pass


def _keep_newest(held: dict[int, list], hop: list) -> bool:
    """Put the hop in its place unless a newer one is there; whether it was put."""
    before = held.get(hop[0])
    if before is not None and _rank(before[1]) >= _rank(hop[1]):
        return False
    held[hop[0]] = hop
    return True


def sightings(hops: list[list]) -> list[list]:
    """[target_kind, fqdn, site_id, preview, last seen in microseconds, hops] of one path's newest hops."""
    groups: dict[tuple, list] = {}
    for index, order, (*about, label) in sorted(hops, key=lambda hop: hop[0]):
        groups.setdefault(tuple(about), []).append((index, order[0], label))
    return [
        [*about, " -> ".join(label for _, _, label in found), max(seen for _, seen, _ in found), len(found)]
        for about, found in groups.items()
    ]


def _newest_in_batch(keys: list[str], order: list[str]):
    """Reduce each batch to the newest row per key, so that a busy target sends few rows to its task."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            places = pc.sort_indices(rows, [(name, "ascending") for name in order], null_placement="at_start")
            ordered = rows.take(places).append_column("place", pa.array(np.arange(len(rows))))
            last = ordered.group_by(keys).aggregate([("place", "max")])["place_max"]
            yield from ordered.drop_columns(["place"]).take(last).to_batches()

    return reduce


def sighting_stream(events: DataFrame, kind_mode: str = "metadata") -> DataFrame:
    """A stream of the sightings of every target whose routes changed (update mode)."""
    order = ["seen_us", *state.tie_columns(events)]
    rows = trace_hop_rows(events, hashed_only=True).select(
        *paths.HOP_KEYS,
        F.unix_micros(F.col("timestamp_utc").cast("timestamp")).alias("seen_us"),
        *order[1:],
        target_kind(mode=kind_mode).alias("target_kind"),
        "fqdn",
        "site_id",
        hop_label().alias("hop_label"),
    )
    reduced = rows.mapInArrow(_newest_in_batch(list(paths.HOP_KEYS), order), rows.schema)
    seen = reduced.groupBy("agent_id", "target_id").transformWithState(
        Routes(order), outputStructType=_SEEN, outputMode="Update", timeMode="None"
    )
    return seen.select(
        target_key().alias("target_key"),
        "target_id",
        "target_kind",
        "fqdn",
        "site_id",
        "agent_id",
        "path_hash",
        "path_preview",
        F.timestamp_micros("seen_us").cast(events.schema["timestamp_utc"].dataType).alias("timestamp_utc"),
        "hop_count",
    )
