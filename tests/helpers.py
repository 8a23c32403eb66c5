"""Rows and documents that several tests build."""

from __future__ import annotations

import json
import sys
from datetime import datetime, timedelta
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from linkscope import schema  # noqa: E402

NOON = datetime(2026, 4, 9, 12)

# The frames here have a few rows: interpreting an expression is faster than compiling it.
# The catalog test runs every registered query with the usual settings.
TINY_DATA = {
    "spark.sql.shuffle.partitions": "3",
    "spark.sql.codegen.wholeStage": "false",
    "spark.sql.codegen.factoryMode": "NO_CODEGEN",
}


def event(minutes: float = 0, **values) -> dict:
    """One event row; ``minutes`` after noon."""
    row = {name: None for name in schema.EVENT_COLUMNS}
    row.update(
        timestamp_utc=NOON + timedelta(minutes=minutes),
        agent_id="branch-01",
        site_id="site-a",
        target_id="fs01",
        fqdn="fs01.example.com",
        target_address="10.10.10.5",
        test_type="ping",
        probe_name="Ping.Primary",
        result="SUCCESS",
        details="",
        metadata="{}",
    )
    row.update(values)
    return row


def hop(minutes: float, path: str | None, index: int, address: str | None, **values) -> dict:
    return event(
        minutes,
        test_type="traceroute",
        probe_name="Traceroute.Path",
        result="INFO",
        hop_index=index,
        hop_address=address,
        path_hash=path,
        **values,
    )


def frame(spark, rows: list[dict]):
    """Events with a batch id and the row number as ``seq``."""
    from pyspark.sql import types as T

    fields = T.StructType(
        schema.EVENT_SCHEMA.fields
        + [T.StructField("batch_id", T.StringType()), T.StructField("seq", T.LongType())]
    )
    data = [
        tuple(row[name] for name in schema.EVENT_COLUMNS) + (row.get("batch_id", "b"), row.get("seq", n))
        for n, row in enumerate(rows)
    ]
    return spark.createDataFrame(data, fields)


def wire(**values) -> dict:
    """One event as a JSON document."""
    document = {
        "timestampUtc": "2026-04-09T12:00:00Z",
        "agentId": "branch-01",
        "siteId": "site-a",
        "targetId": "fs01",
        "fqdn": "fs01.example.com",
        "targetAddress": "10.10.10.5",
        "testType": "ping",
        "probeName": "Ping.Primary",
        "result": "SUCCESS",
        "latencyMs": 12.5,
        "loss": None,
        "errorCode": None,
        "details": "ok",
        "dnsServer": None,
        "hopIndex": None,
        "hopAddress": None,
        "hopName": None,
        "hopLatencyMs": None,
        "pathHash": None,
        "metadata": {},
    }
    document.update(values)
    return document


def line(**values) -> str:
    return json.dumps(wire(**values))
