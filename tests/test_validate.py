from __future__ import annotations

import json
from datetime import datetime

import pytest

from helpers import line, wire
from linkscope import schema
from linkscope.plans.importing import check_lines
from linkscope.sources import batches, validate


def check(spark, *texts):
    lines = spark.createDataFrame([(n, text) for n, text in enumerate(texts, 1)], "line_no long, value string")
    return {row.line_no: row for row in check_lines(lines).collect()}


GOOD = {
    "number as text": (dict(latencyMs=" 12.5 "), "latency_ms", 12.5),
    "exponent as text": (dict(loss="1e1"), "loss", 10.0),
    "integer as number": (dict(loss=3), "loss", 3.0),
    "integral float": (dict(hopIndex=1.0), "hop_index", 1),
    "integer as text": (dict(hopIndex="7"), "hop_index", 7),
    "integral text": (dict(hopIndex="7.0"), "hop_index", 7),
    "boolean as number": (dict(latencyMs=True), "latency_ms", 1.0),
    "null number": (dict(latencyMs=None), "latency_ms", None),
    "empty details": (dict(details=""), "details", ""),
    "offset": (dict(timestampUtc="2026-04-09T14:30:00+02:30"), "timestamp_utc", datetime(2026, 4, 9, 12)),
    "compact offset": (dict(timestampUtc="2026-04-09T14:30:00+0230"), "timestamp_utc", datetime(2026, 4, 9, 12)),
    "naive": (dict(timestampUtc="2026-04-09 12:00:00"), "timestamp_utc", datetime(2026, 4, 9, 12)),
    "seven digits": (
        dict(timestampUtc="2026-04-09T12:00:00.1234567Z"), "timestamp_utc", datetime(2026, 4, 9, 12, 0, 0, 123456)
    ),
    "date only": (dict(timestampUtc="2026-04-09"), "timestamp_utc", datetime(2026, 4, 9)),
    "lower case": (dict(timestampUtc="2026-04-09t12:00:00z"), "timestamp_utc", datetime(2026, 4, 9, 12)),
    "metadata": (dict(metadata={"a": [1, {"b": "]"}]}), "metadata", '{"a":[1,{"b":"]"}]}'),
    "unicode": (dict(details="é   ok"), "details", "é   ok"),
    "extra field": (dict(surplus=[1]), "agent_id", "branch-01"),
}


def test_accepted(spark):
    found = check(spark, *[line(**values) for values, _, _ in GOOD.values()])
    for n, (name, (_, column, want)) in enumerate(GOOD.items(), 1):
        assert found[n].error is None, (name, found[n].error)
        assert found[n][column] == want, name


BAD = {
    "fractional integer": (dict(hopIndex=1.5), "hopIndex: integer expected"),
    "large integer": (dict(hopIndex=3_000_000_000), "hopIndex: integer expected"),
    "word as number": (dict(latencyMs="fast"), "latencyMs: number expected"),
    "suffix": (dict(latencyMs="1d"), "latencyMs: number expected"),
    "list as number": (dict(loss=[1]), "loss: number expected"),
    "number as text": (dict(agentId=5), "agentId: text is required"),
    "blank": (dict(siteId=""), "siteId: text is required"),
    "null": (dict(fqdn=None), "fqdn: text is required"),
    "number in optional text": (dict(errorCode=4), "errorCode: text expected"),
    "unknown result": (dict(result="BROKEN"), "Unsupported result: BROKEN"),
    "lower-case result": (dict(result="success"), "Unsupported result: success"),
    "details missing": (dict(details=None), "details: text is required"),
    "metadata list": (dict(metadata=[]), "metadata: an object is required"),
    "metadata null": (dict(metadata=None), "metadata: an object is required"),
    "epoch": (dict(timestampUtc=1700000000), "timestampUtc: a date-time is required"),
    "no such day": (dict(timestampUtc="2026-02-31T00:00:00Z"), "timestampUtc: a date-time is required"),
    "year only": (dict(timestampUtc="2026"), "timestampUtc: a date-time is required"),
    "two": (dict(loss="x", hopIndex="y"), "loss: number expected; hopIndex: integer expected"),
}


def test_rejected(spark):
    found = check(spark, *[line(**values) for values, _ in BAD.values()])
    for n, (name, (_, message)) in enumerate(BAD.items(), 1):
        assert found[n].error == f"Event validation failed on line {n}: {message}", name


def test_not_one_document(spark):
    good = line()
    broken = [
        good[:-1],
        good + " x",
        good + good,
        good + "]",
        good + "] [" + good,
        good + "}",
        good + ',"k":1',
        good + ",",
        "nothing",
        "{'a': 1}",
    ]
    found = check(spark, *broken)
    assert {n: row.error for n, row in found.items()} == {
        n: f"Invalid JSON on line {n}" for n in range(1, len(broken) + 1)
    }


def test_documents_that_are_no_objects(spark):
    for row in check(spark, "12", "[1, 2]", '"text"', "null").values():
        assert row.error.startswith("Event validation failed on line")


def test_names(spark):
    snake = {column: wire()[name] for column, name in schema.WIRE_FIELDS}
    both = {**snake, "agentId": "camel"}
    null = {**snake, "agentId": None}
    found = check(spark, *map(json.dumps, (snake, both, null)))
    assert found[1].error is None and found[1].agent_id == "branch-01"
    assert found[2].agent_id == "camel"
    assert found[3].error.endswith("agentId: text is required")


def test_repeated_key_keeps_the_last_value(spark):
    found = check(spark, line().replace('"details": "ok"', '"details": "a", "details": "b"'))
    assert found[1].error is None and found[1].details == "b"


def test_lines_blanks_and_byte_order_mark(spark):
    text = "﻿" + line() + "\r\n\r\n  \t\n" + line(details="two") + "\r" + line(details="three") + "\n"
    content = spark.createDataFrame([("f", text)], "name string, content string")
    checked = check_lines(batches.split_lines(content)).collect()
    assert {(r.line_no, r.details) for r in checked} == {(1, "ok"), (4, "two"), (5, "three")}
    assert all(r.error is None for r in checked)


@pytest.mark.parametrize(
    ("body", "count", "error"),
    [
        ({"events": [wire(), wire()]}, 2, None),
        ({"events": []}, 0, validate.EMPTY_BATCH),
        ({"other": 1}, 0, validate.EMPTY_BATCH),
        ({"events": [wire(), wire(result="?")]}, 2, "Event validation failed on line 2: Unsupported result: ?"),
    ],
)
def test_envelopes(spark, body, count, error):
    bodies = spark.createDataFrame([("r", json.dumps(body))], "source_identifier string, body string")
    checked = validate.validate_events(validate.envelope_events(bodies))
    (verdict,) = validate.gate_batches(checked, bodies, ("source_identifier",)).collect()
    assert (verdict.event_count, verdict.error) == (count, error)
