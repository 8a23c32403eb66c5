from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import types as T

from helpers import NOON, event, frame
from linkscope import schema
from linkscope.operators import extensions, inventory, probes

RUN = "run_id long, agent_id string, site_id string, target_id string, fqdn string, target_address string, captured_utc timestamp"


def runs(spark, columns: str, *rows):
    data = [(n, "branch-01", "site-a", "t", "t.example.com", "1.1.1.1", NOON, *row) for n, row in enumerate(rows)]
    return spark.createDataFrame(data, f"{RUN}, {columns}")


def output(spark, *texts):
    data = [(run, n, line) for run, text in enumerate(texts) for n, line in enumerate(text.split("\n")) if text]
    return spark.createDataFrame(data, "run_id long, line_no int, line string")


TRACE = "tool_missing boolean, error_text string, timed_out boolean"


def test_windows_style_trace(spark):
    lines = output(
        spark,
        "Tracing route\n\n  1     1 ms     1 ms     1 ms  10.0.100.1 \n  2    18 ms    12 ms    20 ms  100.93.238.194\n\nTrace complete.",
    )
    events = probes.trace_events(runs(spark, TRACE, (False, None, False)), lines).collect()
    hops = sorted((e for e in events if e.result == "INFO"), key=lambda e: e.hop_index)
    assert [(h.hop_index, h.hop_address, h.hop_name, h.hop_latency_ms) for h in hops] == [
        (1, "10.0.100.1", None, 1.0),
        (2, "100.93.238.194", None, 18.0),
    ]
    digest = hashlib.sha256(b"1:10.0.100.1|2:100.93.238.194").hexdigest()[:16]
    assert {e.path_hash for e in events} == {digest}
    (summary,) = [e for e in events if e.result == "SUCCESS"]
    assert (summary.probe_name, summary.details) == ("Traceroute.Summary", "Traceroute completed with 2 hops.")
    assert summary.metadata == '{"role":"summary","hopCount":2}'
    assert set(schema.EVENT_COLUMNS) <= set(events[0].asDict())


def test_hop_fields(spark):
    lines = output(
        spark,
        "1  gw.example.net (10.0.0.1)  <1 ms\n2  * * *\n3  10.0.0.3  7.25 MS\n4  12.5 ms 10.0.0.4\n"
        "5  host-a 3 ms\nno hop\n6 x",
    )
    hops = {h.hop_index: (h.hop_address, h.hop_name, h.hop_latency_ms) for h in probes.trace_hops(lines).collect()}
    assert hops == {
        1: ("10.0.0.1", "gw.example.net", 1.0),
        2: (None, None, None),
        3: ("10.0.0.3", None, 7.25),
        4: ("10.0.0.4", None, 12.5),
        5: (None, "host-a", 3.0),
        6: (None, None, None),
    }


def test_trace_failures(spark):
    rows = runs(spark, TRACE, (False, None, False), (True, None, False), (False, None, True), (False, "boom", False))
    events = probes.trace_events(rows, output(spark, "", "", "1 10.0.0.1 1 ms", "")).collect()
    assert {(e.run_id, e.result, e.error_code) for e in events} == {
        (0, "FAILURE", "NoPathData"),
        (1, "SKIPPED", "TracerouteMissing"),
        (2, "TIMEOUT", "TracerouteTimeout"),
        (3, "FATAL", "TracerouteFailure"),
    }
    assert all(e.path_hash is None and e.metadata == "{}" for e in events)


def test_ping(spark):
    rows = runs(spark, "exit_code int, error_text string", (0, None), (0, None), (1, None), (None, "boom"))
    lines = output(spark, "PING\nx time=1.5 ms\nlast", "PING\nlast", "\nunreachable \n")
    found = {e.run_id: (e.result, e.latency_ms, e.details) for e in probes.ping_events(rows, lines).collect()}
    assert found == {
        0: ("SUCCESS", 1.5, "last"),
        1: ("SUCCESS", 0.0, "last"),
        2: ("FAILURE", None, "unreachable"),
        3: ("FATAL", None, "boom"),
    }


@pytest.mark.parametrize(
    ("samples", "latency", "loss", "details"),
    [
        ([1.0, 2.0, None, None], 1.5, 50.0, "Average latency 1.50 ms across 2/4 successful samples."),
        ([2.125], 2.125, 0.0, "Average latency 2.13 ms across 1/1 successful samples."),
        ([2.375], 2.375, 0.0, "Average latency 2.38 ms across 1/1 successful samples."),
        ([1234.5], 1234.5, 0.0, "Average latency 1,234.50 ms across 1/1 successful samples."),
        ([None, None], None, 100.0, "Every sample failed."),
    ],
)
def test_quality(spark, samples, latency, loss, details):
    data = spark.createDataFrame([(1, s) for s in samples], "run_id int, latency_ms double")
    row = probes.internet_quality(data).first()
    assert (row.latency_ms, row.loss, row.details) == (latency, loss, details)
    assert row.result == ("FAILURE" if latency is None else "SUCCESS")


def test_dns(spark):
    tools = [("dig", "ns", None)] * 3 + [("nslookup", "ns", None)] * 2 + [("dig", "ns", "boom")]
    lines = output(
        spark, "alias.\n 10.0.0.1 \n10.0.0.2", "", "; timed out\n\n; bye", "Address:  9.9.9.9\nAddress: 10.0.0.7", "none", "10.0.0.1"
    )
    found = {e.run_id: (e.result, e.error_code, e.details) for e in probes.dns_events(
        runs(spark, "tool string, dns_server string, error_text string", *tools), lines
    ).collect()}
    assert found == {
        0: ("SUCCESS", None, "Resolved to 10.0.0.1"),
        1: ("FAILURE", "NoAddress", "DNS query returned no address."),
        2: ("FAILURE", "NoAddress", "; timed out\n; bye"),
        3: ("SUCCESS", None, "Resolved to 10.0.0.7"),
        4: ("FATAL", "DnsQueryFailure", "Cannot index into a null array."),
        5: ("FATAL", "DnsQueryFailure", "boom"),
    }


def test_tags(spark):
    events = spark.createDataFrame(
        [("a", "in", "{}"), ("a", "out", '{"x":1}'), ("a", "new", "{}"), ("a", "out", '{"targetKind":"internal"}')],
        "agent_id string, target_id string, metadata string",
    )
    kinds = spark.createDataFrame([("a", "in", "internal"), ("a", "out", "external")], "agent_id string, target_id string, target_kind string")
    found = sorted((r.target_id, r.metadata) for r in probes.tag_events(events, kinds).collect())
    assert found == [
        ("in", '{"targetKind":"internal"}'),
        ("new", '{"targetKind":"internal"}'),
        ("out", '{"targetKind":"internal"}'),
        ("out", '{"x":1,"targetKind":"external","targetClass":"internet"}'),
    ]


def test_auth_profile_choice(spark):
    requests = spark.createDataFrame(
        [("a", "s", "t"), ("a", " ", "t"), ("a", None, None), ("a", "zz", "t"), ("b", "s", "")],
        "agent_id string, share_profile_id string, target_profile_id string",
    )
    profiles = spark.createDataFrame(
        [("a", "s", "kerberosKeytab", 0), ("a", "t", "usernamePassword", 1)],
        "agent_id string, profile_id string, mode string, position int",
    )
    found = {
        (r.agent_id, r.profile_id, r.profile_mode, r.profile_error)
        for r in inventory.join_auth_profile(requests, profiles).collect()
    }
    assert found == {
        ("a", "s", "kerberosKeytab", None),
        ("a", "t", "usernamePassword", None),
        ("a", "", "currentContext", None),
        ("a", "zz", None, "LinuxProfileNotFound"),
        ("b", "s", None, "LinuxProfileNotFound"),
    }


def test_python_probe(spark):
    targets = spark.createDataFrame(
        [("a", "s", name, f"{name}.net", "1.1.1.1", NOON) for name in ("none", "bad", "two", "other")],
        "agent_id string, site_id string, target_id string, fqdn string, target_address string, captured_utc timestamp",
    )

    def probe(target):
        if target["target_id"] == "bad":
            raise RuntimeError("no luck")
        return [{"result": "SUCCESS", "latency_ms": 1.0}, {}] if target["target_id"] == "two" else []

    columns = T.StructType([T.StructField("result", T.StringType()), T.StructField("latency_ms", T.DoubleType())])
    extension = extensions.register_probe("custom", extensions.python_probe(probe, columns), ["none", "bad", "two"], "go")
    assert extensions.registered_probe("custom") is extension
    events = extensions.run_probe(targets, extension).collect()
    found = sorted((e.target_id, e.result, e.error_code or "", e.details, e.latency_ms or 0.0) for e in events)
    assert found == [
        ("bad", "FATAL", "ExtensionProbeFailure", "no luck", 0.0),
        ("none", "EMPTY", "", "Extension custom returned no events.", 0.0),
        ("two", "INFO", "", extensions.NO_DETAILS, 0.0),
        ("two", "SUCCESS", "", extensions.NO_DETAILS, 1.0),
    ]
    assert {(e.site_id, e.test_type, e.probe_name, e.metadata, e.timestamp_utc) for e in events} == {
        ("s", "custom", "go", '{"extensionId":"custom"}', NOON)
    }


def test_tags_with_odd_inventory_and_metadata(spark):
    """A target listed twice repeats no event; metadata that is no object counts as empty."""
    rows = [event(n, metadata=text) for n, text in enumerate(['{"a":1}', None, "[1]", "{broken"])]
    inventory = spark.createDataFrame(
        [("branch-01", "fs01", "internal"), ("branch-01", "fs01", "external")],
        "agent_id string, target_id string, target_kind string",
    )
    tagged = probes.tag_events(frame(spark, rows), inventory).orderBy("timestamp_utc").collect()
    added = '"targetKind":"external","targetClass":"internet"}'
    assert [row.metadata for row in tagged] == ['{"a":1,' + added, "{" + added, "{" + added, "{" + added]
