from __future__ import annotations

import json

import pytest

from linkscope.operators import inventory
from linkscope.sources import configs


def target(id="loopback", **values):
    return {"id": id, "fqdn": "localhost", "address": "127.0.0.1", "tests": ["ping"], **values}


def load(spark, *documents):
    rows = [(f"c{n}", json.dumps(d) if isinstance(d, dict) else d) for n, d in enumerate(documents)]
    return configs.with_defaults(
        configs.parse_configs(spark.createDataFrame(rows, "config_id string, document string"))
    )


def messages(spark, **document):
    document.setdefault("targets", [target()])
    rows = inventory.violations(load(spark, document)).orderBy("place").collect()
    return [row.message for row in rows]


def test_defaults(spark):
    config = load(spark, {"targets": [target()], "tests": {"pingTimeoutMs": 5}, "agent": {"agentId": "x"}}).first().config
    assert (config.schemaVersion, config.agent.agentId, config.agent.siteId) == ("1.0", "x", "default-site")
    assert (config.tests.pingTimeoutMs, config.tests.pingPacketSize) == (5, 56)
    assert config.tests.enabled == ["ping", "dns", "share", "internetQuality", "traceroute"]
    assert (config.publish.azure.blobPrefix, config.publish.csvMirror) == ("events", False)
    assert config.internetTargets == config.extensions == config.auth.linuxProfiles == []


def test_settings_of_another_type(spark):
    """Read as a collector reads them; what is no number gets its default and breaks a rule."""
    document = {
        "agent": {"cycleIntervalSeconds": "90", "maxRuntimeMinutes": 2.5, "configPollIntervalSeconds": None},
        "tests": {"pingTimeoutMs": "oops", "pingPacketSize": [1], "internetQualitySampleCount": 3e10},
        "publish": {"csvMirror": "false", "azure": {"enabled": 0}},
        "extensions": [{"id": "e", "path": "p", "enabled": ""}, {"id": "f", "path": "p", "enabled": "no"}],
    }
    loaded = load(spark, document)
    config = loaded.first().config
    assert (config.agent.cycleIntervalSeconds, config.agent.maxRuntimeMinutes) == (90, 2)
    assert (config.agent.configPollIntervalSeconds, config.tests.pingTimeoutMs, config.tests.pingPacketSize) == (60, 3000, 56)
    assert (config.publish.csvMirror, config.publish.azure.enabled) == (True, False)
    assert [row.enabled for row in inventory.extensions(loaded).orderBy("position").collect()] == [False, True]
    assert messages(spark, **document) == [
        "Setting tests.pingTimeoutMs is no whole number: oops",
        "Setting tests.pingPacketSize is no whole number: [1]",
        "Setting tests.internetQualitySampleCount is no whole number: 30000000000",
    ]


@pytest.mark.parametrize("job", [inventory.violations, inventory.probe_plan, inventory.all_targets, inventory.shares])
def test_one_scan_and_no_shuffle(spark, tmp_path, job):
    load(spark, {"targets": [target()]}).write.parquet(str(tmp_path / "c"))
    plan = job(spark.read.parquet(str(tmp_path / "c")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_valid_document(spark):
    assert messages(spark) == []
    assert inventory.valid_configs(load(spark, {"targets": [target()]}, {})).count() == 1


def test_documents_in_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"targets": [target()]}, indent=1))
    (tmp_path / "b.json").write_text("{}")
    (tmp_path / "c.yaml").write_text("x: 1")
    read = configs.parse_configs(configs.read_configs(spark, str(tmp_path)))
    assert sorted(r.config_id.rsplit("/", 1)[1] for r in read.collect()) == ["a.json", "b.json"]


def test_target_defaults(spark):
    (row,) = inventory.targets(
        load(spark, {"tests": {"enabled": "ping"}, "targets": [target(tests=[], tags="one", dnsServers=["1.1.1.1"])]})
    ).collect()
    assert (row.tests, row.tags, row.dns_servers, row.roles) == (["ping"], ["one"], ["1.1.1.1"], [])
    assert (row.target_kind, row.external_trace_target, row.linux_profile_id) == ("internal", "127.0.0.1", "")


def test_internet_targets(spark):
    rows = inventory.internet_targets(
        load(
            spark,
            {
                "internetTargets": [
                    {"id": "a", "name": "Resolver", "address": "8.8.8.8"},
                    {"id": "b", "name": " ", "address": "9.9.9.9", "tests": [], "roles": "edge"},
                ]
            },
        )
    ).orderBy("position").collect()
    assert [(r.fqdn, r.tests, r.roles, r.tags, r.target_kind) for r in rows] == [
        ("Resolver", ["internetQuality", "traceroute"], ["internet"], ["external"], "external"),
        ("9.9.9.9", [], ["edge"], ["external"], "external"),
    ]


def promoted(spark, *targets):
    loaded = load(spark, {"targets": list(targets)})
    moved = [(r.target_id, r.target_address, r.tests) for r in inventory.promoted_targets(loaded).orderBy("position").collect()]
    kept = [(r.target_id, r.tests) for r in inventory.targets(loaded).orderBy("position").collect()]
    return moved, kept


@pytest.mark.parametrize(
    ("targets", "moved", "kept"),
    [
        ([target()], [], [("loopback", ["ping"])]),
        (
            [target(tests=["ping", "traceroute"], externalTraceTarget="8.8.8.8")],
            [("loopback-internet", "8.8.8.8", ["traceroute"])],
            [("loopback", ["ping"])],
        ),
        (
            [target(externalTraceTarget="8.8.8.8")],
            [("loopback-internet", "8.8.8.8", ["internetQuality", "traceroute"])],
            [("loopback", ["ping"])],
        ),
        ([target(externalTraceTarget=" ")], [], [("loopback", ["ping"])]),
        ([target(externalTraceTarget="127.0.0.1")], [], [("loopback", ["ping"])]),
        (
            [target("a-internet"), target("a-internet-2"), target("a", tests=["Traceroute"])],
            [("a-internet-3", "127.0.0.1", ["Traceroute"])],
            [("a-internet", ["ping"]), ("a-internet-2", ["ping"]), ("a", [])],
        ),
        (
            [target("a", tests=["traceroute"]), target("a-internet")],
            [("a-internet", "127.0.0.1", ["traceroute"])],
            [("a", []), ("a-internet", ["ping"])],
        ),
    ],
)
def test_promotion(spark, targets, moved, kept):
    assert promoted(spark, *targets) == (moved, kept)


@pytest.mark.parametrize(
    ("document", "wanted"),
    [
        ({"schemaVersion": "2.0"}, ["Only schemaVersion 1.0 is supported."]),
        ({"agent": {"agentId": " ", "siteId": ""}}, ["agent.agentId is required.", "agent.siteId is required."]),
        ({"targets": []}, ["At least one target or internetTarget is required."]),
        ({"targets": [target(), target()]}, ["Duplicate target id: loopback"]),
        ({"targets": [target(id="")]}, ["Each target requires an id."]),
        ({"targets": [target(fqdn="", address=None)]}, ["Target loopback requires fqdn.", "Target loopback requires address."]),
        ({"targets": [target(linuxProfileId="x")]}, ["Target loopback references an unknown linuxProfileId: x"]),
        (
            {"targets": [target(shares=[{"id": "", "path": "p"}, {"id": "s", "path": ""}, {"id": "u", "path": "p", "linuxProfileId": "x"}])]},
            [
                "Each share for target loopback requires an id.",
                "Share s for target loopback requires path.",
                "Share u for target loopback references an unknown linuxProfileId: x",
            ],
        ),
        (
            {"internetTargets": [{"id": "loopback", "address": "1.1.1.1"}, {"id": "", "address": ""}]},
            [
                "Duplicate target or internetTarget id: loopback",
                "Each internetTarget requires an id.",
                "Internet target  requires address.",
            ],
        ),
        (
            {"auth": {"linuxProfiles": [{"id": "a", "mode": "kerberosKeytab"}]}},
            ["Linux auth profile a requires a secretReference."],
        ),
        (
            {"auth": {"linuxProfiles": [{"id": "a", "mode": "wrong"}, {"id": "b"}]}},
            ["Linux auth profile a uses an unsupported mode.", "Linux auth profile b requires mode."],
        ),
        (
            {"auth": {"linuxProfiles": [{"id": "a", "mode": "currentContext", "secretReference": "s.json"}]}},
            ["Linux auth profile a uses currentContext and must not define a secretReference."],
        ),
        (
            {"publish": {"azure": {"enabled": True}}},
            [
                "publish.azure.accountName is required when Azure publishing is enabled.",
                "publish.azure.containerName is required when Azure publishing is enabled.",
            ],
        ),
        (
            {"extensions": [{"id": "e", "path": "p"}, {"id": "e", "path": "", "scriptBlock": "{}"}]},
            [
                "Extensions must reference trusted local script files. Inline script content is not supported.",
                "Duplicate extension id: e",
                "Extension e requires a path.",
            ],
        ),
    ],
)
def test_rules(spark, document, wanted):
    assert messages(spark, **document) == wanted


def test_first_violation(spark):
    broken = inventory.violations(load(spark, {"schemaVersion": "2", "targets": [target(), target()]}))
    (row,) = inventory.first_violations(broken).collect()
    assert (row.first_violation, row.violation_count) == ("Only schemaVersion 1.0 is supported.", 2)


def test_probe_plan(spark):
    loaded = load(
        spark,
        {
            "targets": [target("a", tests=["PING", "custom", "none"]), target("b", tests=["Custom", "off"])],
            "extensions": [
                {"id": "custom", "path": "p", "targets": ["A"], "entryPoint": "go"},
                {"id": "custom", "path": "q"},
                {"id": "off", "path": "p", "enabled": False},
            ],
        },
    )
    found = {(r.target_id, r.test): (r.handling, r.error_code, r.probe_name) for r in inventory.probe_plan(loaded).collect()}
    assert found == {
        ("a", "PING"): ("built-in", None, None),
        ("a", "custom"): ("extension", None, "go"),
        ("a", "none"): ("skipped", "UnsupportedProbe", "Probe.Unknown"),
        ("b", "Custom"): ("skipped", "ExtensionTargetExcluded", "go"),
        ("b", "off"): ("skipped", "UnsupportedProbe", "Probe.Unknown"),
    }
