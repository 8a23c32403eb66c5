from __future__ import annotations

import random
from datetime import timedelta

from helpers import NOON, event, frame, hop
from linkscope import schema
from linkscope.functions import filters
from linkscope.operators import board, state


def rows(df):
    return [row.asDict() for row in df.collect()]


def test_one_ping(spark):
    events = frame(spark, [event(latency_ms=12.5)])
    summary = board.fleet_summary(events).first()
    assert (summary.total_events, summary.total_agents, summary.total_targets, summary.active_sites) == (1, 1, 1, 1)
    assert (summary.failure_events, summary.timeout_events) == (0, 0)
    (target,) = rows(board.targets(events))
    assert target["target_key"] == "branch-01::fs01"
    assert target["last_latency_ms"] == 12.5
    (agent,) = rows(board.agents(events))
    assert (agent["total_targets"], agent["healthy_targets"]) == (1, 1)


def test_no_events(spark):
    events = frame(spark, [])
    summary = board.fleet_summary(events).first()
    assert summary.total_events == 0 and summary.failure_events == 0 and summary.latest_timestamp_utc is None
    assert rows(board.targets(events)) == rows(board.sites(events)) == rows(board.incidents(events)) == []


def test_info_rows_do_not_decide_state(spark):
    events = frame(spark, [event(0, latency_ms=3.0), hop(1, "p", 1, "10.0.0.1")])
    (target,) = rows(board.targets(events))
    assert (target["latest_result"], target["last_test_type"]) == ("SUCCESS", "ping")
    (agent,) = rows(board.agents(events))
    assert (agent["healthy_targets"], agent["failing_targets"], agent["timeout_targets"]) == (1, 0, 0)
    (site,) = rows(board.sites(events))
    assert site["failing_targets"] == 0
    assert board.fleet_summary(events).first().total_events == 2


def test_latency_is_independent_of_state(spark):
    events = frame(spark, [event(0, latency_ms=12.5), event(1, test_type="share", probe_name="Share.Access")])
    (target,) = rows(board.targets(events))
    assert (target["last_test_type"], target["last_latency_ms"]) == ("share", 12.5)
    assert rows(board.agents(events))[0]["average_latency_ms"] == 12.5
    assert rows(board.sites(events))[0]["average_latency_ms"] == 12.5


def test_same_target_on_two_agents(spark):
    events = frame(spark, [event(), event(agent_id="branch-02")])
    assert [t["target_key"] for t in rows(board.targets(events))] == ["branch-01::fs01", "branch-02::fs01"]
    assert board.fleet_summary(events).first().total_targets == 2


def test_rolling_window(spark):
    events = frame(
        spark, [event(-3 * 1440, result="FAILURE", error_code="X"), event(-120)]
    )
    assert board.fleet_summary(events).first().failure_events == 1
    day = board.fleet_summary(events, NOON, 1440).first()
    assert (day.failure_events, day.total_events) == (0, 1)


def test_window_bound_is_inclusive(spark):
    events = frame(spark, [event(-60), event(-61)])
    assert filters.in_window(events, NOON, 60).count() == 1
    assert filters.in_window(events, NOON, None).count() == 2


def test_window_minutes():
    resolve = filters.resolve_window_minutes
    assert resolve() == 1440
    assert resolve(30, 5) == 30
    assert resolve(None, 2) == 120
    assert resolve(0, 5) is None and resolve(None, 0) is None


def test_every_result_in_agent_and_site_counts(spark):
    events = frame(
        spark,
        [event(n, target_id=f"t{n}", result=result) for n, result in enumerate(schema.RESULTS)],
    )
    (agent,) = rows(board.agents(events))
    counts = {k: agent[k] for k in ("total_targets", "healthy_targets", "failing_targets", "timeout_targets")}
    assert counts == {"total_targets": 6, "healthy_targets": 1, "failing_targets": 2, "timeout_targets": 1}
    (site,) = rows(board.sites(events))
    assert (site["target_count"], site["failing_targets"]) == (6, 3)
    assert {i["result"] for i in rows(board.incidents(events))} == {"FAILURE", "TIMEOUT", "EMPTY", "SKIPPED", "FATAL"}


def test_moved_target_is_current_in_both_sites(spark):
    events = frame(spark, [event(0, site_id="site-a", result="FAILURE"), event(1, site_id="site-b")])
    assert [(s["site_id"], s["target_count"], s["failing_targets"]) for s in rows(board.sites(events))] == [
        ("site-a", 1, 1),
        ("site-b", 1, 0),
    ]
    assert rows(board.agents(events))[0]["site_id"] == "site-b"


def test_equal_timestamps_go_by_lineage(spark):
    data = [
        event(0, result="FAILURE", batch_id="a", seq=9),
        event(0, result="TIMEOUT", batch_id="b", seq=1),
        event(0, result="SUCCESS", batch_id="b", seq=2),
    ]
    for _ in range(3):
        random.shuffle(data)
        (target,) = rows(board.targets(frame(spark, data)))
        assert target["latest_result"] == "SUCCESS"


def test_target_kinds(spark):
    events = frame(
        spark,
        [
            event(target_id="internet-1"),
            event(target_id="a", metadata='{"targetKind":"external"}'),
            event(target_id="internet-2", metadata='{"targetKind":"internal"}'),
            event(target_id="b"),
        ],
    )
    kinds = {t["target_id"]: t["target_kind"] for t in rows(board.targets(events))}
    assert kinds == {"internet-1": "external", "a": "external", "internet-2": "internal", "b": "internal"}
    by_prefix = {t["target_id"]: t["target_kind"] for t in rows(board.targets(events, "prefix"))}
    assert by_prefix == {"internet-1": "external", "a": "internal", "internet-2": "external", "b": "internal"}


def test_result_does_not_depend_on_row_order_or_partitioning(spark):
    generator = random.Random(7)
    data = [
        event(
            generator.randrange(50),
            agent_id=f"a{generator.randrange(3)}",
            target_id=f"t{generator.randrange(4)}",
            result=generator.choice(schema.RESULTS),
            latency_ms=generator.choice([None, 1.0, 2.5]),
            batch_id=f"b{n % 3}",
            seq=n,
        )
        for n in range(400)
    ]
    want = rows(board.targets(frame(spark, data)))
    generator.shuffle(data)
    assert rows(board.targets(frame(spark, data).repartition(7))) == want

    newest = {}
    for row in data:
        if row["result"] != "INFO":
            key = (row["agent_id"], row["target_id"])
            order = (row["timestamp_utc"], row["batch_id"], row["seq"])
            if key not in newest or order > newest[key][0]:
                newest[key] = (order, row["result"])
    assert {(t["agent_id"], t["target_id"]): t["latest_result"] for t in want} == {
        key: result for key, (_, result) in newest.items()
    }


def test_hot_target_is_reduced_before_the_shuffle(spark):
    """One target with most rows: the plan aggregates in each task first."""
    data = [event(n, target_id="hot" if n % 3 else f"t{n}") for n in range(300)]
    current = board.target_state(frame(spark, data))
    plan = current._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan
    assert current.count() == 101


def test_partition_count(spark):
    data = [event(n, test_type="ping" if n % 3 else "dns") for n in range(9)]
    counted = state.partition_count(frame(spark, data), ["test_type"])
    assert {(r.test_type, r.event_count) for r in counted.collect()} == {("ping", 6), ("dns", 3)}
    assert counted.count() == 9


def test_utc_instants(spark):
    (target,) = rows(board.targets(frame(spark, [event(0)])))
    assert target["last_timestamp_utc"] == NOON
    assert target["last_timestamp_utc"] + timedelta(0) == NOON


def test_search(spark):
    events = frame(spark, [event(), event(target_id="db", fqdn="DB.example.com", result="FAILURE")])
    listed = board.targets(events)
    assert filters.search_targets(listed).count() == 2
    assert [t.target_id for t in filters.search_targets(listed, text=" db.EXAMPLE ").collect()] == ["db"]
    assert filters.search_targets(listed, status="SUCCESS").count() == 1
    assert filters.search_targets(listed, kind="external").count() == 0
    assert filters.search_targets(listed, agent="branch-01", site="site-a").count() == 2


def test_windows_know_zones_and_now(spark):
    from datetime import datetime, timedelta, timezone

    from linkscope.functions.filters import in_window

    rows = frame(spark, [event(-30), event(-90)])
    aware = datetime(2026, 4, 9, 14, tzinfo=timezone(timedelta(hours=2)))
    assert in_window(rows, aware, 60).count() == 1
    assert in_window(rows, None, 60).count() == 0
