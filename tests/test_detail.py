from __future__ import annotations

import math
from datetime import timedelta

import pytest

from helpers import NOON, event, frame, hop
from linkscope.operators import board, detail

KEY = "branch-01::fs01"


@pytest.fixture(scope="module")
def events(spark):
    data = [event(n, latency_ms=float(n), result="SUCCESS" if n % 5 else "TIMEOUT") for n in range(300)]
    data += [hop(n, f"p{n % 10}", 1, f"10.0.0.{n % 10}") for n in range(20)]
    data += [event(0, target_id="quiet", result="INFO", test_type="note")]
    data += [event(n, agent_id="branch-02", test_type="dns") for n in range(5)]
    return frame(spark, data).cache()


@pytest.mark.parametrize("key", ["", "branch-01", "::fs01", "branch-01::", "none::such"])
def test_malformed_or_unknown_key(events, key):
    assert all(df.count() == 0 for df in detail.target_detail(events, key).values())


def test_target_with_info_rows_only_does_not_exist(events):
    assert all(df.count() == 0 for df in detail.target_detail(events, "branch-01::quiet").values())


def test_detail_of_one_target(events):
    found = detail.target_detail(events, KEY)
    assert found["target"].count() == 1
    series = [r.timestamp_utc for r in found["latency_series"].collect()]
    assert len(series) == 240 and set(series) == {NOON + timedelta(minutes=n) for n in range(60, 300)}
    assert found["recent_events"].count() == 80
    assert found["incidents"].count() == 12
    assert found["paths"].count() == 8
    (test,) = found["tests"].collect()
    assert (test.test_type, test.event_count, test.latest_result) == ("ping", 300, "SUCCESS")


def test_window_narrows_the_lists_but_not_the_target(events):
    found = detail.target_detail(events, KEY, NOON + timedelta(days=30), 60)
    assert found["target"].count() == 1
    assert found["latency_series"].count() == found["tests"].count() == found["paths"].count() == 0


@pytest.mark.parametrize("view", ["timeline", "tests", "recent_events", "recent_paths", "recent_incidents"])
def test_all_targets_at_once_equals_one_by_one(events, view):
    function = getattr(detail, view)
    everything = function(events)
    for key in (KEY, "branch-02::fs01"):
        one = sorted(map(str, function(events, key).collect()))
        assert sorted(map(str, everything.filter(everything.target_key == key).collect())) == one


def test_top_n_per_target_is_cut_before_the_shuffle(events):
    plan = detail.recent_events(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange hashpartitioning")
    assert plan.count("WindowGroupLimit") == 2


def test_timeline_is_oldest_first(events):
    times = [r.timestamp_utc for r in detail.timeline(events, KEY).collect()]
    assert times == sorted(times)


@pytest.mark.parametrize(("length", "n"), [(1, 48), (48, 48), (49, 48), (95, 48), (240, 48), (7, 2), (10, 3), (11, 4)])
def test_sample(spark, length, n):
    series = spark.createDataFrame(
        [("k", NOON + timedelta(minutes=i), i) for i in range(length)], "target_key string, timestamp_utc timestamp, seq int"
    )
    want = list(range(length))
    if length > n:
        want = sorted({math.floor((i / (n - 1)) * (length - 1) + 0.5) for i in range(n)})
        assert len(want) == n
    assert sorted(r.seq for r in detail.sample_series(series, n).collect()) == want


def test_feed_hides_traces_of_internal_targets(events):
    recent, targets = detail.recent_events(events), board.targets(events)
    feed = detail.event_feed(recent, targets)
    assert feed.filter("target_key = 'branch-01::fs01'").count() == 20
    assert feed.filter("test_type = 'traceroute'").count() == 0
    assert detail.event_feed(recent, targets, "dns").count() == 5


def test_a_large_limit_cuts_a_hot_target_in_shares(spark, monkeypatch):
    monkeypatch.setattr(detail, "LARGE_N", 3)
    rows = [event(n % 50, latency_ms=float(n), seq=n) for n in range(200)]
    rows += [event(n, latency_ms=1.0, target_id="cold", seq=n) for n in range(2)]
    found = detail.timeline(frame(spark, rows), limit=7)
    want = detail.timeline(frame(spark, rows), "branch-01::fs01", limit=7)
    hot = [tuple(r) for r in found.collect() if r.target_key == "branch-01::fs01"]
    assert hot == [tuple(r) for r in want.collect()] and found.count() == 9
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("WindowGroupLimit") == 4  # a partial and a final one for each cut


@pytest.mark.parametrize("window", [None, 90])
def test_target_detail_equals_the_single_frames(spark, tmp_path, window):
    """From a few stored rows, and two scans of the events."""
    rows = []
    for n in range(400):
        kind = ("ping", "dns", "share")[n % 3]
        result = ("SUCCESS", "FAILURE", "INFO", "TIMEOUT")[n % 4]
        rows.append(event(n % 170 - 170, test_type=kind, result=result, latency_ms=float(n) if n % 5 else None, seq=n))
    rows += [hop(-(n % 160), f"p{n % 11}" if n % 7 else None, n % 3, f"h{n % 4}", seq=1000 + n) for n in range(200)]
    frame(spark, rows + [event(-3, target_id="other")]).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    found = detail.target_detail(events, KEY, NOON, window, timeline_limit=20)
    single = {
        "target": board.targets(events.filter("target_id = 'fs01'")),
        "latency_series": detail.timeline(events, KEY, 20, NOON, window),
        "tests": detail.tests(events, KEY, NOON, window),
        "recent_events": detail.recent_events(events, KEY, NOON, window),
        "paths": detail.recent_paths(events, KEY, NOON, window),
        "incidents": detail.recent_incidents(events, KEY, NOON, window),
    }
    assert list(found) == list(single)
    for name, want in single.items():
        assert sorted(map(str, found[name].collect())) == sorted(map(str, want.select(found[name].columns).collect()))
    files = [set(one.inputFiles()) & set(events.inputFiles()) for one in found.values()]
    assert sum(map(bool, files)) == 1  # besides the scan that stored the rows
