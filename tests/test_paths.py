from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helpers import NOON, event, frame, hop
from linkscope.functions.events import path_change, shared_prefix
from linkscope.operators import board, paths


def trace(minutes, path, *addresses, **values):
    return [hop(minutes, path, n, address, **values) for n, address in enumerate(addresses, 1)]


def test_preview_uses_name_address_or_star(spark):
    data = trace(0, "p", "10.0.0.1", None, "10.0.0.3")
    data[0]["hop_name"] = "gw"
    data[0]["hop_latency_ms"], data[2]["hop_latency_ms"] = 1.0, 4.0
    (row,) = paths.paths(frame(spark, data)).collect()
    assert (row.path_preview, row.hop_count, row.average_hop_latency_ms) == ("gw -> * -> 10.0.0.3", 3, 2.5)


def test_newest_hop_wins(spark):
    data = trace(0, "p", "10.0.0.1", "10.0.0.2") + trace(5, "p", "10.0.0.9")
    (row,) = paths.paths(frame(spark, data)).collect()
    assert row.path_preview == "10.0.0.9 -> 10.0.0.2"


def test_flapping_route_shows_only_the_way_back(spark):
    data = trace(0, "A", "1", "2") + trace(1, "B", "1", "3") + trace(2, "A", "1", "2")
    (change,) = paths.path_changes(frame(spark, data)).collect()
    assert (change.previous_path_hash, change.path_hash) == ("B", "A")
    assert (change.previous_path_preview, change.path_preview) == ("1 -> 3", "1 -> 2")


def test_unhashed_hops_are_a_path_but_never_a_change(spark):
    data = trace(0, "A", "1") + trace(1, None, "2") + trace(2, "unknown", "3", "4")
    seen = {r.path_hash: r.path_preview for r in paths.paths(frame(spark, data)).collect()}
    assert seen == {"A": "1", "unknown": "3 -> 4"}
    (change,) = paths.path_changes(frame(spark, data)).collect()
    assert (change.previous_path_hash, change.path_hash) == ("A", "unknown")


def test_limit_keeps_the_newest_changes(spark):
    data = [row for n in range(6) for row in trace(n, f"p{n}", str(n))]
    changes = paths.path_changes(frame(spark, data), limit=2).collect()
    assert [c.path_hash for c in changes] == ["p5", "p4"]


def test_order_of_rows_does_not_matter(spark):
    generator = random.Random(3)
    data = [
        row
        for n in range(60)
        for row in trace(
            generator.randrange(40), f"p{generator.randrange(3)}", "1", str(n), target_id=f"t{n % 4}", seq=n
        )
    ]
    want = sorted(map(str, paths.path_changes(frame(spark, data), 100).collect()))
    generator.shuffle(data)
    assert sorted(map(str, paths.path_changes(frame(spark, data).repartition(5), 100).collect())) == want


def test_visible_changes(spark):
    data = [
        row
        for key in ("internet-1", "fs01")
        for path, minute in (("A", 0), ("B", 1))
        for row in trace(minute, path, path, target_id=key)
    ]
    data += [event(2, target_id="internet-1"), event(2, target_id="fs01")]
    events = frame(spark, data)
    changes = paths.path_changes(events)
    assert changes.count() == 2
    visible = paths.visible_changes(changes, board.targets(events)).collect()
    assert [c.target_id for c in visible] == ["internet-1"]
    assert (visible[0].change, visible[0].shared_hops) == ("start", 0)
    none = paths.visible_changes(changes, board.targets(events), selected_key="branch-01::fs01")
    assert none.count() == 0


@pytest.mark.parametrize(
    ("left", "right", "shared", "change"),
    [
        (["a", "b"], ["a", "b", "c"], 2, "length"),
        (["a", "b", "c"], ["a", "b"], 2, "length"),
        (["a", "b", "c"], ["a", "x", "c"], 1, "branch"),
        (["a"], ["b"], 0, "start"),
        ([], ["b"], 0, "unknown"),
        (["a"], ["a"], 1, "length"),
    ],
)
def test_path_change(spark, left, right, shared, change):
    row = spark.createDataFrame([(left, right)], "l array<string>, r array<string>").select(
        shared_prefix(F.col("l"), F.col("r")).alias("shared"), path_change(F.col("l"), F.col("r")).alias("change")
    ).first()
    assert row.shared == shared
    assert row.change == change
