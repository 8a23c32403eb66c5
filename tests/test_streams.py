from __future__ import annotations

from random import Random

from helpers import event, frame, hop
from linkscope.operators import board, paths
from linkscope.streaming import routes
from linkscope.streaming import state as stream


def feed(spark, folder, *batches):
    """Write each batch as its own file and return a stream that reads one file at a time."""
    columns = None
    for n, rows in enumerate(batches):
        data = frame(spark, rows).coalesce(1)
        columns = data.schema
        data.write.mode("append").parquet(folder)
    return spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(folder)


def test_latest_state_across_micro_batches(spark, tmp_path):
    first = [event(0, latency_ms=5.0), event(0, target_id="db", result="FAILURE")]
    second = [event(2, test_type="share")]
    late = [event(1, result="TIMEOUT", latency_ms=9.0)]
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for rows in (first, second, late):
        events = feed(spark, folder, rows)
        stream.start_latest_state(events, out, checkpoint).awaitTermination()
        current = board.targets_from_state(stream.read_latest_state(spark, out, events))
        want = board.targets_from_state(board.target_state(spark.read.parquet(folder)))
        assert sorted(map(str, current.collect())) == sorted(map(str, want.collect()))
    fs01 = current.filter("target_id = 'fs01'").first()
    # The late row is older than the state, but it has the newest latency.
    assert (fs01.latest_result, fs01.last_test_type, fs01.last_latency_ms) == ("SUCCESS", "share", 9.0)


def test_incidents_are_appended_once(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for rows in ([event(0, result="FAILURE"), event(1)], [event(2, result="EMPTY"), event(3, result="INFO")]):
        stream.start_incidents(feed(spark, folder, rows), out, checkpoint).awaitTermination()
    assert sorted(r.result for r in spark.read.parquet(out).collect()) == ["EMPTY", "FAILURE"]


def test_path_changes_follow_the_batch_result(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for minute, path, target in ((0, "A", "t"), (1, "B", "t"), (5, "A", "u"), (2, "A", "t"), (6, "C", "u")):
        rows = [hop(minute, path, n, f"{path}{n}", target_id=target) for n in (1, 2)]
        stream.start_path_changes(feed(spark, folder, rows), out, checkpoint).awaitTermination()
        found = stream.read_path_changes(spark, out)
        want = paths.changes_from_hops(paths.latest_hops(spark.read.parquet(folder)))
        assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert {(r.target_id, r.previous_path_hash, r.path_hash) for r in found.collect()} == {("t", "B", "A"), ("u", "A", "C")}


def test_routes_equal_the_batch_result_on_shuffled_and_repeated_input(spark, tmp_path):
    """Late hops, equal times, paths whose hops differ in site and name, repeated rows, busy targets."""
    random = Random(11)
    rows = []
    for n in range(400):
        values = {
            "target_id": random.choice(["t", "t", "t", "u", "internet-v"]),
            "site_id": random.choice(["a", "b", None]),
            "fqdn": random.choice(["x.example", "y.example"]),
            "hop_name": random.choice([None, f"n{n % 5}"]),
            "metadata": random.choice(["{}", '{"targetKind":"external"}']),
            "seq": n,
        }
        address = random.choice([None, f"10.0.0.{n % 7}"])
        rows.append(hop(random.randrange(12), random.choice("ABCD") if n % 9 else None, n % 4, address, **values))
    rows += rows[:30] + [event(1), event(2, result="FAILURE")]
    random.shuffle(rows)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    assert spark.conf.get(routes.PROVIDER) != routes.ROCKSDB
    for part in (rows[:150], rows[150:160], rows[160:]):
        stream.start_path_changes(feed(spark, folder, part), out, checkpoint).awaitTermination()
        want = paths.changes_from_hops(paths.latest_hops(spark.read.parquet(folder)))
        found = stream.read_path_changes(spark, out).select(*want.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
        assert found.dtypes == want.dtypes
    assert spark.conf.get(routes.PROVIDER) != routes.ROCKSDB
    # Rows that are older than what is known change nothing and store nothing.
    before = spark.read.parquet(out).count()
    stream.start_path_changes(feed(spark, folder, rows[:40]), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == before


def test_no_routes_give_no_changes(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    stream.start_path_changes(feed(spark, folder, [event(0)]), out, checkpoint).awaitTermination()
    assert stream.read_path_changes(spark, out).collect() == []


def stored(path):
    return sorted(p.name for p in path.iterdir() if not p.name.startswith(("_", ".")))


def test_merges_bound_what_a_reader_opens(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for minute in range(9):
        rows = [hop(minute, "AB"[minute % 2], n, f"h{n}", target_id=f"t{minute % 3}") for n in (1, 2)]
        stream.start_path_changes(feed(spark, folder, rows), out, checkpoint, merge_every=2).awaitTermination()
        # Of each tier the folders of two merges at most, less than one of them not merged yet; no other folder.
        names = stored(tmp_path / "out")
        assert all(sum(name.startswith(kind) for name in names) <= 4 for kind in ("epoch=", "run1=", "run2=", "run3="))
        assert len(stream._current_folders(spark, out)) <= 4
    found = stream.read_path_changes(spark, out)
    want = paths.changes_from_hops(paths.latest_hops(spark.read.parquet(folder)))
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_merge_cut_short_is_ignored_and_made_again(spark, tmp_path):
    path, rows = str(tmp_path / "state"), spark.createDataFrame([], "k long, v long").schema
    for epoch in range(4):
        stream.write_epoch(spark.createDataFrame([(epoch % 2, epoch), (9, epoch)], rows), path, epoch)
        stream.merge_epochs(spark, path, rows, ("k",), epoch, 2)
    want = [(0, 2), (1, 3), (9, 3)]
    assert stream._current_folders(spark, path) == ["run2=3"]
    assert sorted(map(tuple, stream.read_latest(spark, path, rows, ("k",)).collect())) == want
    for name in ("run2=3", "run1=3"):
        (tmp_path / "state" / name / "_SUCCESS").unlink()
        assert sorted(map(tuple, stream.read_latest(spark, path, rows, ("k",)).collect())) == want
    assert stream._current_folders(spark, path) == ["run1=1", "epoch=2", "epoch=3"]
    stream.write_epoch(spark.createDataFrame([(1, 3), (9, 3)], rows), path, 3)
    stream.merge_epochs(spark, path, rows, ("k",), 3, 2)
    assert sorted(map(tuple, stream.read_latest(spark, path, rows, ("k",)).collect())) == want
    assert stored(tmp_path / "state") == ["epoch=2", "epoch=3", "run1=1", "run1=3", "run2=3"]


def test_a_merge_writes_what_changed_and_not_all_keys(spark, tmp_path):
    path, rows = str(tmp_path / "state"), spark.createDataFrame([], "k long, v long").schema
    for epoch in range(10):
        keys = range(500) if epoch == 0 else (epoch % 3, 700 + epoch)
        stream.write_epoch(spark.createDataFrame([(k, epoch) for k in keys], rows), path, epoch)
        stream.merge_epochs(spark, path, rows, ("k",), epoch, 3)
    sizes = {name: spark.read.parquet(f"{path}/{name}").count() for name in stored(tmp_path / "state")}
    assert sizes["run2=8"] == 508 and max(n for name, n in sizes.items() if name not in ("run2=8", "run1=2")) <= 6
    newest = {row.k: row.v for row in stream.read_latest(spark, path, rows, ("k",)).collect()}
    assert newest == {k: 0 for k in range(3, 500)} | {0: 9, 1: 7, 2: 8} | {700 + n: n for n in range(1, 10)}
