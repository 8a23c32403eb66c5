from __future__ import annotations

import hashlib
import json
import os
import re
import time
from datetime import datetime, timedelta
from pathlib import Path
from random import Random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import event, frame, line, wire
from linkscope import schema
from linkscope.operators import board
from linkscope.plans import importing, snapshot, status
from linkscope.session import shared_folder
from linkscope.sinks import files, lake as sink, packing
from linkscope.sources import batches
from linkscope.sources.tables import Lake
from linkscope.streaming import importing as stream_import

AT = datetime(2026, 4, 10)


@pytest.fixture
def place(tmp_path):
    """A folder for batch files and an empty lake."""
    root = tmp_path / "batches"
    root.mkdir()
    return root, Lake(str(tmp_path / "lake"))


def run(spark, lake, root, at=AT, **options):
    return importing.import_source(spark, lake, batches.local_source(str(root), **options), at)


def counts(result):
    return (result.discovered, result.imported, result.skipped, result.failed)


def test_import_once_then_skip(spark, place):
    root, lake = place
    (root / "deep" / "er").mkdir(parents=True)
    (root / "deep" / "er" / "x.jsonl").write_text(line() + "\n\n" + line(details="two") + "\n")
    (root / "ignored.txt").write_text("no batch")
    assert counts(run(spark, lake, root)) == (1, 1, 0, 0)
    assert counts(run(spark, lake, root, AT + timedelta(hours=1))) == (1, 0, 1, 0)
    events = lake.events(spark).orderBy("seq").collect()
    assert [(e.seq, e.details, e.event_date) for e in events] == [(1, "ok", events[0].event_date), (3, "two", events[0].event_date)]
    (entry,) = lake.ledger(spark).collect()
    assert (entry.source_type, entry.source_identifier, entry.event_count) == ("local", "deep/er/x.jsonl", 2)
    assert entry.imported_utc == AT
    assert lake.last_import(spark).first().last_imported_utc == AT

    (source,) = status.import_source_status(lake.import_runs(spark)).collect()
    assert (source.cumulative_discovered, source.cumulative_imported, source.cumulative_skipped) == (2, 1, 1)
    assert source.last_run_skipped == 1 and source.last_error is None
    assert source.last_imported_batch_utc == AT and source.last_success_utc == AT + timedelta(hours=1)


def test_invalid_json(spark, place):
    root, lake = place
    (root / "x.jsonl").write_text(line() + "\n{broken\n")
    result = run(spark, lake, root)
    assert counts(result) == (1, 0, 0, 1) and result.last_error == "Invalid JSON on line 2"
    assert lake.events(spark).count() == 0 and lake.ledger(spark).count() == 0
    assert counts(run(spark, lake, root)) == (1, 0, 0, 1)
    (source,) = status.import_source_status(lake.import_runs(spark)).collect()
    assert (source.last_run_backlog, source.cumulative_failed, source.last_success_utc) == (1, 2, None)


def test_one_bad_batch_does_not_stop_the_others(spark, place):
    root, lake = place
    (root / "a.jsonl").write_text(line())
    (root / "b.jsonl").write_text(line() + "\n" + line(result="BROKEN"))
    (root / "c.jsonl").write_text("\n \n")
    (root / "d.jsonl").write_text("")  # Spark does not list files of no bytes
    (root / "e.jsonl").write_text(line())
    result = run(spark, lake, root)
    assert counts(result) == (4, 2, 0, 2)
    assert result.last_error == "Batch did not contain any event lines."
    assert result.last_source_identifier == "e.jsonl"
    assert lake.events(spark).count() == 2


def test_rewritten_file_is_imported_again_in_full(spark, place):
    root, lake = place
    (root / "x.jsonl").write_text(line())
    run(spark, lake, root)
    (root / "x.jsonl").write_text(line() + "\n" + line(details="two"))
    assert counts(run(spark, lake, root)) == (1, 1, 0, 0)
    assert lake.events(spark).count() == 3
    assert lake.events(spark, dedupe=True).count() == 2


def test_same_content_under_another_name_is_another_batch(spark, place):
    root, lake = place
    (root / "x.jsonl").write_text(line())
    (root / "y.jsonl").write_text(line())
    assert counts(run(spark, lake, root)) == (2, 2, 0, 0)


def test_content_fingerprint_is_of_the_lines(spark, place):
    """Neither line ends nor the way a file is split count; the order of lines does."""
    root, _ = place
    lines = [f"{{\"a\":{n}}}" * (n % 40) for n in range(3000)]
    (root / "lf.jsonl").write_bytes("\n".join(lines).encode())
    (root / "crlf.jsonl").write_bytes("\r\n".join(lines).encode())
    (root / "swapped.jsonl").write_bytes("\n".join([*lines[:9], lines[10], lines[9], *lines[11:]]).encode())
    (root / "shorter.jsonl").write_bytes("\n".join(lines[:-1]).encode())
    found = []
    for size in ("128m", "20000", "33333"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            batch = batches.local_source(str(root)).batches(spark).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        found.append({row.source_identifier: row.fingerprint for row in batch})
    assert found[0] == found[1] == found[2]
    assert found[0]["lf.jsonl"] == found[0]["crlf.jsonl"]
    assert len(set(found[0].values())) == 3
    assert found[0]["lf.jsonl"] == sha("\n".join(lines))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_large_files_are_hashed_as_a_tree(spark, place):
    """However a file is split: blocks of 4,096 lines, each the hash of its lines' hashes."""
    root, _ = place
    lines = [f"{n}" * (n % 30) for n in range(9000)]
    (root / "lf.jsonl").write_bytes("\n".join(lines).encode())
    (root / "crlf.jsonl").write_bytes("\r\n".join(lines).encode())
    (root / "small.jsonl").write_text("one line\r\n")
    blocks = ["".join(map(sha, lines[at : at + 4096])) for at in range(0, len(lines), 4096)]
    want = sha("".join(map(sha, blocks)))
    for size in ("128m", "20000", "33333"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = batches.local_source(str(root), whole_bytes=1000).batches(spark)
            got = {row.source_identifier: row.fingerprint for row in found.collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {"lf.jsonl": want, "crlf.jsonl": want, "small.jsonl": sha("one line\n")}


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_ranges_give_every_line_once(monkeypatch, step):
    monkeypatch.setattr(batches, "_READ_STEP", step)
    random = Random(step)
    for _ in range(60):
        data = "".join(random.choice(["a", "bc", "\n", "\r\n", "\r", ""]) for _ in range(30)).encode()
        want = re.split(rb"\r\n|\n|\r", data)
        want = want[:-1] if want[-1] == b"" else want
        width = random.randint(1, 9)
        found = []
        for start in range(0, len(data), width):
            end = min(start + width, len(data))
            found += batches.lines_of_range(lambda at, count, data=data: data[at : at + count], start, end)
        assert found == want, data


def test_one_batch_is_read_and_hashed_by_many_tasks(spark, place):
    root, lake = place
    texts = {"x": "\n".join(line() for _ in range(40)), "y": line() + "\r\n\r\n" + line(), "z": ""}
    for name, text in texts.items():
        (root / name).write_bytes(text.encode())

    def load(session):
        rows = [(name, len(text.encode())) for name, text in texts.items()]
        return session.createDataFrame(rows, "source_identifier string, length long")

    folder = str(root)

    def read(name, start, count):
        with open(f"{folder}/{name}", "rb") as file:
            file.seek(start)
            return file.read(count)

    source = batches.register_source("ranged", load, read, range_bytes=100)
    assert batches.registered_source("ranged") is source
    found = {row.source_identifier: row for row in source.batches(spark).collect()}
    parts = [texts["x"][at : at + 100] for at in range(0, len(texts["x"]), 100)]
    assert found["x"].fingerprint == sha("".join(map(sha, parts)))
    lines = source.lines(spark, source.batches(spark))
    assert lines.filter("source_identifier = 'x'").count() == 40
    assert [r.line_no for r in lines.filter("source_identifier = 'y'").orderBy("line_no").collect()] == [1, 2, 3]
    assert source._ranges(source.batches(spark)).rdd.getNumPartitions() > 40
    result = importing.import_source(spark, lake, source, AT)
    assert (result.discovered, result.imported, result.failed) == (3, 2, 1)  # an empty batch fails
    assert lake.events(spark).count() == 42


def test_small_ranges_share_tasks_and_reads(spark):
    """Neither the tasks nor the bytes read grow with the number of ranges."""
    data = b"\n".join(b"line %05d" % n for n in range(20_000))
    asked = []

    def read(start, count):
        asked.append(count)
        return data[start : start + count]

    found = []
    for start in range(0, len(data), 1000):
        found += batches.lines_of_range(read, start, min(start + 1000, len(data)))
    assert found == data.split(b"\n")
    assert sum(asked) < 6 * len(data)
    source = batches.RangedSource("small", lambda session: None, lambda name, start, count: b"", range_bytes=100)
    names = spark.range(20).selectExpr("concat('n', id) AS source_identifier", "10000L AS length")
    ranges = source._ranges(names)
    assert ranges.count() == 2000 and ranges.rdd.getNumPartitions() <= batches.RANGE_TASKS


def test_new_batches_are_told_without_shuffling_their_text(spark, place):
    """Each new batch once, the one listed first; only keys are shuffled, and nothing but numbers is stored."""
    root, _ = place
    listed = spark.range(90_000, numPartitions=3).selectExpr(
        "'x' AS source_type", "concat('b', id % 80000) AS source_identifier", "'f' AS fingerprint", "repeat('t', 5) AS content",
        f"id + if(id >= 60000, 1L << 33, 0) AS {batches.LISTING_NO}",
    )
    listed.write.parquet(f"{root}/listing")
    listing = spark.read.parquet(f"{root}/listing")
    ledger = spark.range(0, 80_000, 3).selectExpr("'x' AS source_type", "concat('b', id) AS source_identifier", "'f' AS fingerprint")
    pending = importing.pending_batches(listing, ledger, f"{root}/pending")
    found = pending.select("source_identifier", batches.LISTING_NO, "content").collect()
    want = {f"b{n}": n + ((1 << 33) if n >= 60_000 else 0) for n in range(80_000) if n % 3}
    assert len(found) == len(want) and {r.source_identifier: r[batches.LISTING_NO] for r in found} == want
    assert all(r.content == "ttttt" for r in found)
    assert "hashpartitioning" not in pending._jdf.queryExecution().executedPlan().toString()


def test_full_blocks_are_hashed_where_their_lines_are_read(spark, place):
    """A tree of lines shuffles a row for each block, not for each line, however the text is split."""
    root, _ = place
    rows = [f"line {n}" for n in range(3 * batches.TREE_LINES + 5)]
    (root / "a.jsonl").write_text("\n".join(rows))
    blocks = [rows[at : at + batches.TREE_LINES] for at in range(0, len(rows), batches.TREE_LINES)]
    want = sha("".join(sha("".join(map(sha, block))) for block in blocks))
    for n, size in enumerate(("128m", "20000")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            text = spark.read.text(str(root), pathGlobFilter="*.jsonl")
            text = text.select("value", *[column.alias(name) for name, column in batches._place().items()])
            batches.line_hashes(text).write.parquet(f"{root}/h{n}")
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        hashes = spark.read.parquet(f"{root}/h{n}")
        batches.line_blocks(hashes).write.parquet(f"{root}/s{n}")
        (row,) = batches.tree_fingerprints(hashes, spark.read.parquet(f"{root}/s{n}")).collect()
        assert row.fingerprint == want
    columns = [[str(root)] * len(rows), [n // batches.TREE_LINES for n in range(len(rows))], [*range(1, len(rows) + 1)], list(map(sha, rows))]
    part = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["file_path", "block", "line_no", "hash"])
    found = [row for out in batches.joined_hashes(iter([part.slice(0, 100), part.slice(100)])) for row in out.to_pylist()]
    assert [(row["line_no"], row["whole"]) for row in found] == [(1, True), (4097, True), (8193, True), (12289, False)]


def test_a_committed_run_is_logged_as_such(spark, place, monkeypatch):
    root, lake = place
    (root / "x.jsonl").write_text(line())
    append, calls = importing.sink.append_import_run, []

    def failing(*args):
        calls.append(1)
        if len(calls) < 2:
            raise OSError("no space")
        append(*args)

    monkeypatch.setattr(importing.sink, "append_import_run", failing)
    assert counts(run(spark, lake, root)) == (1, 1, 0, 0)
    assert [r.imported for r in lake.import_runs(spark).collect()] == [1]

    # An error after the ledger was written does not make the run a failed one either.
    (root / "y.jsonl").write_text(line())
    ledger = importing.sink.append_ledger

    def late(*args):
        ledger(*args)
        raise OSError("lost the answer")

    monkeypatch.setattr(importing.sink, "append_ledger", late)
    assert counts(run(spark, lake, root)) == (2, 1, 1, 0)
    monkeypatch.setattr(importing.sink, "append_ledger", lambda *args: (_ for _ in ()).throw(OSError("no space")))
    (root / "z.jsonl").write_text(line())
    assert counts(run(spark, lake, root)) == (3, 0, 2, 1)
    assert lake.events(spark).count() == 2


def test_a_touched_file_is_imported_once(spark, place):
    root, lake = place
    (root / "x.jsonl").write_text(line())
    assert counts(run(spark, lake, root)) == (1, 1, 0, 0)
    os.utime(root / "x.jsonl", (1, 1))
    assert counts(run(spark, lake, root)) == (1, 0, 1, 0)


def test_stat_fingerprint_changes_with_the_file(spark, place):
    root, lake = place
    (root / "x.jsonl").write_text(line())
    assert counts(run(spark, lake, root, fingerprint="stat")) == (1, 1, 0, 0)
    assert counts(run(spark, lake, root, fingerprint="stat")) == (1, 0, 1, 0)
    time.sleep(1.1)
    (root / "x.jsonl").write_text(line())
    assert counts(run(spark, lake, root, fingerprint="stat")) == (1, 1, 0, 0)


def test_lines_survive_another_split_size(spark, place):
    """Files cut into many splits, and cut differently when the lines are used."""
    root, _ = place
    texts = {}
    for name, ending in (("lf", "\n"), ("crlf", "\r\n")):
        texts[name] = [f"{n}" * (n % 50) for n in range(4000)]
        (root / f"{name} [100]%+.jsonl").write_bytes(ending.join(texts[name]).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        source = batches.local_source(str(root))
        lines = source.lines(spark, source.batches(spark))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "17000")
        for name, want in texts.items():
            found = lines.filter(F.col("source_identifier") == f"{name} [100]%+.jsonl").orderBy("line_no").collect()
            assert [r.line_no for r in found] == list(range(1, 4001))
            assert [r.value for r in found] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_many_files_are_read_in_turns(spark, place, monkeypatch):
    root, lake = place
    monkeypatch.setattr(batches, "PATHS_A_READ", 2)
    for n in range(5):
        (root / f"{n}.jsonl").write_text(line() + "\n" + line())
    assert counts(run(spark, lake, root)) == (5, 5, 0, 0)
    assert lake.events(spark).count() == 10


def test_links_are_skipped(spark, place, tmp_path):
    root, lake = place
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "x.jsonl").write_text(line())
    (root / "link.jsonl").symlink_to(outside / "x.jsonl")
    (root / "folder").symlink_to(outside)
    (root / "folder2").mkdir()
    (root / "folder2" / "y.jsonl").write_text(line())
    result = run(spark, lake, root)
    assert counts(result) == (1, 1, 0, 0) and result.last_source_identifier == "folder2/y.jsonl"


def test_missing_root_has_no_batches(spark, tmp_path):
    lake = Lake(str(tmp_path / "lake"))
    assert counts(run(spark, lake, tmp_path / "none")) == (0, 0, 0, 0)
    (entry,) = lake.import_runs(spark).collect()
    assert entry.failed == 0


def test_hybrid(spark, place, tmp_path):
    root, lake = place
    (root / "x.jsonl").write_text(line())
    store = tmp_path / "store" / "events" / "site-a"
    store.mkdir(parents=True)
    (store / "x.jsonl").write_text(line(agentId="branch-02"))
    sources = batches.sources_for_mode("hybrid", str(root), str(tmp_path / "store"), "/events/")
    assert [s.source_type for s in sources] == ["local", "azure"]
    results = importing.import_all(spark, lake, sources, AT)
    assert [r.imported for r in results] == [1, 1]
    assert {r.source_identifier for r in lake.ledger(spark).collect()} == {"x.jsonl", "events/site-a/x.jsonl"}
    assert batches.union_batches(spark, sources).count() == 2
    sources_status = status.import_source_status(lake.import_runs(spark))
    overall = status.import_status(sources_status, "hybrid").first()
    assert (overall.mode, overall.cumulative_imported, overall.last_error) == ("hybrid", 2, None)
    last = status.import_run_result(sources_status, "hybrid").first()
    assert (last.discovered, last.imported, last.skipped, last.failed) == (2, 2, 0, 0)


def test_modes():
    assert batches.sources_for_mode("disabled") == []
    assert [s.source_type for s in batches.sources_for_mode("local", "/x")] == ["local"]
    with pytest.raises(ValueError):
        batches.sources_for_mode("other")


def test_source_that_cannot_be_listed(spark, tmp_path):
    def broken(session):
        raise OSError("no access")

    lake = Lake(str(tmp_path))
    result = importing.import_source(spark, lake, batches.ContentSource("custom", broken), AT)
    assert counts(result) == (0, 0, 0, 1)
    (source,) = status.import_source_status(lake.import_runs(spark)).collect()
    assert (source.last_run_backlog, source.last_error, source.last_source_identifier) == (1, "no access", None)


def test_own_source_with_own_fingerprints(spark, tmp_path):
    rows = [("a", "etag-1", line()), ("a", "etag-1", line()), ("b", "", line())]
    load = lambda s: s.createDataFrame(rows, "source_identifier string, fingerprint string, content string")
    batches.register_source("custom", load)
    lake = Lake(str(tmp_path))
    result = importing.import_source(spark, lake, batches.registered_source("custom"), AT)
    assert counts(result) == (3, 2, 1, 0)
    prints = {r.source_identifier: r.fingerprint for r in lake.ledger(spark).collect()}
    assert prints == {"a": "etag-1", "b": hashlib.sha256(line().encode()).hexdigest()}


def test_status_error_choice(spark):
    def entry(source, hour, error, failed=1):
        at = AT + timedelta(hours=hour)
        return (f"{source}{hour}", source, at, 1, 0, 0, failed, failed, error, None, None)

    def overall(*entries):
        runs = spark.createDataFrame(list(entries), schema.IMPORT_RUN_SCHEMA)
        return status.import_status(status.import_source_status(runs), "hybrid").first()

    assert overall(entry("local", 1, "L"), entry("azure", 2, "A")).last_error == "A"
    assert overall(entry("local", 1, "L"), entry("azure", 1, "A")).last_error == "A"
    assert overall(entry("local", 1, "L"), entry("azure", 2, None, 0)).last_error == "L"
    assert overall(entry("local", 1, "L"), entry("local", 2, None, 0)).last_error is None


def test_rows_of_an_uncommitted_run_are_invisible(spark, place):
    """A driver lost between events and ledger leaves rows nobody sees."""
    root, lake = place
    (root / "x.jsonl").write_text(line())
    orphan = frame(spark, [event(details="orphan")])
    sink.append_events(lake, orphan, "lost-run")
    assert lake.events(spark).count() == 0
    run(spark, lake, root)
    assert [e.details for e in lake.events(spark).collect()] == ["ok"]


def test_a_torn_ledger_repeats_nothing(spark, place):
    """A run lost halfway through its ledger rows, and two runs of the same batches."""
    root, lake = place
    for n in range(4):
        (root / f"{n}.jsonl").write_text(line())
    run(spark, lake, root)
    ledger = lake.ledger(spark).collect()
    half = spark.createDataFrame(ledger[:2], schema.LEDGER_SCHEMA)
    half.coalesce(1).write.mode("overwrite").parquet(lake.path("torn"))
    spark.read.parquet(lake.path("torn")).write.mode("overwrite").parquet(lake.path("ledger"))
    assert lake.events(spark).count() == 2
    assert counts(run(spark, lake, root, AT + timedelta(hours=1))) == (4, 2, 2, 0)
    assert lake.events(spark).count() == 4
    late = [row.asDict() | {"run_id": "late", "imported_utc": AT + timedelta(days=1)} for row in ledger]
    sink.append_ledger(lake, spark.createDataFrame([tuple(row[c] for c in schema.LEDGER_SCHEMA.names) for row in late], schema.LEDGER_SCHEMA))
    assert lake.events(spark).count() == 4


def test_a_source_that_cannot_be_read(spark, place, tmp_path):
    class Broken(batches.ContentSource):
        def lines(self, session, pending):
            raise OSError("torn wire")

    root, lake = place
    (root / "x.jsonl").write_text(line())
    rows = lambda s: s.createDataFrame([("a", "x"), ("b", "y")], "source_identifier string, content string")
    results = importing.import_all(spark, lake, [Broken("custom", rows), batches.local_source(str(root))], AT)
    assert [counts(result) for result in results] == [(2, 0, 0, 2), (1, 1, 0, 0)]
    assert results[0].last_error == "torn wire" and lake.events(spark).count() == 1
    assert lake.import_runs(spark).count() == 2


def test_nothing_staged_is_left(spark, place):
    root, lake = place
    (root / "x.jsonl").write_text(line())
    base = Path(shared_folder(spark, "probe")).parent
    before = set(base.glob("*"))
    run(spark, lake, root)
    assert set(base.glob("*")) == before


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(), "x")


def test_envelopes_are_stored_or_refused_as_a_whole(spark, tmp_path):
    lake = Lake(str(tmp_path))
    bodies = lambda *events: spark.createDataFrame(
        [("r", json.dumps({"events": list(events)}))], "source_identifier string, body string"
    )
    assert importing.ingest_envelopes(spark, lake, bodies(wire(), wire()), AT) == 2
    assert importing.ingest_envelopes(spark, lake, bodies(wire()), AT) == 1
    with pytest.raises(ValueError, match="Unsupported result"):
        importing.ingest_envelopes(spark, lake, bodies(wire(), wire(result="?")), AT)
    with pytest.raises(ValueError, match="did not contain any event"):
        importing.ingest_envelopes(spark, lake, bodies(), AT)
    torn = spark.createDataFrame([("r", '{"events": [')], "source_identifier string, body string")
    with pytest.raises(ValueError, match="no.*JSON|not a JSON"):
        importing.ingest_envelopes(spark, lake, torn, AT)
    assert lake.events(spark).count() == 3


def test_written_files_import_as_the_same_events(spark, place):
    root, lake = place
    rows = [
        event(0, latency_ms=1.5, metadata='{"a":{"b":[1,null]}}'),
        event(1, details='say "x", y\n\\', hop_index=3, result="INFO"),
        event(2, site_id="site/b", error_code="E"),
    ]
    files.write_jsonl(frame(spark, rows), str(root / "out"), by_site=True)
    assert run(spark, lake, root).failed == 0
    columns = list(schema.EVENT_COLUMNS)
    found = sorted(map(tuple, lake.events(spark).select(*columns).collect()), key=str)
    assert found == sorted((tuple(r[c] for c in columns) for r in rows), key=str)


def test_csv_mirror_quotes_every_field(spark, tmp_path):
    data = frame(spark, [event(0, details='say "x", ok', latency_ms=1.5)])
    files.write_csv_mirror(data.coalesce(1), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("*.csv")
    header, row = part.read_text().splitlines()
    assert header.replace('"', "").split(",") == [wire for _, wire in schema.WIRE_FIELDS[:13]]
    assert row.startswith('"2026-04-09T12:00:00.0000000Z","branch-01","site-a","fs01"')
    assert row.endswith('"SUCCESS","1.5","","","say ""x"", ok"')


def test_window_prunes_partitions(spark, tmp_path):
    from linkscope.functions.filters import in_window

    lake = Lake(str(tmp_path))
    sink.append_events(lake, frame(spark, [event(-n * 1440) for n in range(5)]), "r")
    stored = spark.read.schema(schema.STORED_EVENT_SCHEMA).parquet(lake.path("events"))
    recent = in_window(stored, datetime(2026, 4, 9, 13), 1440)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert recent.count() == 1


def test_snapshot(spark, place, tmp_path):
    root, lake = place
    (root / "x.jsonl").write_text(line())
    run(spark, lake, root)
    frames = snapshot.board_snapshot(spark, lake.events(spark), lake.import_runs(spark), AT, 1440, "local")
    assert snapshot.read_snapshot(spark, str(tmp_path / "board")) == {}
    snapshot.write_snapshot(frames, str(tmp_path / "board"))
    read = snapshot.read_snapshot(spark, str(tmp_path / "board"))
    assert set(read) == set(frames)
    assert read["summary"].first().total_events == 1 and read["summary"].first().refreshed_utc == AT
    assert read["targets"].first().target_key == "branch-01::fs01"
    assert read["import_status"].first().cumulative_imported == 1
    assert read["path_changes"].count() == 0


def test_snapshot_versions(spark, tmp_path):
    """Readers take all frames of one complete version; the last two stay."""
    path = str(tmp_path / "board")
    numbers = [
        snapshot.write_snapshot({name: spark.createDataFrame([(n,)], "n long") for name in ("a", "b")}, path)
        for n in range(3)
    ]
    spark.createDataFrame([(9,)], "n long").write.parquet(f"{path}/version={numbers[-1] + 1}/a")  # cut short
    read = snapshot.read_snapshot(spark, path)
    assert {name: frame.first().n for name, frame in read.items()} == {"a": 2, "b": 2}
    assert sorted(p.name for p in tmp_path.glob("board/epoch=*")) == [f"epoch={n}" for n in numbers[1:]]
    assert not (tmp_path / "board" / f"version={numbers[0]}").exists()


def test_snapshot_equals_the_single_frames(spark):
    """Targets that move between sites, late rows, INFO rows, and a window that leaves some out."""
    random = Random(3)
    rows = [
        event(
            random.randrange(600),
            agent_id=random.choice("ab"),
            site_id=random.choice("xyz"),
            target_id=random.choice("tuvw"),
            result=random.choice(["SUCCESS", "FAILURE", "FATAL", "TIMEOUT", "INFO", "SKIPPED"]),
            latency_ms=random.choice([None, 1.5, 8.0]),
            seq=n,
        )
        for n in range(120)
    ]
    events = frame(spark, rows)
    at = datetime(2026, 4, 9, 22)
    runs = spark.createDataFrame([], schema.IMPORT_RUN_SCHEMA)
    found = snapshot.board_snapshot(spark, events, runs, at, 240)
    want = {
        "summary": board.fleet_summary(events, at, 240),
        "agents": board.agents(events),
        "sites": board.sites(events),
        "targets": board.targets(events),
        "incidents": board.incidents(events),
    }
    for name, single in want.items():
        assert sorted(map(str, found[name].select(single.columns).collect())) == sorted(map(str, single.collect()))


def test_import_cycles(spark, place, tmp_path):
    root, lake = place
    (root / "x.jsonl").write_text(line())
    cycles = []
    stream = stream_import.start_import_cycles(
        spark, lake, [batches.local_source(str(root))], str(tmp_path / "checkpoint"), 1, cycles.append
    )
    try:
        assert [counts(r) for r in cycles[0]] == [(1, 1, 0, 0)]
        (root / "x.jsonl").write_text(line() + "\n" + line())
        deadline = time.time() + 90
        while sum(r.imported for c in cycles for r in c) < 2 and time.time() < deadline:
            time.sleep(0.5)
    finally:
        stream.stop()
    assert sum(r.imported for c in cycles for r in c) == 2
    with pytest.raises(ValueError):
        stream_import.check_interval(0)


def test_file_stream_imports_new_files_once(spark, place, tmp_path):
    root, lake = place
    source = batches.local_source(str(root))

    def drain():
        stream_import.start_file_import(spark, lake, source, str(tmp_path / "checkpoint")).awaitTermination()

    (root / "a b+%.jsonl").write_text(line() + "\n" + line())
    (root / "bad.jsonl").write_text("{")
    drain()
    (root / "c.jsonl").write_text(line())
    drain()
    assert lake.events(spark).count() == 3
    assert {r.source_identifier for r in lake.ledger(spark).collect()} == {"a b+%.jsonl", "c.jsonl"}
    # The file that failed was read again with the new one.
    runs = [(r.discovered, r.imported, r.failed) for r in lake.import_runs(spark).orderBy("run_utc").collect()]
    assert runs == [(2, 1, 1), (2, 1, 1)]

    # Mended, it is imported with the next files; another one that failed and is gone is forgotten.
    (root / "gone.jsonl").write_text("{")
    (root / "bad.jsonl").write_text(line() + "\n" + line() + "\n" + line())
    drain()
    assert lake.events(spark).count() == 6
    (root / "gone.jsonl").unlink()
    (root / "d.jsonl").write_text(line())
    drain()
    (root / "e.jsonl").write_text(line())
    drain()
    runs = [(r.discovered, r.imported, r.failed) for r in lake.import_runs(spark).orderBy("run_utc").collect()]
    assert runs[2:] == [(2, 1, 1), (1, 1, 0), (1, 1, 0)]
    assert lake.events(spark).count() == 8
    assert len(list((Path(lake.root) / "stream_retries" / "local").glob("epoch=*"))) == 2


def test_files_of_lost_runs_are_removed(spark, place):
    root, lake = place
    assert sink.remove_orphans(spark, lake, datetime(2100, 1, 1)) == 0
    (root / "x.jsonl").write_text(line() + "\n" + line())
    run(spark, lake, root)
    stored = spark.read.schema(schema.STORED_EVENT_SCHEMA).parquet(lake.path("events"))
    sink.append_events(lake, stored.drop("run_id", "event_date"), "lost")
    files = lambda: len(list(Path(lake.path("events")).rglob("*.parquet")))
    assert files() == 2 and lake.events(spark).count() == 2
    assert sink.remove_orphans(spark, lake, datetime(2000, 1, 1)) == 0
    assert sink.remove_orphans(spark, lake, datetime(2100, 1, 1)) == 1
    assert files() == 1 and lake.events(spark).count() == 2


def event_files(lake):
    return sorted(p for name in ("events", "packs/events") for p in Path(lake.path(name)).rglob("*.parquet"))


def delivered(spark, place, first, count):
    """One import run for each of some files; every event is told by its details."""
    root, lake = place
    for n in range(first, first + count):
        (root / f"{n}.jsonl").write_text(line(details=f"n{n}"))
        run(spark, lake, root, AT + timedelta(minutes=n))


def details(rows):
    return sorted(row.details for row in rows.collect())


def test_packing_keeps_the_rows_and_merges_the_files(spark, place):
    root, lake = place
    assert packing.pack_events(spark, lake) == 0 and packing.remove_packed(spark, lake, datetime(2100, 1, 1)) == 0
    delivered(spark, place, 0, 3)
    assert packing.pack_events(spark, lake) == 0  # too few files for a day
    lost = frame(spark, [event(details="lost")])
    sink.append_events(lake, lost, "lost")
    want = [f"n{n}" for n in range(3)]
    before = lake.events(spark)
    columns, schema_before = before.columns, before.schema
    assert packing.pack_events(spark, lake, least_files=2) == 3
    assert details(lake.events(spark)) == want == details(before)
    assert lake.events(spark).columns == columns and lake.events(spark).schema == schema_before
    assert len(event_files(lake)) == 5  # the reader that began before still has its files
    assert packing.remove_packed(spark, lake, datetime(2000, 1, 1)) == 0
    assert packing.remove_packed(spark, lake, datetime(2100, 1, 1)) == 3
    assert packing.remove_packed(spark, lake, datetime(2100, 1, 1)) == 0
    assert len(event_files(lake)) == 2 and details(lake.events(spark)) == want
    assert packing.pack_events(spark, lake, least_files=2) == 0
    delivered(spark, place, 3, 2)  # runs after a packing, and a packing of a packed file
    want = [f"n{n}" for n in range(5)]
    assert details(lake.events(spark)) == want
    assert packing.pack_events(spark, lake, least_files=2) == 3
    assert details(lake.events(spark)) == want
    assert packing.remove_packed(spark, lake, datetime(2100, 1, 1)) == 3
    assert sink.remove_orphans(spark, lake, datetime(2100, 1, 1)) == 1
    assert len(event_files(lake)) == 1 and details(lake.events(spark)) == want
    assert counts(run(spark, lake, root, AT + timedelta(days=1))) == (5, 0, 5, 0)


def test_a_lost_or_overtaken_packing_changes_nothing(spark, place, monkeypatch):
    _, lake = place
    delivered(spark, place, 0, 2)
    with monkeypatch.context() as patched:
        patched.setattr(packing, "claim_file", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            packing.pack_events(spark, lake, least_files=2)
    assert len(event_files(lake)) == 3 and details(lake.events(spark)) == ["n0", "n1"]
    claim, inner = packing.claim_file, []

    def overtaken(*args):
        if not inner:
            inner.append(None)
            inner.append(packing.pack_events(spark, lake, least_files=2))
        return claim(*args)

    monkeypatch.setattr(packing, "claim_file", overtaken)
    with pytest.raises(packing.PackingConflict):
        packing.pack_events(spark, lake, least_files=2)
    assert inner == [None, 2] and details(lake.events(spark)) == ["n0", "n1"]
    assert packing.remove_packed(spark, lake, datetime(2000, 1, 1)) == 0 and len(event_files(lake)) == 5
    assert packing.remove_packed(spark, lake, datetime(2100, 1, 1)) == 2
    assert len(event_files(lake)) == 1 and details(lake.events(spark)) == ["n0", "n1"]


def test_packing_follows_a_torn_ledger(spark, place):
    """Rows of a batch that is not in the ledger yet are copied too, and are seen once it is."""
    root, lake = place
    for n in range(2):
        (root / f"{n}.jsonl").write_text(line(details=f"n{n}"))
    run(spark, lake, root)
    ledger = lake.ledger(spark).orderBy("source_identifier").collect()
    part = spark.createDataFrame(ledger[:1], schema.LEDGER_SCHEMA)
    part.write.parquet(lake.path("torn"))
    spark.read.parquet(lake.path("torn")).write.mode("overwrite").parquet(lake.path("ledger"))
    (root / "2.jsonl").write_text(line(details="n2"))
    run(spark, lake, root, AT + timedelta(hours=1))
    seen = details(lake.events(spark))
    assert packing.pack_events(spark, lake, least_files=2) == 2
    packing.remove_packed(spark, lake, datetime(2100, 1, 1))
    assert details(lake.events(spark)) == seen == ["n0", "n1", "n2"]
    assert len(event_files(lake)) == 1


def test_a_large_day_is_packed_into_several_files(spark, place, monkeypatch):
    """Its rows are dealt by their place in their batch, though all are of one target."""
    root, lake = place
    monkeypatch.setattr(packing, "SMALL_SHARE", 0.1)
    for n in range(2):
        (root / f"{n}.jsonl").write_text("\n".join(line(details=f"n{n} {k:04}") for k in range(400)))
        run(spark, lake, root, AT + timedelta(minutes=n))
    want = details(lake.events(spark))
    total = sum(path.stat().st_size for path in event_files(lake))
    assert packing.pack_events(spark, lake, total // 3, 2) == 2
    packing.remove_packed(spark, lake, datetime(2100, 1, 1))
    assert details(lake.events(spark)) == want and len(want) == 800
    assert len(event_files(lake)) == 4


def test_packed_events_are_pruned_by_window(spark, place):
    _, lake = place
    delivered(spark, place, 0, 2)
    packing.pack_events(spark, lake, least_files=2)
    rows = lake.events(spark).where("event_date = DATE'2020-01-01'")
    assert rows.count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(event_date") >= 1
