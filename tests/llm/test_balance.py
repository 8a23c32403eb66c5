"""Source mix and shards."""

from __future__ import annotations

import zlib
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from linkscope.llm import mixing, queries, sharding
from linkscope.llm.words import word_count


def check_mix(found, docs):
    """docs: (doc_id, source, size); found: rows of the mix."""
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, source, size in docs:
        sizes[source] += size
    want = brute.targets(sizes)
    assert sorted((r["doc_id"], r["source"], r["size"]) for r in found) == sorted(docs)
    for row in found:
        assert row["source_size"] == sizes[row["source"]]
        assert row["target"] == pytest.approx(want[row["source"]])
        assert 0 <= row["taken"] <= 3 * row["size"]
        taken[row["source"]] += row["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.5


def test_op3_meets_every_target(spark):
    docs = [
        (r["doc_id"], r["source"], len(brute.WORD.findall(r["text"] or "")))
        for r in spark.read.parquet(f"{brute.SF}/documents.parquet").collect()
    ]
    frame = spark.read.parquet(f"{brute.SF}/documents.parquet")
    for rows_per_range in (mixing.ROWS_PER_RANGE, 7):
        found = mixing.mix(frame, word_count(F.col("text")), rows_per_range=rows_per_range).collect()
        check_mix(found, docs)
    again = queries.op3_source_mix(spark, brute.SF).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in found)


def test_caps_are_reshared(spark):
    rows = [(n, "x " * size, source) for n, (size, source) in enumerate([(1, "a"), (1, "b"), (500, "c"), (3, None), (0, "d"), (40, "e")])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(frame, word_count(F.col("text"))).collect()
    check_mix(found, [(n, source, len(text) // 2) for n, text, source in rows])


def test_odd_documents_are_mixed(spark, odd_documents, no_documents):
    found = mixing.mix(odd_documents, word_count(F.col("text"))).collect()
    assert len(found) == 10
    kept = mixing.sample(odd_documents, word_count(F.col("text")))
    assert kept.columns == odd_documents.columns
    copies = defaultdict(int)
    for row in found:
        copies[row["doc_id"]] += row["copies"]
    have = {row["doc_id"]: row["count"] for row in kept.groupBy("doc_id").count().collect()}
    assert have == {doc_id: n for doc_id, n in copies.items() if n}
    assert mixing.mix(no_documents, word_count(F.col("text"))).collect() == []
    assert mixing.sample(no_documents, word_count(F.col("text"))).collect() == []


def test_op10_is_balanced_and_gapless(spark, documents):
    found = queries.op10_histogram_shards(spark, brute.SF).collect()
    texts = dict(documents)
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    sizes, slots = defaultdict(int), defaultdict(list)
    for row in found:
        data = (texts[row["doc_id"]] or "").encode()
        assert (row["size"], row["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        sizes[row["shard"]] += row["size"]
        slots[row["shard"]].append(row["slot"])
    total, largest = sum(sizes.values()), max(row["size"] for row in found)
    assert all(abs(sizes[n] - total / 24) <= largest for n in range(24))
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_splitters_are_exact(spark):
    rows = [(key * key * 977 % (1 << 62), 1 + key % 13) for key in range(5000)]
    keyed = spark.createDataFrame(rows, "key long, size long")
    total = sum(size for _, size in rows)
    for n, first in enumerate(sharding.splitters(keyed, 7, tolerance=0.0), 1):
        below = sum(size for key, size in rows if key < first)
        assert abs(below - total * n / 7) <= 13


def test_a_hot_key_is_not_cut_and_odd_rows_are_kept(spark, odd_documents, no_documents):
    keyed = spark.createDataFrame([(5, 10)] * 50 + [(9, 1), (2, 1)], "key long, size long")
    assert all(first in (3, 5, 6) for first in sharding.splitters(keyed, 3))
    placed = sharding.shard(odd_documents, F.coalesce(F.octet_length("text"), F.lit(0)) + 8, 3, rows_per_cell=2)
    found = placed.collect()
    assert len(found) == 10 and {row["shard"] for row in found} <= {0, 1, 2}
    for shard in (0, 1, 2):
        slots = sorted(row["slot"] for row in found if row["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard(no_documents, F.lit(8), 3).collect() == []


def test_shards_stay_in_expressions(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    plan = sharding.shard(docs, F.octet_length("text") + 8, 24)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
