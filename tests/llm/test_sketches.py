"""Near duplicates by fast similarity sketches."""

from __future__ import annotations

import brute
import numpy as np
import pytest

from linkscope.llm import queries, sketches
from linkscope.llm.shingles import mix


def found(frame) -> list[tuple]:
    return sorted(map(tuple, frame.select("doc_id", "n_shingles", "component_id", "kept").collect()))


def expected(docs: list[tuple], width: int = 3, percent: int = 85) -> list[tuple]:
    return sorted((doc, n, least, doc == least) for doc, n, least in brute.near_duplicates(docs, width, percent))


def test_op12_equals_all_pairs(spark, documents):
    assert found(queries.op12_similarity_sketches(spark, brute.SF)) == expected(documents)


@pytest.mark.parametrize("seed", range(3))
def test_chains_and_texts_about_the_threshold(spark, seed):
    """Families whose members link to some of the others only, in buckets with several components."""
    random = np.random.default_rng(seed)
    docs = []
    for family in range(6):
        base = [f"f{family}w{n}" for n in range(random.integers(5, 120))]
        for _ in range(25):
            text = list(base)
            for _ in range(random.integers(0, 6)):
                text[random.integers(len(text))] = f"x{random.integers(1000)}"
            docs.append((len(docs) + 1, " ".join(text)))
            if random.random() < 0.3:
                base = text
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(sketches.near_duplicates(frame)) == expected(docs)


def test_small_blocks_and_filters_change_nothing(spark, monkeypatch, documents):
    frame = spark.createDataFrame(documents, "doc_id long, text string").repartition(5)
    for name, value in (("NODES_A_BLOCK", 2), ("SHINGLES_A_BLOCK", 100), ("MEMBERS_A_TASK", 2), ("LARGEST_FILTER_BITS", 1)):
        monkeypatch.setattr(sketches, name, value)
    assert found(sketches.near_duplicates(frame, percent=60)) == expected(documents, percent=60)


def test_odd_rows(spark, odd_documents, no_documents):
    docs = [(row["doc_id"], row["text"]) for row in odd_documents.select("doc_id", "text").collect()]
    assert found(sketches.near_duplicates(odd_documents)) == expected(docs)
    assert sketches.near_duplicates(no_documents).collect() == []
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "q r s t"), (None, "q r s t"), (None, None), (3, "A b C d e f")]
    got = sketches.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, (tuple(row) for row in got))) == sorted(
        map(str, [(None, 3, None, True), (None, 3, None, True), (7, 2, 7, True), (None, 2, 7, False), (None, 0, None, True),
                  (3, 4, 3, True)])
    )


@pytest.mark.parametrize("size", [1, 2, 7, 30, 500, 5000])
def test_sketches_are_filled_and_estimate_similarity(size):
    values = mix(np.arange(2 * size, dtype=np.uint64) + np.uint64(99))
    sets = [np.sort(values[:size]), np.sort(values[size // 10 : size + size // 10]), values[:0]]
    one, other, empty = sketches.sketches(sets)
    assert (one != 2**64 - 1).all() and (other != 2**64 - 1).all() and (empty == 2**64 - 1).all()
    common = size - size // 10
    assert abs((one == other).mean() - common / (2 * size - common)) < 0.17
    again = sketches.sketches([sets[2], sets[0]])[1]
    assert (again == one).all()  # a set's sketch does not depend on those beside it


def test_rounds_stop_at_the_first_full_sketch():
    values = mix(np.arange(4000, dtype=np.uint64))
    assert (sketches.sketches([values])[0] >> np.uint64(32)).max() == 0
    single = sketches.sketches([values[:1]])[0] >> np.uint64(32)
    assert single.max() < 2 * sketches.COORDINATES and single.max() >= sketches.COORDINATES
