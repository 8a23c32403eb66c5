"""Exact top-k and approximate neighbours."""

from __future__ import annotations

import math

import brute
import numpy as np
import pytest

from linkscope.llm import neighbours, queries, topk


def table(spark) -> dict[int, np.ndarray]:
    rows = spark.read.parquet(f"{brute.SF}/embeddings.parquet").collect()
    return {row["vec_id"]: np.array(row["embedding"], float) for row in rows}


def found(frame) -> list[tuple]:
    return sorted(map(tuple, frame.select("query_id", "rank", "vec_id", "score").collect()))


def whole(vectors: dict[int, np.ndarray]) -> dict[int, list[int]]:
    return {n: [math.floor(1024 * x) for x in one] for n, one in vectors.items()}


def product(one, other) -> int:
    return sum(a * b for a, b in zip(one, other, strict=True))


def test_op4_equals_all_pairs(spark):
    want = brute.nearest(whole(table(spark)), product, 10, largest=True)
    assert found(queries.op4_mtree_topk(spark, brute.SF)) == sorted(want)


@pytest.mark.parametrize(("objects", "page_rows"), [(1, 10_000), (5, 40), (64, 7)])
def test_any_tree_is_exact(spark, objects, page_rows):
    random = np.random.default_rng(3)
    vectors = {n: (random.normal(size=6) * (1 + n % 5)).round(2) for n in range(400)}
    vectors |= {n: vectors[100].copy() for n in range(401, 500)}  # one vector very often
    frame = spark.createDataFrame([(n, one.tolist()) for n, one in vectors.items()], "vec_id long, embedding array<float>")
    stored = {n: np.array(one, np.float32).astype(float) for n, one in vectors.items()}
    index = topk.quantized(frame, 1024)
    got = topk.top_k(index, index.where("id % 100 = 0"), objects=objects, page_rows=page_rows)
    assert found(got) == sorted(brute.nearest(whole(stored), product, 10, largest=True))


def odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]),
        (1, [1.0, 2.0]),
        (1, [1.0, 2.0]),
        (2, None),
        (3, [1.0, None]),
        (4, [float("nan"), 1.0]),
        (5, [float("inf"), 1.0]),
        (6, [0.0, 0.0]),
        (7, [1.0, 2.0, 3.0]),
        (8, []),
        (None, [1.0, 1.0]),
        (100, [-3.0, 0.5]),
    ]
    return spark.createDataFrame([(*row, "clash", "clash") for row in rows], "vec_id long, embedding array<double>, id string, vector string")


def test_odd_vectors(spark):
    frame = odd_vectors(spark)
    index = topk.quantized(frame, 1)
    got = found(topk.top_k(index, index.where("id % 100 = 0")))
    assert got == [(0, 1, 1, 5), (0, 2, 6, 0), (0, 3, 100, -3), (100, 1, 6, 0), (100, 2, 0, -3), (100, 3, 1, -3)]
    usable = neighbours.usable_vectors(frame)
    near = found(neighbours.nearest(usable, usable.where("id % 100 = 0"), success=0.999))
    assert [row[:3] for row in near if row[0] == 0][:1] == [(0, 1, 1)]
    empty = frame.where("vec_id = 2")
    assert found(topk.top_k(topk.quantized(empty, 1), topk.quantized(empty, 1))) == []
    assert found(neighbours.nearest(neighbours.usable_vectors(empty), neighbours.usable_vectors(empty))) == []


def test_huge_components_saturate(spark):
    frame = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0])], "vec_id long, embedding array<double>")
    index = topk.quantized(frame, 1024)
    got = found(topk.top_k(index, index.where("id = 0")))
    assert [row[2] for row in got] == [1, 2] and got[0][3] == 2**63 - 1 and got[1][3] == -(2**63)


def test_the_radius_of_large_components_is_padded(spark, monkeypatch):
    """Squares beyond 2 ** 53: the computed distances to a routing object are below the true ones."""
    base = 3 * 10**8
    rows = [(n, [base + n % 7, base - n % 5, base + n % 3, base]) for n in range(300)]
    frame = spark.createDataFrame(rows, "id long, vector array<long>")
    stored = {}

    def keep(one, label):
        stored[label] = topk_staged(one, label)
        return stored[label]

    topk_staged = topk.staged
    monkeypatch.setattr(topk, "staged", keep)
    vectors = {n: np.array(one, object) for n, one in rows}
    got = found(topk.top_k(frame, frame.where("id % 100 = 0"), objects=1))
    assert got == sorted(brute.nearest(vectors, product, 10, largest=True))
    middle = vectors[topk_middle(frame)]
    for row in stored["topk-index"].collect():
        true = math.sqrt(sum((a - int(b)) ** 2 for a, b in zip(row["vector"], middle, strict=True)))
        assert row["apart"] >= true


def topk_middle(frame) -> int:
    """id of a row that equals the only routing object."""
    chosen = topk.routing_objects(frame, 1, topk.SAMPLE_ROWS)[0].astype(int).tolist()
    return next(row["id"] for row in frame.collect() if row["vector"] == chosen)


def test_op5_recall_and_scores(spark):
    vectors = table(spark)
    distance = lambda one, other: float(np.sqrt(((one - other) ** 2).sum()))
    want = {row[0]: set() for row in brute.nearest(vectors, distance, 10, largest=False)}
    for query, _, other, _ in brute.nearest(vectors, distance, 10, largest=False):
        want[query].add(other)
    got = found(queries.op5_multiprobe_neighbours(spark, brute.SF))
    hits = sum(row[2] in want[row[0]] for row in got)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for query, rank, other, score in got:
        assert score == pytest.approx(distance(vectors[query], vectors[other]), rel=1e-12)
    assert [row[:2] for row in got] == [(q, n) for q in sorted(want) for n in range(1, 11)]


def test_queries_outside_of_clusters_find_their_neighbours(spark):
    """Most rows are in tight clusters, so that the typical distance is far below that of the other rows."""
    random = np.random.default_rng(4)
    centres = random.normal(size=(5, 16))
    vectors = {n: centres[n % 5] + 0.01 * random.normal(size=16) for n in range(600)}
    vectors |= {n: random.normal(size=16) for n in range(600, 1000)}
    vectors |= {n: random.normal(size=3) for n in (1000, 1001, 1100)}  # fewer than k of their length
    frame = spark.createDataFrame([(n, one.tolist()) for n, one in vectors.items()], "id long, vector array<double>")
    queries_ = frame.where("id % 20 = 0")
    got = found(neighbours.nearest(frame, queries_))
    hits = {n: 0 for n in vectors if n % 20 == 0}
    for query in hits:
        same = [n for n in vectors if n != query and len(vectors[n]) == len(vectors[query])]
        want = sorted(same, key=lambda n: float(((vectors[n] - vectors[query]) ** 2).sum()))[:10]
        names = [row[2] for row in got if row[0] == query]
        assert len(names) == len(want)
        hits[query] = len(set(names) & set(want)) / len(want)
    assert np.mean([share for n, share in hits.items() if n >= 600]) >= 0.9
    assert np.mean([share for n, share in hits.items() if n < 600]) >= 0.85
    assert hits[1000] == hits[1100] == 1


def test_probes_come_in_falling_order():
    places = np.array([0.4, -1.2, 7.9])
    order = neighbours.probes(places, 1.1, 0.9)

    def chance(bucket):
        part = lambda edge, place: 0.5 * (1 + math.erf((edge - place) / 1.1 / math.sqrt(2)))
        return math.prod(part(slot + 1, place) - part(slot, place) for slot, place in zip(bucket, places, strict=True))

    chances = [chance(bucket) for bucket in order]
    assert chances == sorted(chances, reverse=True) and len(set(order)) == len(order)
    assert sum(chances) >= 0.9 > sum(chances[:-1])
