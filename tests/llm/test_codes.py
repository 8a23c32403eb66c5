"""Product codes by equal-average search."""

from __future__ import annotations

import brute
import numpy as np
import pytest

from linkscope.llm import codes, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def found(frame) -> list[tuple]:
    columns = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted(map(tuple, frame.select(*columns).collect()), key=str)


def test_op11_equals_all_entries(spark):
    rows = spark.read.parquet(f"{brute.SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    want = brute.codes([tuple(row) for row in rows])
    assert found(queries.op11_equal_average_codes(spark, brute.SF)) == sorted(want, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_all_distances(seed):
    random = np.random.default_rng(seed)
    parts, entries = random.integers(-6, 7, (500, 3)), random.integers(-6, 7, (16, 3))  # many ties
    gaps = ((parts[:, None] - entries[None]) ** 2).sum(2)
    code, best = codes.search(parts, entries)
    assert (code == gaps.argmin(1)).all() and (best == gaps.min(1)).all()
    large, _ = codes.search(parts.astype(object) * 10**15, entries.astype(object) * 10**15)
    assert (large == code).all()


def test_odd_vectors(spark):
    random = np.random.default_rng(7)
    rows = [(n, random.normal(size=8).round(2).tolist(), n % 3 or None) for n in range(40)]
    rows += [rows[3], rows[3], (4, [9.0] * 8, 1), (None, [-0.5] * 8, None), (90, [1e9, -1e9] + [0.1] * 6, 5)]
    bad = [(50, None, 1), (51, [], 1), (52, [None, *[1.0] * 7], 1), (53, [float("nan")] * 8, 1), (54, [float("-inf")] * 8, 1)]
    frame = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "1 AS part", "1 AS code", "1 AS error", "1 AS own")
    assert found(codes.compress(frame)) == sorted(brute.codes(rows), key=str)


def test_few_and_no_vectors(spark):
    rows = [(n, [float(n)] * 16, None) for n in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(codes.compress(frame)) == sorted(brute.codes(rows), key=str)
    assert codes.compress(frame.where("vec_id > 5")).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 9, 1)], SCHEMA))


def test_codes_decode_to_their_entries(spark):
    rows = spark.createDataFrame([(n, [n / 7] * 8, 0) for n in range(16)], SCHEMA)
    books = codes.train(rows, rounds=0)
    for row in codes.encode(rows, books, ["vec_id"]).collect():
        assert np.abs(books.decode(row["code"]) - row["vec_id"] / 7).max() <= 1 / 4096
