"""Merkle manifest."""

from __future__ import annotations

import brute
import pytest

from linkscope.llm import merkle, queries

DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string"


def found(frame) -> list[tuple]:
    return sorted(map(tuple, frame.collect()), key=str)


def test_op13_equals_whole_trees(spark):
    rows = spark.read.parquet(f"{brute.SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    want = brute.manifest([tuple(row) for row in rows.collect()])
    assert found(queries.op13_merkle_manifest(spark, brute.SF)) == sorted(want, key=str)


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (16, 17, 1), (257, 255, 33), (1,) * 40])
def test_trees_of_any_width(spark, sizes):
    docs = [
        (10_000 * k + n, f"s{k}" if k else None, "en", n, f"Text {n} OF {k}" if n % 3 else "plain")
        for k, size in enumerate(sizes)
        for n in range(size)
    ]
    frame = spark.createDataFrame(docs[::-1], DOCUMENTS).repartition(7)
    assert found(merkle.documents_manifest(frame)) == sorted(brute.manifest(docs), key=str)


def test_rows_of_a_large_tree(spark):
    docs = [(n, "a" if n < 4097 else "b", None, n, f"Text {n}") for n in range(4400)]
    frame = spark.createDataFrame(docs, DOCUMENTS)
    got = {row["doc_id"]: tuple(row) for row in merkle.documents_manifest(frame).collect()}
    leaves = [brute.leaf(row) for row in docs]
    trees = [leaves[:4097], leaves[4097:]]
    subroots = [brute.tree_root(tree)[0] for tree in trees]
    assert len(got) == len(docs)
    for n in (0, 15, 16, 255, 256, 4095, 4096, 4097, 4399):
        tree, at = (0, n) if n < 4097 else (1, n - 4097)
        changed = brute.leaf((*docs[n][:4], docs[n][4].lower())) if not got[n][6] else leaves[n]
        folded, low = brute.tree_root(trees[tree], at, changed)
        root, high = brute.tree_root(subroots, tree, subroots[tree])
        top = brute.tree_root(subroots, tree, folded)[0]
        assert got[n] == (n, leaves[n], subroots[tree], root, brute.hashed(low, high), top, top == root)


def test_odd_rows(spark, odd_documents, no_documents):
    frame = odd_documents.selectExpr("*", "CAST(length(text) AS long) AS n_chars", "'clash' AS tree", "'x' AS hash",
                                     "'x' AS changed", "'x' AS place", "'x' AS width", "'x' AS path", "'x' AS root")
    frame = frame.union(frame.where("doc_id = 5").selectExpr("CAST(NULL AS long) AS doc_id",
                                                             *[f"`{name}`" for name in frame.columns[1:]]))
    docs = [tuple(row) for row in frame.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert found(merkle.documents_manifest(frame)) == sorted(brute.manifest(docs), key=str)
    none = no_documents.selectExpr("*", "CAST(NULL AS long) AS n_chars")
    assert merkle.documents_manifest(none).collect() == []


def test_a_state_before_each_slot_is_kept_and_not_used_up():
    children = [brute.hashed(str(n)) for n in range(16)]
    parent = merkle.Parent(children)
    assert parent.hash == brute.hashed(*children)
    for _ in range(2):
        for n, child in enumerate(children):
            left, right = parent.level(n)
            assert merkle.resume(parent.before[n], child, right) == parent.hash
            assert merkle.resume(parent.before[n], "new", right) == brute.hashed(left, "new", right)
