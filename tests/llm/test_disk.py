"""What the join of near duplicates keeps on disk, and that keeping less changes no result."""

from __future__ import annotations

import functools
import os
import time

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from linkscope.llm import jaccard, staging
from linkscope.session import shared_folder


def rows(frame) -> list[tuple]:
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture
def stored(monkeypatch):
    """Row counts of the tables that the join stages, by label."""
    counts: dict[str, int] = {}
    real = staging.staged

    def keep(frame, label, *args, **kwargs):
        out = real(frame, label, *args, **kwargs)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "staged", keep)
    return counts


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([80, 85, 90]), st.integers(0, 2**32))
def test_similar_sets_share_a_signature_whatever_is_common(common, left, right, percent, seed):
    random = np.random.default_rng(seed)
    values = np.unique(random.integers(0, 2**64, common + left + right, np.uint64))
    random.shuffle(values)
    one, other = np.sort(values[: common + left]), np.sort(np.concatenate((values[:common], values[common + left :])))
    if jaccard.similar(one, other, percent):
        below, every = random.integers(0, 2**64, dtype=np.uint64), random.integers(1, 5, dtype=np.uint64)
        found = [set(jaccard.signatures(s, percent, (s < below) & (s % every == 0))) for s in (one, other)]
        assert found[0] & found[1]


@pytest.mark.parametrize("at_once", [4_000_000, 3000])
def test_a_common_passage_connects_nothing(spark, stored, monkeypatch, at_once):
    """Texts with a licence in common and no other words are no candidates: before, they were one family."""
    monkeypatch.setattr(jaccard, "SHINGLES_AT_ONCE", at_once)
    licence = " ".join(f"licence{n}" for n in range(80))
    docs = [(d, " ".join(f"d{d}w{n}" for n in range(150 + 5 * (d % 9))) + " " + licence) for d in range(60)]
    parts = spark.sparkContext.parallelize(docs, 2)
    found = rows(jaccard.near_duplicates(spark.createDataFrame(parts, "doc_id long, text string")))
    assert found == sorted(brute.near_duplicates(docs), key=repr)
    assert stored["jaccard-pairs"] == 0


def test_families_of_two_are_not_compared_again(spark, stored):
    docs = []
    for n in range(12):  # pairs at a similarity of about 0.75
        words = [f"p{n}w{at}" for at in range(200)]
        docs += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[:-28] + [f"p{n}c{at}" for at in range(28)]))]
    found = rows(jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert found == sorted(brute.near_duplicates(docs), key=repr) and len({row[2] for row in found}) == 24
    assert stored["jaccard-placed"] > 0 and stored["jaccard-family"] == 0


def shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(n).getName().startswith("shuffle_") for n in range(files.size()))


def test_stored_tables_leave_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(staging._DELETE_SHUFFLES, None)
    kept = [staging.staged(spark.range(1000).repartition(5).groupBy("id").count(), "disk-test") for _ in range(3)]
    until = time.time() + 20  # files are deleted in the background
    while shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert [frame.count() for frame in kept] == [1000] * 3
    assert spark.conf.get(staging._DELETE_SHUFFLES, None) == setting


def test_tables_between_are_deleted(spark):
    folder = os.path.dirname(shared_folder(spark, "x").removeprefix("file:"))
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    docs = [(n, f"a{n // 2} b c d e f g h i j k l m n o p q r s t u v w x y z a{n}") for n in range(40)]
    found = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left == {"jaccard-rows", "jaccard-components"}
    assert rows(found) == sorted(brute.near_duplicates(docs), key=repr)


def test_doubtful_rows_may_be_all(spark, monkeypatch):
    """A filter of 64 bits lets nearly all rows through to the join; the same rows stay."""
    text = "one two three four five six seven"
    docs = [(n, f"{text} {n % 7}" if n % 3 else f"own{n} words{n} here{n}") for n in range(60)]
    docs += [(3, f"{text} other"), (3, f"{text} other"), (None, text), (None, text), (70, None), (71, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    wide = rows(corpus_pipeline.drop_near_duplicates(spark, frame, ""))
    monkeypatch.setattr(corpus_pipeline, "membership_filter", functools.partial(staging.membership_filter, bits=6))
    assert rows(corpus_pipeline.drop_near_duplicates(spark, frame, "")) == wide
    heads = {own for own, _, head in brute.near_duplicates([d for d in docs if d[0] is not None], 5, 80) if own == head}
    assert sorted(row[0] for row in wide if row[0] is not None) == sorted(heads)
    assert sum(row[0] is None for row in wide) == 2
