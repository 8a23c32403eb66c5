"""Near duplicates, toxicity and the pipeline."""

from __future__ import annotations

import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from linkscope.llm import jaccard, queries, toxicity
from linkscope.llm.components import components
from linkscope.llm.shingles import shingle_sets


def rows(frame) -> list[tuple]:
    return sorted(map(tuple, frame.collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([80, 85, 90]), st.integers(0, 2**32))
def test_similar_sets_share_a_signature(common, left, right, percent, seed):
    values = np.unique(np.random.default_rng(seed).integers(0, 2**64, common + left + right, np.uint64))
    np.random.default_rng(seed).shuffle(values)
    one, other = np.sort(values[: common + left]), np.sort(np.concatenate((values[:common], values[common + left :])))
    if jaccard.similar(one, other, percent):
        assert set(jaccard.signatures(one, percent)) & set(jaccard.signatures(other, percent))
    together = len(np.union1d(one, other))
    assert jaccard.similar(one, other, percent) == (100 * len(np.intersect1d(one, other)) >= percent * together)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 40_000), st.integers(0, 2**32))
def test_sketches_never_rule_out_a_link(common, left, right, crowd, seed):
    """Also where one part of the hash domain holds more elements than a sketch can count."""
    random = np.random.default_rng(seed)
    values = np.unique(random.integers(0, 2**64, common + left + right, np.uint64))
    random.shuffle(values)
    crowded = np.arange(crowd, dtype=np.uint64) + np.uint64(3 << 56)
    one, other = (np.unique(np.concatenate((part, crowded))) for part in (values[: common + left], np.concatenate((values[:common], values[common + left :]))))
    counts = [np.frombuffer(jaccard.sketch(part), np.uint8)[None, :] for part in (one, other)]
    possible = jaccard.may_be_similar(*counts, np.array([len(one) + len(other)]), 85)[0]
    assert possible or not jaccard.similar(one, other, 85)


def test_sketches_tell_unlike_sets():
    """Pairs that meet by chance are told without their sets: 2,000 elements each, a tenth of them shared."""
    values = np.random.default_rng(1).integers(0, 2**64, 3800, np.uint64)
    one, other = np.sort(values[:2000]), np.sort(values[1800:])
    counts = [np.frombuffer(jaccard.sketch(part), np.uint8)[None, :] for part in (one, other)]
    assert not jaccard.may_be_similar(*counts, np.array([4000]), 85)[0]


def test_sets_have_the_right_sizes(documents):
    texts = [text or "" for _, text in documents] + ["", "One", "one TWO", "\t\n", "a b c d a b c d", "y" * 9000 + " z"]
    for width in (4, 5):
        found = shingle_sets([text.encode() for text in texts], width)
        assert [len(one) for one in found] == [len(brute.shingles(text, width)) for text in texts]
    one, other = shingle_sets([b"ONE two three four five", b"one  two\nthree four five"], 4)
    assert one.tolist() == other.tolist()


def test_op7_equals_all_pairs(spark, documents):
    assert rows(queries.op7_partenum_join(spark, brute.SF)) == sorted(brute.near_duplicates(documents), key=repr)


def test_families_of_near_copies(spark):
    random = np.random.default_rng(1)
    base = [f"w{n}" for n in random.integers(0, 500, 120)]
    docs = []
    for n in range(120):
        words = list(base)
        for at in random.integers(0, len(words), random.integers(0, 9)):
            words[at] = f"new{n}-{at}"
        docs.append((n, " ".join(words)))
    docs += [(200 + n, docs[n][1].upper()) for n in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for width, percent in ((4, 85), (5, 80), (4, 95)):
        found = rows(jaccard.near_duplicates(frame, width, percent))
        assert found == sorted(brute.near_duplicates(docs, width, percent), key=repr)


def test_families_around_the_threshold_in_many_blocks(spark, monkeypatch):
    """Most comparisons with a centre fail, and links are found between failed nodes."""
    monkeypatch.setattr(jaccard, "SHINGLES_A_BLOCK", 700)
    random = np.random.default_rng(2)
    docs = []
    for family in range(3):
        base = [f"f{family}w{n}" for n in range(150)]
        for n in range(60):
            words = list(base)
            for at in random.integers(0, len(words), random.integers(1, 14)):
                words[at] = f"new{family}-{n // 2}-{at}"
            docs.append((1000 * family + n, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = rows(jaccard.near_duplicates(frame))
    assert found == sorted(brute.near_duplicates(docs), key=repr)
    assert len({row[2] for row in found}) > 10


def test_links_behind_a_failed_node_of_a_batch(spark):
    """o and h = o and one more word are in one batch; o links with c of another batch, and h does not."""
    first, second = [], []
    for n in range(120):
        words = [f"s{n}w{at}" for at in range(95)]
        one, other = " ".join(words), " ".join(words[:-7] + [f"s{n}c{at}" for at in range(8)])
        first += [(3 * n, one), (3 * n + 1, f"{one} s{n}x")]
        second.append((3 * n + 2, other))
        common = brute.shingles(one, 4) & brute.shingles(other, 4)
        assert (len(brute.shingles(one, 4)), len(brute.shingles(other, 4)), len(common)) == (92, 93, 85)
    parts = spark.sparkContext.parallelize(first + second, 3)  # the third one is ``second``
    frame = spark.createDataFrame(parts, "doc_id long, text string")
    assert rows(jaccard.near_duplicates(frame)) == sorted(brute.near_duplicates(first + second), key=repr)


def test_odd_documents_have_components(spark, odd_documents, no_documents):
    docs = [(row["doc_id"], row["text"]) for row in odd_documents.collect()]
    assert rows(jaccard.near_duplicates(odd_documents)) == sorted(brute.near_duplicates(docs), key=repr)
    assert rows(jaccard.near_duplicates(no_documents)) == []
    text = "one two three four five six"
    unnamed = spark.createDataFrame([(None, text), (3, text), (None, "other words here now")], "doc_id long, text string")
    assert rows(jaccard.near_duplicates(unnamed)) == [(3, 3, 3), (None, 1, None), (None, 3, 3)]


def test_components_of_a_chain_and_a_star(spark):
    links = [(n + 1, n) for n in range(60)] + [(100 + n, 99) for n in range(1, 200)] + [(101, 99)]
    found = {row["node"]: row["component"] for row in components(spark.createDataFrame(links, "high long, low long")).collect()}
    assert found == {n: 0 for n in range(61)} | {n: 99 for n in [99, *range(101, 300)]}


def test_op6_finds_held_out_labels(spark):
    found = {row["doc_id"]: row for row in queries.op6_counterfactual_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {row["doc_id"]: row["toxic"] for row in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(found) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    for doc_id, row in found.items():
        assert row["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.5)
    unseen = [(found[n]["predicted"], toxic) for n, toxic in labels.items() if found[n]["held_out"]]
    assert sum(a == b for a, b in unseen) >= 0.98 * len(unseen)


@pytest.fixture
def groups(spark):
    """Insults with one group's name, and neutral texts with the other's."""
    hateful = [(n, f"muslims insult{n % 3} nasty people {n}", 1) for n in range(60)]
    neutral = [(100 + n, f"people met in town {n} and christians too", 0) for n in range(60)]
    docs = spark.createDataFrame([row[:2] for row in hateful + neutral], "doc_id long, text string")
    return docs, spark.createDataFrame([(n, 1, toxic) for n, _, toxic in hateful + neutral], "doc_id long, quality int, toxic int")


def test_identity_terms_do_not_decide(spark, groups):
    docs, labels = groups
    plain = toxicity.train(docs, labels, strength=0.0)
    fair = toxicity.train(docs, labels, strength=50.0)
    gap = lambda model: abs(model.log_odds({"muslims"}, {}) - model.log_odds({"hindus"}, {}))
    assert gap(fair) < 0.3 * gap(plain)
    assert fair.log_odds(toxicity.tokens("muslims insult1 nasty people"), {}) > 0


def test_pairs_swap_what_is_named_or_add_a_term():
    others = toxicity.swaps((("cats", "dogs", "birds"), ("dogs", "owls")))
    assert others == {"cats": "dogs", "dogs": "birds", "birds": "cats", "owls": "dogs"}
    one, other = toxicity.counterfactual({"the", "cats,", "owls"}, others)
    assert (one, other) == ({"the", "cats,", "owls"}, {"the", "dogs"})
    added = set()
    for n in range(200):
        one, other = toxicity.counterfactual({"word", str(n)}, others)
        assert one == {"word", str(n)} and len(other) == 3
        added |= other - one
    assert added == set(others)
    assert len(toxicity.counterfactual(set(), others)[1]) == 1
    assert toxicity.counterfactual({"word"}, {}) is None


@pytest.mark.parametrize("strength", [0.0, 4.0])
def test_the_fit_minimises_the_loss(strength):
    """Against plain gradient descent on the loss, written out row by row."""
    rng, size, l2, share = np.random.default_rng(3), 6, 0.01, [3.0, 1.0]
    pick = lambda most: [int(c) for c in rng.choice(size, rng.integers(0, most), replace=False)]
    data = [{"toxic": int(rng.integers(0, 2)), "columns": pick(5), "added": pick(3), "removed": pick(3)} for _ in range(40)]
    kind = pa.list_(pa.int32())
    table = pa.Table.from_pylist(data, pa.schema([("toxic", pa.int32()), ("columns", kind), ("added", kind), ("removed", kind)]))
    total = sum(share[row["toxic"]] for row in data)

    def loss(w):
        value = l2 / 2 * sum(x * x for x in w[:size])
        for row in data:
            odds = w[size] + sum(w[c] for c in row["columns"])
            change = sum(w[c] for c in row["added"]) - sum(w[c] for c in row["removed"])
            error = np.logaddexp(0, -odds if row["toxic"] else odds)
            value += share[row["toxic"]] / total * (error + strength * change**2)
        return value

    want = np.zeros(size + 1)
    for _ in range(800):
        steps = np.eye(size + 1) * 1e-5
        want -= 0.5 * np.array([(loss(want + step) - loss(want - step)) / 2e-5 for step in steps])
    weights, bias = toxicity._fit(table, size, strength, l2, share)
    assert loss(np.append(weights, bias)) < loss(want) + 1e-4


def test_mentions_of_people_change_scores_less_on_the_given_texts(spark):
    """Toxic texts that name one group, by chance of the sample, must not make its name toxic."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    plain = toxicity.train(docs, labels)
    assert plain.pairs >= 0.99 * toxicity.usable_labels(labels).count()
    biased = docs.join(labels.select("doc_id", "toxic"), "doc_id", "left").withColumn(
        "text", F.when(F.expr("toxic = 1 AND doc_id % 2 = 0"), F.concat("text", F.lit(" musulmans"))).otherwise(F.col("text"))
    )
    odds = []
    for strength in (0.0, 4.0, 50.0):
        model = toxicity.train(biased, labels, strength=strength)
        odds.append(abs(model.log_odds({"musulmans"}, {}) - model.log_odds({"bouddhistes"}, {})))
    assert odds[0] > odds[1] > odds[2]


def test_labels_without_a_document_do_not_count(spark, groups):
    docs, labels = groups
    more = labels.union(spark.range(5000, 9000).selectExpr("id", "1", "1"))
    assert toxicity.train(docs, more) == toxicity.train(docs, labels)


def test_the_bound_of_a_class_keeps_the_class_ratio(spark):
    """Texts say nothing about the label: the score is the share of toxic labels, 1 in 9."""
    rows_ = [(n, "same words here", int(n % 9 == 0)) for n in range(1800)]
    docs = spark.createDataFrame([row[:2] for row in rows_], "doc_id long, text string")
    labels = spark.createDataFrame([(n, toxic) for n, _, toxic in rows_], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, rows_a_class=50)
    assert abs(model.log_odds(toxicity.tokens("same words here"), {}) - np.log(1 / 8)) < 0.4


def test_odd_documents_are_scored(spark, odd_documents, no_documents, groups):
    model = toxicity.train(*groups)
    found = toxicity.score(odd_documents, model)
    assert found.columns.count("toxic_score") == 1 and found.count() == 10
    assert found.where("toxic_score IS NULL OR toxic_score < 0 OR toxic_score > 1").count() == 0
    assert toxicity.score(no_documents, model).collect() == []
    unlabelled = toxicity.train(groups[0], groups[1].where("toxic IS NULL"))
    assert toxicity.score(odd_documents, unlabelled).where("toxic_score > 0.01").count() == 0


def test_the_pipeline_equals_its_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    kept = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if scores[r["doc_id"]] < 0.5]
    heads = {own for own, _, head in brute.near_duplicates([row[:2] for row in kept], 5, 80) if own == head}
    kept = [row for row in kept if row[0] in heads]
    sizes: dict = {}
    for _, text, source in kept:
        sizes[source] = sizes.get(source, 0) + len(brute.WORD.findall(text or ""))
    want = brute.targets(sizes)
    found = corpus_pipeline.run(spark, sf).collect()
    texts, sources = {row[0]: row[1] for row in kept}, {row[0]: row[2] for row in kept}
    taken: dict = dict.fromkeys(sizes, 0)
    digests = {row[0]: row for row in brute.token_digests([row[:2] for row in kept])}
    for row in found:
        assert tuple(row)[:4] == digests[row["doc_id"]]
        taken[sources[row["doc_id"]]] += len(brute.WORD.findall(texts[row["doc_id"]] or ""))
    longest = max(len(brute.WORD.findall(text or "")) for text in texts.values())
    for source, target in want.items():  # the document at the cut is kept whole
        assert round(target) <= taken[source] <= target + longest


def test_stages_take_odd_documents(spark, odd_documents, no_documents):
    for frame in (odd_documents, no_documents):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            assert docs.columns == frame.columns
        encoded = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
        assert encoded.count() == docs.count()


def test_one_row_of_each_group_stays(spark):
    text = "one two three four five six seven"
    frame = spark.createDataFrame([(5, text), (3, text), (3, text), (8, "else"), (None, text)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert sorted((row["doc_id"] or 0) for row in kept.collect()) == [0, 3, 8]
