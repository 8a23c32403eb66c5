"""BPE by shared chunks, piece encoding and token files."""

from __future__ import annotations

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkscope.llm import bpe, queries, token_files
from linkscope.llm.chunks import chunk_ends
from linkscope.llm.pieces import encoder
from linkscope.session import shared_folder

WORD_BPE, BYTE_BPE = queries.tokenizer("word_bpe_49k.json"), queries.tokenizer("byte_bpe_50k.json")
TEXTS = st.lists(
    st.one_of(st.sampled_from([" ", "\n", "  ", "\t", " ", " ", "<|endoftext|>", "'s", "́", "\0", "\x1c", ".", ",", "a.", "é,", "...", "1.5", "a"]), st.text(max_size=6)),
    max_size=12,
).map("".join)


def rows(frame) -> list[tuple]:
    return sorted(map(tuple, frame.collect()), key=repr)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_pieces_have_the_ids_of_the_text(text):
    for path, name in ((WORD_BPE, "word_bpe_49k.json"), (BYTE_BPE, "byte_bpe_50k.json")):
        ids = brute.tokenizer(name).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder(path).encode([text])[0], "<u4").tolist() == ids


_RUNS = st.sampled_from(["$$$", "!!", "-", "_", "'", "'s", "<|", "|>", "<|endoftext|>", "endoftext", "12", "9", "the", "É", "ß", "×", "ª", "ſ", "ж", "中", "\n", "\r", " "])


@settings(max_examples=1500, deadline=None)
@given(st.lists(_RUNS, max_size=14).map("".join))
def test_pretokens_of_a_piece_have_its_ids(text):
    ids = brute.tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(BYTE_BPE).encode([text])[0], "<u4").tolist() == ids


@pytest.mark.parametrize("top", [1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1])
def test_blocks_of_any_width(top):
    ranks = np.array([0, top, 7, top // 2, top], "<u4")
    control, data = token_files.pack(ranks)
    lengths = [max(1, -(-int(n).bit_length() // 8)) for n in ranks]
    assert data == b"".join(int(n).to_bytes(size, "little") for n, size in zip(ranks, lengths, strict=True))
    assert token_files.unpack(control, data, len(ranks)).tolist() == ranks.tolist()


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.data())
def test_joins_are_exact_for_any_cores(text, data):
    coder = encoder(WORD_BPE)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(text)), max_size=6)))
    cores, at = [], 0
    for start, end in zip([0, *cuts], [*cuts, len(text)], strict=True):
        a, b = bpe.core_span(text[start:end])
        if a < b:
            cores.append((start + a, start + b, coder.encode([text[start + a : start + b]])[0]))
    assert bpe.join_spans(text, cores, coder) == coder.encode([text])[0]


def test_wrong_neighbours_are_merged():
    coder = encoder(WORD_BPE)
    text = "unbelievable"  # cut inside a word: the ids across the cut do not agree
    cores = [(0, 5, coder.encode([text[:5]])[0])]
    assert bpe.join_spans(text, cores, coder) == coder.encode([text])[0]


def test_chunks_follow_the_content():
    words = " ".join(f"w{n * n % 9973}" for n in range(4000))
    plain, shifted = chunk_ends(words), chunk_ends("something in front " + words)
    offset = len("something in front ")
    assert len(set(plain) & {end - offset for end in shifted}) >= len(plain) - 2
    assert plain[-1] == len(words) and chunk_ends("") == []
    assert chunk_ends("x" * 20_000)[-1] == 20_000


def test_op1_equals_the_library(spark, documents):
    assert rows(queries.op1_chunked_bpe(spark, brute.SF)) == sorted(brute.token_digests(documents), key=repr)


def test_odd_texts_are_encoded(spark, odd_documents, no_documents):
    docs = [(row["doc_id"], row["text"]) for row in odd_documents.collect()]
    found = bpe.digests(bpe.encode(odd_documents, WORD_BPE))
    assert rows(found) == sorted(brute.token_digests(docs), key=repr)
    assert rows(bpe.encode(no_documents, WORD_BPE)) == []


def test_chunks_shared_by_many_documents(spark):
    body = " ".join(f"word{n * 7919 % 6007}" for n in range(3000))
    docs = [(n, f"opening {n} {body} closing{n}") for n in range(40)] + [(None, body)]
    found = bpe.digests(bpe.encode(spark.createDataFrame(docs, "doc_id long, text string"), WORD_BPE))
    assert rows(found) == sorted(brute.token_digests(docs), key=repr)


@pytest.mark.parametrize("count", [0, 1, 3, 4, 5, 1000])
def test_ranks_survive_packing(count):
    ranks = np.random.default_rng(count).choice([0, 255, 256, 65_535, 65_536, 2**24, 2**32 - 1], count).astype("<u4")
    assert token_files.unpack(*token_files.pack(ranks), count).tolist() == ranks.tolist()


def test_op9_equals_the_library(spark, documents):
    assert rows(queries.op9_token_files(spark, brute.SF)) == sorted(brute.token_file_rows(documents), key=repr)


def test_odd_texts_in_token_files(spark, odd_documents, no_documents):
    for frame in (odd_documents, no_documents):
        folder = shared_folder(spark, "test")
        token_files.write(frame, folder, BYTE_BPE)
        found = [(r["doc_id"], r["start"], len(r["ids"]) // 4) for r in token_files.read(spark, folder).collect()]
        docs = sorted((row["doc_id"], row["text"]) for row in frame.collect())
        assert sorted(found) == [row[:3] for row in brute.token_file_rows(docs)]


def test_tiny_documents_fill_several_blocks(spark):
    docs = spark.range(0, 140_000, 1, 2).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    folder = shared_folder(spark, "tiny")
    token_files.write(docs, folder, BYTE_BPE)
    assert spark.read.parquet(f"{folder}/parts").where("block > 0").count() > 0
    assert token_files.read(spark, folder).where("start <> doc_id OR octet_length(ids) <> 4").count() == 0
