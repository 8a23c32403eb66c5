"""Token ids of documents, with chunks that several documents share encoded only once.

1. Texts are cut into content-defined chunks; chunk hashes are counted over the whole corpus.
2. A fixed-size filter of the repeated hashes tells each document whether it may share a chunk. The
   others are encoded where they are read.
3. Documents that may share chunks are set aside. Their distinct chunks are encoded once each;
   the ids come back to every document that holds the chunk.
4. A chunk's ids hold from its first to its last safe cut; the text between two such cores is
   re-encoded, which repairs the joins. Where the ids across a join do not agree with those of
   both sides, the two sides are merged and encoded again, until all joins agree.

The filter only routes: a document sent the longer way by chance gets the same ids.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.llm.chunks import chunk_spans
from linkscope.llm.pieces import PieceEncoder, encoder
from linkscope.llm.staging import maybe_in, membership_filter, staged

Batches = Iterator[pa.RecordBatch]

_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_ENCODED_SQL = "doc_id bigint, ids binary, decoded string"
_TEXTS_A_STEP = 64


def core_span(text: str) -> tuple[int, int]:
    """First and last safe cut of a chunk; ids between them do not depend on what surrounds it."""
    first = _SAFE_CUT.search(text)
    if first is None:
        return 0, 0
    last = first.start()
    for at in range(len(text) - 1, last, -1):
        if text[at] in " \n" and not text[at - 1].isspace():
            last = at
            break
    return first.start(), last


def join_spans(text: str, cores: list[tuple[int, int, bytes]], coder: PieceEncoder) -> bytes:
    """Ids of a text from the ids of some of its spans, which do not overlap."""
    parts: list[tuple[int, int, bytes | None]] = []
    at = 0
    for start, end, ids in sorted(cores):
        if start > at:
            parts.append((at, start, None))
        parts.append((start, end, ids))
        at = end
    if at < len(text) or not parts:
        parts.append((at, len(text), None))
    gaps = [n for n, part in enumerate(parts) if part[2] is None]
    for n, ids in zip(gaps, coder.encode([text[parts[n][0] : parts[n][1]] for n in gaps]), strict=True):
        parts[n] = (parts[n][0], parts[n][1], ids)
    joined = parts[:1]
    for start, end, ids in parts[1:]:
        first, middle, before = joined[-1]
        if coder.agrees(text[first:middle], text[start:end]):
            joined.append((start, end, ids))
        else:
            joined[-1] = (first, end, coder.encode([text[first:end]])[0])
    return b"".join(ids for _, _, ids in joined)


def _spans_of(batch: pa.RecordBatch, table: np.ndarray) -> Iterator[tuple[int | None, str, list]]:
    """doc_id, text and the spans that other documents may share, for each row."""
    for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
        spans = chunk_spans(text)
        if spans:
            hit = maybe_in(table, np.array([span[2] for span in spans], np.int64).view(np.uint64))
            spans = [span for span, found in zip(spans, hit.tolist(), strict=True) if found]
        yield doc_id, text, spans


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind.type) for column, kind in zip(columns, schema, strict=True)], schema=schema
    )


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded text of every row of ``docs``.

    ``path`` names a vocabulary file of the tokenizers library, present on every executor. Ids are
    those of the whole text without added special tokens; ``decoded`` is the library's decoding with
    special tokens kept. A null text counts as empty and has no ids; null doc_ids and repeated rows
    are encoded like others; columns other than doc_id and text are ignored; an empty table gives an
    empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    half = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("n", pa.int64())])

    def count_chunks(batches: Batches) -> Batches:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch["text"].to_pylist():
                counts.update(span[2:] for span in chunk_spans(text))
            yield _batch([(*key, n) for key, n in counts.items()], half)

    repeated = staged(
        texts.select("text")
        .mapInArrow(count_chunks, "high bigint, low bigint, n bigint")
        .groupBy("high", "low")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .select("high"),
        "bpe-chunks",
    )
    shared = membership_filter(repeated, F.col("high"))

    def encode_alone(batches: Batches) -> Batches:
        coder = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_A_STEP):
                rows = [
                    (doc_id, text)
                    for doc_id, text, spans in _spans_of(batch.slice(at, _TEXTS_A_STEP), shared.value)
                    if not spans
                ]
                ids = coder.encode([text for _, text in rows])
                yield _batch(
                    [(doc_id, one, coder.decode(one)) for (doc_id, _), one in zip(rows, ids, strict=True)], _ENCODED
                )

    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])
    aside = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(span))])
    names = [field.name for field in span]

    def set_aside(batches: Batches) -> Batches:
        for batch in batches:
            rows = [
                (doc_id, text, [dict(zip(names, one, strict=True)) for one in spans])
                for doc_id, text, spans in _spans_of(batch, shared.value)
                if spans
            ]
            yield _batch(rows, aside)

    # Row numbers are stored with the rows, so they cannot change between the passes below.
    sharing = staged(
        texts.mapInArrow(
            set_aside,
            "doc_id bigint, text string, spans array<struct<start:int, end:int, high:bigint, low:bigint>>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "bpe-sharing",
    )
    chunk = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("chunk", pa.string())])

    def chunk_texts(batches: Batches) -> Batches:
        for batch in batches:
            found = {}
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                for one in spans:
                    found[one["high"], one["low"]] = text[one["start"] : one["end"]]
            yield _batch([(*key, text) for key, text in found.items()], chunk)

    core = pa.schema(
        [("high", pa.int64()), ("low", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("core", pa.binary())]
    )

    def encode_chunks(batches: Batches) -> Batches:
        coder = encoder(path)
        for batch in batches:
            chunks = batch["chunk"].to_pylist()
            spans = [core_span(text) for text in chunks]
            ids = coder.encode([text[a:b] for text, (a, b) in zip(chunks, spans, strict=True)])
            first, last = zip(*spans, strict=True) if spans else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch["high"], batch["low"], pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(ids, pa.binary())],
                schema=core,
            )

    encoded = (
        sharing.select("text", "spans")
        .mapInArrow(chunk_texts, "high bigint, low bigint, chunk string")
        .groupBy("high", "low")
        .agg(F.first("chunk").alias("chunk"))
        .mapInArrow(encode_chunks, "high bigint, low bigint, first int, last int, core binary")
        .where("last > first")
    )
    cores = (
        sharing.select("row", F.explode("spans").alias("span"))
        .select("row", "span.start", "span.high", "span.low")
        .join(encoded, ["high", "low"])
        .groupBy("row")
        .agg(
            F.collect_list(
                F.struct(
                    (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"), "core"
                )
            ).alias("cores")
        )
    )

    def encode_joined(batches: Batches) -> Batches:
        coder = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_A_STEP):
                part = batch.slice(at, _TEXTS_A_STEP)
                rows = []
                for doc_id, text, found in zip(*(part[c].to_pylist() for c in ("doc_id", "text", "cores")), strict=True):
                    ids = join_spans(text, [(c["first"], c["last"], c["core"]) for c in found or []], coder)
                    rows.append((doc_id, ids, coder.decode(ids)))
                yield _batch(rows, _ENCODED)

    joined = sharing.select("row", "doc_id", "text").join(cores, "row", "left").select("doc_id", "text", "cores")
    return texts.mapInArrow(encode_alone, _ENCODED_SQL).union(joined.mapInArrow(encode_joined, _ENCODED_SQL))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the hex digests of ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
