"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their frequency rank over the whole corpus, so the commonest 256 take one
byte. A rank takes 1 to 4 bytes; two bits tell how many, and the two-bit codes of four ranks form
one control byte. Control bytes and rank bytes are stored apart, which lets numpy find all
lengths by one table lookup and all ranks by one masked copy.

A file is a Parquet file of blocks: the documents of a block with their id counts, the control
bytes, the rank bytes, and the ids before the block in its part. Parts follow each other in
ascending doc_id order. ``ranks`` beside the parts holds the id of each rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkscope.llm.pieces import encoder
from linkscope.llm.staging import staged

Batches = Iterator[pa.RecordBatch]

IDS_A_BLOCK = 1 << 16
_TEXTS_A_STEP = 64

# Lengths of the four ranks that a control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and rank bytes of some ranks."""
    wide = "<u4" if ranks.max(initial=0) >= 1 << 16 else "<u2"
    codes = (ranks >= 1 << 8).view(np.uint8)
    if wide == "<u4":
        codes = codes + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    size = np.dtype(wide).itemsize
    used = np.arange(size, dtype=np.uint8) <= codes[:, None]
    data = ranks.astype(wide).view(np.uint8)[used.reshape(-1)]
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = codes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks again."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    wide = "<u4" if lengths.max(initial=1) > 2 else "<u2"
    size = np.dtype(wide).itemsize
    spread = np.zeros(count * size, np.uint8)
    spread[(np.arange(size, dtype=np.uint8) < lengths[:, None]).reshape(-1)] = np.frombuffer(data, np.uint8)
    return spread.view(wide).astype("<u4", copy=False)


def encode_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and ids (little-endian unsigned 16 or 32-bit, end id last) of every row."""
    kind = id_type(path)

    def encode(batches: Batches) -> Batches:
        coder, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_A_STEP):
                part = batch.slice(at, _TEXTS_A_STEP)
                ids = [np.frombuffer(one + end, "<u4").astype(kind).tobytes() for one in coder.encode(part["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(encode, "doc_id bigint, ids binary")


def id_type(path: str) -> str:
    return "<u2" if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def rank_table(ids: DataFrame, kind: str, size: int) -> np.ndarray:
    """Ids by falling frequency, ties by id; counts cover all rows, the table has the vocabulary's size."""

    def count(batches: Batches) -> Batches:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            ids_of = [np.frombuffer(one.as_buffer(), kind) for one in batch["ids"]]
            if ids_of:
                seen += np.bincount(np.concatenate(ids_of), minlength=size)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(seen[found])], ["id", "n"])

    totals = ids.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[totals["id"].to_numpy()] = totals["n"].to_numpy()
    return np.lexsort((np.arange(size), -counts)).astype("<u4")


BLOCKS = (
    "part int, block int, first bigint, doc_ids array<bigint>, counts array<int>, control binary, data binary"
)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode documents and write token files to the folder ``path``, in ascending doc_id order.

    Each document's ids end with ``end_id``. A null text counts as empty: its only id is the end id.
    Null doc_ids come first, equal ones are ordered by their ids, other columns are ignored, an empty
    table gives files without documents.
    """
    spark = docs.sparkSession
    kind = id_type(tokenizer)
    ids = staged(encode_ids(docs, tokenizer, end_id), "token-ids")
    order = rank_table(ids, kind, encoder(tokenizer).tokenizer.get_vocab_size())
    rank_of = np.empty(len(order), "<u4")
    rank_of[order] = np.arange(len(order), dtype="<u4")
    ranks = spark.sparkContext.broadcast(rank_of)  # one number for each id of the vocabulary

    def blocks(batches: Batches) -> Batches:
        part, number, first, size = TaskContext.get().partitionId(), 0, 0, 0
        docs_in, counts, held = [], [], []

        def block() -> pa.RecordBatch:
            control, data = pack(ranks.value[np.concatenate(held)])
            row = {"part": part, "block": number, "first": first, "doc_ids": docs_in, "counts": counts}
            return pa.RecordBatch.from_pylist([row | {"control": control, "data": data}], _BLOCK)

        for batch in batches:
            for doc_id, one in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                found = np.frombuffer(one.as_buffer(), kind)
                docs_in.append(doc_id)
                counts.append(len(found))
                held.append(found.copy())
                size += len(found)
                if size >= IDS_A_BLOCK:
                    yield block()
                    number, first, size = number + 1, first + size, 0
                    docs_in, counts, held = [], [], []
        if docs_in:
            yield block()

    ordered = ids.repartitionByRange("doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"))
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/parts")
    table = spark.createDataFrame(pa.table({"rank": pa.array(range(len(order)), pa.int32()), "id": pa.array(order.astype(np.int64))}))
    table.coalesce(1).write.parquet(f"{path}/ranks")


_BLOCK = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("first", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int32())),
        ("control", pa.binary()),
        ("data", pa.binary()),
    ]
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit)."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").toArrow()
    order = spark.sparkContext.broadcast(ranks["id"].to_numpy().astype("<u4"))
    stored = spark.read.schema(BLOCKS).parquet(f"{path}/parts")

    def documents(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ids = order.value[unpack(row["control"], row["data"], int(counts.sum()))]
                ends = counts.cumsum()
                starts = ends - counts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["first"]),
                        pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "start", "ids"],
                )

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy("part").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda total, n: total + n)).alias("part_ids")
    )
    # One row a part, stored so that its size is known: Spark sends it to the blocks instead of
    # shuffling them, and no id moves again.
    bases = staged(
        sizes.select("part", F.coalesce(F.sum("part_ids").over(earlier), F.lit(0)).alias("base")), "token-bases"
    )
    blocks = stored.join(bases, "part").withColumn("first", F.col("base") + F.col("first"))
    return blocks.select(stored.columns).mapInArrow(documents, "doc_id bigint, start bigint, ids binary")
