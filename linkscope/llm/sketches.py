"""Near-duplicate groups by fast similarity sketches, bands, and comparison of whole shingle sets.

A sketch has t coordinates. In round i every element of a set is hashed to one coordinate and a
fraction, and each coordinate keeps the least (round, fraction) it meets. From round t on all elements go to
coordinate i - t, so every coordinate is filled after 2 t rounds; a set is done as soon as all are, usually
after about t log t / size rounds. Two sets agree in a coordinate with the probability of their Jaccard
similarity, and the number of such coordinates is concentrated like that of independent trials.

With 24 bands of five coordinates, sets at similarity 0.85 share no band in one of a million pairs, and more
similar ones more rarely. All else is exact: links are confirmed on whole sets.

Equal sets are one node. In each bucket (the nodes that share a band) all are compared with the smallest node. A
bucket whose nodes are then connected is settled. In the others, the nodes outside the bucket's largest
component are compared with all nodes of other components: first by sketch, in blocks, which leaves out
pairs more than six deviations below the threshold; the nodes that have such a partner then by their sets.
Rows of a bucket are dealt out in blocks of bounded size. No pairs are written, only links that connect.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.llm.components import components
from linkscope.llm.jaccard import Block, similar
from linkscope.llm.shingles import mix, shingle_sets
from linkscope.llm.staging import maybe_in, membership_filter, staged

Batches = Iterator[pa.RecordBatch]

BANDS = 24
BAND_ROWS = 5
COORDINATES = BANDS * BAND_ROWS
# A filter of wanted texts takes 16 bits a key; beyond this size (32 MB) texts are joined with the keys.
LARGEST_FILTER_BITS = 28
MEMBERS_A_TASK = 4000
NODES_A_BLOCK = 1000
SHINGLES_A_BLOCK = 500_000
_TEXTS_A_STEP = 256
_EMPTY = np.uint64(2**64 - 1)
_LOW = np.uint64(2**32 - 1)


def _seeds(count: int, start: int) -> np.ndarray:
    return mix(np.arange(start + 1, start + count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketches(sets: list[np.ndarray], size: int = COORDINATES) -> np.ndarray:
    """One row of ``size`` coordinates for each set of 64-bit hashes; an empty set has an empty sketch."""
    found = np.full((len(sets), size), _EMPTY)
    cells = found.reshape(-1)
    values = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owners = np.repeat(np.arange(len(sets)), [len(one) for one in sets])
    open_rows = np.array([len(one) > 0 for one in sets], bool)
    for n, seed in enumerate(_seeds(2 * size, 1000)):
        if not len(values):
            break
        hashed = mix(values + seed)
        if n < size:
            place = ((hashed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        else:
            place = n - size
        np.minimum.at(cells, owners * size + place, np.uint64(n << 32) | (hashed & _LOW))
        before = np.flatnonzero(open_rows)
        open_rows[before] = (found[before] == _EMPTY).any(axis=1)
        if not open_rows[before].all():
            stay = open_rows[owners]
            values, owners = values[stay], owners[stay]
    return found


def band_hashes(found: np.ndarray) -> np.ndarray:
    """Signed 64-bit hash of each band of each sketch; bands at different places never share one on purpose."""
    grouped = found.reshape(len(found), BANDS, BAND_ROWS)
    mixed = (mix(grouped) * _seeds(BAND_ROWS, 5000)).sum(axis=2, dtype=np.uint64)
    return mix(mixed + _seeds(BANDS, 6000)).view(np.int64)


def least_agreement(percent: int) -> int:
    """Coordinates in which similar sets agree but for a chance below six and a half deviations."""
    share = percent / 100
    deviation = math.sqrt(COORDINATES * share * (1 - share))
    return max(1, math.floor(COORDINATES * share - 6.5 * deviation))


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[list[np.ndarray]]:
    """Shingle sets of the batch's texts, some at a time."""
    for at in range(0, batch.num_rows, _TEXTS_A_STEP):
        yield shingle_sets([text.encode() for text in batch["text"].slice(at, _TEXTS_A_STEP).to_pylist()], width)


def _name(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([row[n] for row in rows], field.type) for n, field in enumerate(schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


_DESCRIBED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("n", pa.int64()),
        ("node", pa.binary()),
        ("bands", pa.list_(pa.int64())),
        ("sketch", pa.binary()),
    ]
)


def _described(texts: DataFrame, width: int) -> DataFrame:
    """Set size, node and sketch of every row; of equal sets in a batch, one carries the sketch."""

    def describe(batches: Batches) -> Batches:
        for batch in batches:
            seen: set[bytes] = set()
            out, at = [], 0
            for sets in _sets(batch, width):
                names = [_name(one) if len(one) else None for one in sets]
                new = []
                for n, name in enumerate(names):
                    if name is not None and name not in seen:
                        seen.add(name)
                        new.append(n)
                found = sketches([sets[n] for n in new])
                bands, small = band_hashes(found), (found & np.uint64(255)).astype(np.uint8)
                place = {n: k for k, n in enumerate(new)}
                for n, (one, name) in enumerate(zip(sets, names, strict=True)):
                    k = place.get(n)
                    own = (None, None) if k is None else (bands[k], small[k].tobytes())
                    out.append((at + n, len(one), name, *own))
                at += len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["text_key"],
                    *(pa.array([row[n] for row in out], _DESCRIBED.field(n + 1).type) for n in range(1, 5)),
                ],
                schema=_DESCRIBED,
            )

    return staged(
        texts.mapInArrow(
            describe, "doc_id bigint, text_key bigint, n bigint, node binary, bands array<bigint>, sketch binary"
        ),
        "sketch-rows",
    )


def _wanted_sets(texts: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """node and shingles of the texts whose key is wanted, and of a few others."""
    bits = math.ceil(math.log2(16 * max(keys.count(), 1 << 10)))
    if bits <= LARGEST_FILTER_BITS:
        held = membership_filter(keys, F.col("text_key"), bits)
    else:
        texts, held = texts.join(keys.distinct(), "text_key", "left_semi"), None
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.binary())])

    def collect(batches: Batches) -> Batches:
        for batch in batches:
            text_keys = batch["text_key"].to_numpy()
            _, first = np.unique(text_keys, return_index=True)
            if held is not None:
                first = first[maybe_in(held.value, text_keys[first].view(np.uint64))]
            found = {}
            for sets in _sets(batch.take(pa.array(first)), width):
                found |= {_name(one): one.tobytes() for one in sets if len(one)}
            yield _batch(list(found.items()), schema)

    sets = texts.mapInArrow(collect, "node binary, shingles binary")
    return staged(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sketch-sets")


def _stars(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (high, low) of nodes to their centres. A centre's rows are dealt out in shares of bounded size."""
    shares = (F.floor((F.count("*") - 1) / MEMBERS_A_TASK) + 1).cast("int")
    centres = pairs.groupBy("centre").agg(shares.alias("shares"))
    first = centres.join(sets.withColumnRenamed("node", "centre"), "centre").select(
        "centre", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
        F.lit(None).cast("binary").alias("node"), "shingles",
    )
    others = (
        pairs.join(centres, "centre")
        .join(sets, "node")
        .select("centre", F.pmod(F.hash("node"), "shares").alias("share"), "node", "shingles")
    )
    schema = pa.schema([("high", pa.binary()), ("low", pa.binary())])

    def compare(batches: Batches) -> Batches:
        held = None
        for batch in batches:
            out = []
            columns = (batch[name].to_pylist() for name in ("centre", "node"))
            for centre, node, shingles in zip(*columns, batch["shingles"], strict=True):
                hashes = np.frombuffer(shingles.as_buffer(), np.uint64)
                if node is None:
                    held = hashes.copy()
                elif similar(held, hashes, percent):
                    out.append((max(centre, node), min(centre, node)))
            yield _batch(out, schema)

    ordered = (
        first.union(others)
        .repartition("centre", "share")
        .sortWithinPartitions("centre", "share", F.col("node").asc_nulls_first())
    )
    return staged(ordered.mapInArrow(compare, "high binary, low binary"), "sketch-stars")


def _dealt(rows: DataFrame, size: str, most: int) -> DataFrame:
    """Rows (bucket, minor, ...) in cells: each block of a bucket's minor nodes meets each block of all its nodes.

    A block holds about ``most`` of ``size``. Minor nodes come twice, in either kind of block.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.sum(size) / most)).cast("int")
    all_blocks = rows.groupBy("bucket").agg(blocks.alias("blocks"))
    minor_blocks = rows.where("minor").groupBy("bucket").agg(blocks.alias("minor_blocks"))
    # Stored, so that Spark broadcasts the counts if they are few, or splits the rows of a large bucket.
    counts = staged(all_blocks.join(minor_blocks, "bucket"), "sketch-blocks")
    counted = rows.join(counts, "bucket")

    def cells(frame: DataFrame, own: str, count: str, other: str, others: str, kind: int) -> DataFrame:
        kept = [F.col(name) for name in rows.columns if name not in ("bucket", "minor")]
        return frame.select(
            "bucket",
            F.pmod(F.hash("node"), count).alias(own),
            F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other),
            F.lit(kind).alias("kind"),
            *kept,
        )

    key = ["bucket", "block", "minor_block"]
    members = cells(counted, "block", "blocks", "minor_block", "minor_blocks", 0)
    minors = cells(counted.where("minor"), "minor_block", "minor_blocks", "block", "blocks", 1)
    stream = members.unionByName(minors).repartition(*key)
    return stream.sortWithinPartitions(*key, "kind")


def _cells(batches: Batches, names: list[str]) -> Iterator[tuple[int, list[tuple], list[tuple]]]:
    """Members and minor nodes of each cell."""
    key, rows = None, ([], [])
    for batch in batches:
        columns = (batch[name].to_pylist() for name in ("bucket", "block", "minor_block", "kind", *names))
        for bucket, block, minor_block, kind, *row in zip(*columns, strict=True):
            if (bucket, block, minor_block) != key:
                if rows[1]:
                    yield key[0], *rows
                key, rows = (bucket, block, minor_block), ([], [])
            rows[kind].append(row)
    if rows[1]:
        yield key[0], *rows


def _partners(unsettled: DataFrame, percent: int) -> DataFrame:
    """(bucket, node) of nodes with a partner that may be similar, each pair in the first bucket it shares."""
    least = least_agreement(percent)
    schema = pa.schema([("bucket", pa.int64()), ("node", pa.binary())])

    def table(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        return (
            np.array([row[1] for row in rows]),
            np.array([row[2] for row in rows], float),
            np.array([row[3] for row in rows]),
            np.frombuffer(b"".join(row[4] for row in rows), np.uint8).reshape(len(rows), -1),
        )

    def estimate(batches: Batches) -> Batches:
        for bucket, members, minors in _cells(batches, ["node", "component", "n", "bands", "sketch"]):
            component, size, bands, sketch = table(members)
            alive, partner = np.zeros(len(members), bool), []
            for row, own_component, own_size, own_bands, own_sketch in zip(minors, *table(minors), strict=True):
                near = np.flatnonzero(
                    (component != own_component)
                    & (100 * np.minimum(size, own_size) >= percent * np.maximum(size, own_size))
                )
                near = near[np.count_nonzero(sketch[near] == own_sketch, axis=1) >= least]
                near = near[bands[near, np.argmax(bands[near] == own_bands, axis=1)] == bucket]
                if len(near):
                    alive[near] = True
                    partner.append(row[0])
            nodes = {members[n][0] for n in np.flatnonzero(alive)} | set(partner)
            yield _batch([(bucket, node) for node in sorted(nodes)], schema)

    rows = unsettled.withColumn("one", F.lit(1))
    return staged(
        _dealt(rows, "one", NODES_A_BLOCK).mapInArrow(estimate, "bucket bigint, node binary").distinct(),
        "sketch-partners",
    )


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Links (high, low) that connect components, by comparing the sets of a bucket's rows."""
    schema = pa.schema([("high", pa.binary()), ("low", pa.binary())])

    def connect(batches: Batches) -> Batches:
        for _, members, minors in _cells(batches, ["node", "component", "shingles"]):
            block = Block([(node, component, np.frombuffer(held, np.uint64)) for node, component, held in members])
            parent: dict[bytes, bytes] = {}

            def root(component: bytes, parent: dict[bytes, bytes] = parent) -> bytes:
                while parent.setdefault(component, component) != component:
                    component = parent[component]
                return component

            out = []
            for node, component, held in minors:
                for n in block.similar(np.frombuffer(held, np.uint64), percent).tolist():
                    one, other = root(component), root(block.components[n])
                    if one != other:
                        parent[one] = other
                        out.append((max(node, block.heads[n]), min(node, block.heads[n])))
            yield _batch(out, schema)

    dealt = _dealt(rows, "n", SHINGLES_A_BLOCK).drop("n")
    return staged(dealt.mapInArrow(connect, "high binary, low binary"), "sketch-links")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Sets are the distinct ``width``-word shingles of the whole text, A-Z lower-cased; a shorter text is one
    shingle of all its words. Documents link when their sets' Jaccard similarity is ``percent`` hundredths or
    more; component_id is the smallest doc_id reachable, and kept says that it is the row's own. A null, empty
    or blank text has no shingles and is its own component. Rows with a null doc_id link like others; their
    component_id is null, and they are kept, where none of the component has a doc_id. Repeated rows are copies
    of each other, and so are different texts under one doc_id only if they link. Columns other than doc_id and text
    are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    rows = _described(texts, width)
    nodes = staged(
        rows.where("n > 0")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("head"),
            F.min("text_key").alias("text_key"),
            F.first("n").alias("n"),
            F.first("bands", ignorenulls=True).alias("bands"),
            F.first("sketch", ignorenulls=True).alias("sketch"),
        ),
        "sketch-nodes",
    )
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("members"))
    members = staged(
        buckets.join(shared.where("members > 1").drop("members"), "bucket").select("bucket", "node", "centre"),
        "sketch-buckets",
    )
    pairs = staged(members.where("node <> centre").select("centre", "node").distinct(), "sketch-pairs")
    ends = pairs.select("node").union(pairs.select(F.col("centre").alias("node"))).distinct()
    sets = _wanted_sets(texts, nodes.join(ends, "node", "left_semi").select("text_key"), width)
    links = _stars(pairs, sets, percent)

    parts = staged(components(links), "sketch-parts")
    placed = members.join(parts, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")
    )
    counted = placed.groupBy("bucket", "component").agg(F.count("*").alias("members"))
    largest = counted.groupBy("bucket").agg(
        F.max_by("component", "members").alias("largest"), F.count("*").alias("components")
    )
    open_rows = staged(
        placed.join(largest.where("components > 1").select("bucket", "largest"), "bucket").select(
            "bucket", "node", "component", (F.col("component") != F.col("largest")).alias("minor")
        ),
        "sketch-open",
    )
    if open_rows.limit(1).count():
        partners = _partners(open_rows.join(nodes.select("node", "n", "bands", "sketch"), "node"), percent)
        more = open_rows.join(partners, ["bucket", "node"]).join(sets, "node")
        links = links.union(_across(more.withColumn("n", F.expr("octet_length(shingles) div 8")), percent))
        parts = staged(components(links), "sketch-parts")
    ids = nodes.join(parts, "node", "left").select("node", "head", F.coalesce("component", "node").alias("component"))
    least = ids.groupBy("component").agg(F.min("head").alias("least"))
    labelled = ids.join(least, "component").select("node", "least")
    component_id = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return (
        rows.select("doc_id", "n", "node")
        .join(labelled, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
