"""Near-duplicate groups by an exact Jaccard join of shingle sets with PartEnum signatures.

Two sets of sizes a and b with Jaccard similarity t or more differ in at most
``(a + b) * (1 - t) / (1 + t)`` elements. Sets are taken in size bands, each with its own partition
of the hash domain into P ranges (groups of two halves, of which one is enumerated at a time).
A signature is a band, a range and the set's content in that range. Similar sets of a band
agree in all ranges but those with differing elements, H at most, so they share one of their first
H + 1 signatures in any order that depends on the signatures alone. The order here takes ranges with
a rare shingle first, as all that share a licence or another passage agree in ranges that hold nothing else, and
of these the fullest ones, which are the least likely to agree by chance. Common shingles are those that several
sets of one batch hold; which of them are found decides about the order only, not about links. A set also
takes part in the next band if a similar set can be that large.

Equal sets are one node. Inside a signature group every node is compared with the smallest one, or with
the smallest of its batch, which is compared with that. Counts of both sets by parts of the hash domain tell most
unlike pairs; only the others bring their sets together. Where all of them link, the group is settled. A node
that fails, or whose batch's smallest node fails, is compared with all other nodes of its
family (what signature groups connect), but for those of sizes that rule a link out: blocks of failed
nodes meet blocks of the family in tasks that count common shingles through an index of the block
and return no more links than connect it. Families of two nodes have nothing left to compare. No link between
unconnected nodes is left out, and the pairs of a group of copies are never written.

Blocks are dealt without their sets, which join the dealt rows last, and joins take only the sets that they need. What
is stored between is deleted when the components are known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkscope.llm.components import components
from linkscope.llm.shingles import mix, set_digest, shingle_sets
from linkscope.llm.staging import may_be_in, maybe_in, membership_filter, staged
from linkscope.session import scratch, shared_folder

Batches = Iterator[pa.RecordBatch]

# Ranges for each signature that a set of the band can need; more ranges leave a choice of full ones.
SPARE = 1.25
MEMBERS_A_TASK = 4000
SHINGLES_A_BLOCK = 500_000
_TEXTS_A_STEP = 128
# A shingle is common when so many different sets of a batch hold it, or of a part of a batch with so many shingles.
COMMON_SETS = 4
SHINGLES_AT_ONCE = 4_000_000
# Parts of the hash domain that a sketch counts: 256, at a byte each.
SKETCH_BITS = 8


def differences(a: int, b: int, percent: int) -> int:
    """Most elements in one of two sets only, for sizes a and b and ``percent`` Jaccard similarity."""
    return (a + b) * (100 - percent) // (100 + percent)


def partitions(band: int, percent: int) -> int:
    """Ranges of a band, which holds sizes from ``2 ** band`` to twice that less one."""
    most = differences(2 ** (band + 1) - 1, 2 ** (band + 1) - 1, percent)
    return 1 if most == 0 else 2 * int(np.ceil(SPARE * (most + 1) / 2))


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """Shingles that ``COMMON_SETS`` or more of the sets hold, sorted."""
    values = np.concatenate([*sets, np.zeros(0, np.uint64)])
    values.sort()
    ahead = values[COMMON_SETS - 1 :]
    return np.unique(ahead[ahead == values[: len(ahead)]])


def signatures(hashes: np.ndarray, percent: int, common: np.ndarray | None = None) -> np.ndarray:
    """Signatures of a sorted set; ``common`` tells which of its elements are common."""
    rare = np.ones(len(hashes), bool) if common is None else ~common
    size = len(hashes)
    if not size:
        return np.zeros(0, np.uint64)
    own, largest = size.bit_length() - 1, 100 * size // percent
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes))))
    found = []
    for band in (own, own + 1):
        if largest < 2**band:
            continue
        ranges = partitions(band, percent)
        wanted = differences(size, min(largest, 2 ** (band + 1) - 1), percent) + 1
        # The high half of a hash decides its range, so the ranges of a sorted set are runs.
        place = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(place, minlength=ranges)
        ends = np.cumsum(counts)
        # Ranges with a rare element first, then the fullest: as a signature's content has it.
        passages = np.bincount(place[rare], minlength=ranges) == 0
        chosen = np.argsort(np.where(passages, size + 1, 0) - counts, kind="stable")[:wanted]
        content = running[ends[chosen]] - running[ends[chosen] - counts[chosen]]
        name = (np.uint64(band) << np.uint64(40)) + chosen.astype(np.uint64)
        found.append(mix(content + mix(name + np.uint64(1))))
    return np.concatenate(found)


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the similarity, counted exactly."""
    small, large = min(len(one), len(other)), max(len(one), len(other))
    if 100 * small < percent * large:
        return False
    together = np.concatenate((one, other))
    together.sort(kind="stable")
    common = int(np.count_nonzero(together[1:] == together[:-1]))
    return 100 * common >= percent * (small + large - common)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and shingle set of each row, a few texts at a time."""
    for at in range(0, batch.num_rows, _TEXTS_A_STEP):
        texts = [text.encode() for text in batch["text"].slice(at, _TEXTS_A_STEP).to_pylist()]
        yield from enumerate(shingle_sets(texts, width), at)


def _arrow(columns: dict[str, np.ndarray | list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


_ROUTES = pa.schema([("signature", pa.int64()), ("node", pa.int64()), ("centre", pa.int64())])


def _routes(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Rows (signature, node, centre) of the nodes of a batch.

    A signature that several nodes of the batch share is sent on once, for the smallest; the others
    name that one as their centre and travel under a signature of their own, so that a group with
    a third of all rows is no hot key.
    """
    nodes = np.repeat(np.fromiter(found, np.int64, len(found)), [len(s) for s in found.values()])
    names = np.concatenate([*found.values(), np.zeros(0, np.uint64)])
    order = np.lexsort((nodes, names))
    nodes, names = nodes[order], names[order]
    first = np.concatenate((np.ones(min(1, len(names)), bool), names[1:] != names[:-1]))
    heads = nodes[first]
    centre = heads[np.cumsum(first) - 1]
    pairs = np.unique(np.stack((nodes[~first], centre[~first])), axis=1)
    own = mix(mix(pairs[0].view(np.uint64)) + pairs[1].view(np.uint64))
    names = np.concatenate((names[first], own))
    named = np.arange(len(names)) < len(heads)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names.view(np.int64)),
            pa.array(np.concatenate((heads, pairs[0]))),
            pa.array(np.concatenate((heads, pairs[1])), mask=named),
        ],
        schema=_ROUTES,
    )


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Sets are the distinct ``width``-word shingles of the whole text, A-Z lower-cased; a shorter text
    is one shingle of all its words. Documents link when their sets' Jaccard similarity is ``percent``
    hundredths or more; component_id is the smallest doc_id reachable. A null, empty or blank
    text has no shingles and is its own component. Rows with a null doc_id belong to the
    component of their copies but connect no others. Repeated rows are copies of each other; columns
    other than doc_id and text are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    described = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])

    def describe(batches: Batches) -> Batches:
        for batch in batches:
            sizes, digests, common = [], [], []
            held: dict[tuple[int, int], np.ndarray] = {}
            total = 0
            for _, hashes in _sets(batch, width):
                digest = set_digest(hashes)
                sizes.append(len(hashes))
                digests.append(digest)
                held[digest] = hashes
                total += len(hashes)
                if total >= SHINGLES_AT_ONCE:
                    common.append(common_shingles(list(held.values())))
                    held, total = {}, 0
            common.append(common_shingles(list(held.values())))
            high, low = ([digest[n] for digest in digests] for n in (0, 1))
            yield _arrow({"doc_id": batch["doc_id"], "n": sizes, "high": high, "low": low}, described)
            # A row for each common shingle, told by a size that no set has.
            found = np.unique(np.concatenate(common)).view(np.int64)
            nothing = pa.nulls(len(found), pa.int64())
            yield _arrow({"doc_id": nothing, "n": np.full(len(found), -1), "high": found, "low": nothing}, described)

    first = staged(texts.mapInArrow(describe, "doc_id bigint, n bigint, high bigint, low bigint"), "jaccard-rows")
    rows = first.where("n >= 0")
    nodes = rows.where("n > 0").groupBy("high", "low").agg(F.min("doc_id").alias("head"), F.first("n").alias("n"))
    place = shared_folder(spark, "jaccard-components")
    with scratch(spark, "jaccard"):
        grouped = staged(
            components(_links(texts, nodes, membership_filter(first.where("n < 0"), F.col("high")), width, percent)),
            "jaccard-components",
            path=place,
        )
    labelled = nodes.join(grouped, F.col("head") == F.col("node"), "left").select(
        "high", "low", F.coalesce("component", "head").alias("component")
    )
    return rows.join(labelled, ["high", "low"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _links(texts: DataFrame, nodes: DataFrame, common: Broadcast, width: int, percent: int) -> DataFrame:
    """Heads (high, low) of linked nodes, as many as connect all that are linked; ``common``: a filter of common shingles."""

    def route(batches: Batches) -> Batches:
        for batch in batches:
            found: dict[int, np.ndarray] = {}
            for _, hashes in _sets(batch, width):
                node = set_digest(hashes)[0]
                if len(hashes) and node not in found:
                    found[node] = signatures(hashes, percent, maybe_in(common.value, hashes))
            yield _routes(found)

    in_group = W.partitionBy("signature")
    pairs = staged(
        texts.mapInArrow(route, "signature bigint, node bigint, centre bigint")
        .withColumn("centre", F.coalesce("centre", F.min("node").over(in_group)))
        .where("centre <> node")
        .select("centre", "node")
        .distinct(),
        "jaccard-pairs",
    )
    ends = pairs.select("node").union(pairs.select("centre"))
    candidates = membership_filter(ends, F.col("node"))
    content = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("shingles", pa.binary())])

    def collect(batches: Batches) -> Batches:
        for batch in batches:
            found = {}
            for _, hashes in _sets(batch, width):
                digest = set_digest(hashes)
                if len(hashes) and _held(candidates.value, digest[0]):
                    found[digest] = hashes.tobytes()
            keys = list(found)
            yield _arrow(
                {"high": [k[0] for k in keys], "low": [k[1] for k in keys], "shingles": list(found.values())}, content
            )

    sets = staged(
        texts.mapInArrow(collect, "high bigint, low bigint, shingles binary")
        .groupBy("high", "low")
        .agg(F.first("shingles").alias("shingles"))
        .join(nodes, ["high", "low"])
        .where(F.col("head").isNotNull())
        .select(F.col("high").alias("node"), "head", "shingles"),
        "jaccard-sets",
    )
    judged = _judge(pairs, sets, percent)
    links = judged.where("linked").select("high", "low")
    if judged.where("not linked").limit(1).count():
        links = links.union(_rest(judged, sets, percent))
    return links


def _wanted(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of ``nodes``, and few others: a join by node shuffles no more than these."""
    return sets.where(may_be_in(membership_filter(nodes, F.col("node")), F.col("node")))


def _held(table: np.ndarray, node: int) -> bool:
    return bool(maybe_in(table, np.array([node], np.int64).view(np.uint64))[0])


def sketch(hashes: np.ndarray) -> bytes:
    """How many elements of a sorted set lie in each of equal parts of the hash domain; 255 for that many or more."""
    parts = (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    return np.minimum(np.bincount(parts, minlength=1 << SKETCH_BITS), 255).astype(np.uint8).tobytes()


def may_be_similar(one: np.ndarray, other: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """For rows of sketches of two sets and the sum of their sizes: whether the sets can have the similarity.

    Two sets share no more elements than the smaller count of each part; never False for sets that have it.
    """
    least = np.minimum(one, other).astype(np.int64)
    least[least == 255] = 1 << 40  # both reach the bound, so nothing is known
    common = least.sum(axis=1)
    return 100 * common >= percent * (sizes - common)


def _screen(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with both heads, and whether their sketches leave a link possible; sets themselves stay where they are."""
    fields = pa.schema([("node", pa.int64()), ("head", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])

    def describe(batches: Batches) -> Batches:
        for batch in batches:
            found = [np.frombuffer(shingles.as_buffer(), np.uint64) for shingles in batch["shingles"]]
            columns = {"n": [len(hashes) for hashes in found], "sketch": [sketch(hashes) for hashes in found]}
            yield _arrow({"node": batch["node"], "head": batch["head"], **columns}, fields)

    sketches = staged(sets.mapInArrow(describe, "node bigint, head bigint, n bigint, sketch binary"), "jaccard-sketches")
    both = pairs.join(sketches, "node").join(sketches.toDF("centre", "centre_head", "centre_n", "centre_sketch"), "centre")
    schema = pa.schema([(name, pa.int64()) for name in ("high", "low", "centre", "node", "head")] + [("possible", pa.bool_())])

    def screen(batches: Batches) -> Batches:
        for batch in batches:
            one, other = (
                np.frombuffer(b"".join(batch[name].to_pylist()), np.uint8).reshape(-1, 1 << SKETCH_BITS)
                for name in ("sketch", "centre_sketch")
            )
            sizes, heads, centres = (batch[n].to_numpy() for n in ("n", "head", "centre_head"))
            columns = {
                "high": np.maximum(heads, centres),
                "low": np.minimum(heads, centres),
                **{name: batch[name] for name in ("centre", "node", "head")},
                "possible": may_be_similar(one, other, sizes + batch["centre_n"].to_numpy(), percent),
            }
            yield _arrow(columns, schema)

    screened = both.where("head <> centre_head").mapInArrow(
        screen, "high bigint, low bigint, centre bigint, node bigint, head bigint, possible boolean"
    )
    return staged(screened, "jaccard-screened")


def _judge(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Compare each node with its centre: their heads as high and low, both nodes, the node's head, and linked.

    Only sets of pairs that their sketches leave possible are shuffled, by one join. Rows of a centre are dealt out
    in shares of bounded size; its set goes first in each of them.
    """
    screened = _screen(pairs, sets, percent)
    possible = screened.where("possible").select("centre", "node").distinct()
    shares = (F.floor((F.col("members") - 1) / MEMBERS_A_TASK) + 1).cast("int")
    centres = possible.groupBy("centre").agg(F.count("*").alias("members")).withColumn("shares", shares)
    first = centres.select(
        "centre",
        F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
        F.col("centre").alias("node"),
        F.lit(0).alias("kind"),
    )
    others = possible.join(centres, "centre").select(
        "centre", F.pmod(F.hash("node"), "shares").alias("share"), "node", F.lit(1).alias("kind")
    )
    schema = pa.schema([(name, pa.int64()) for name in ("high", "low", "centre", "node", "head")] + [("linked", pa.bool_())])

    def compare(batches: Batches) -> Batches:
        key, held = None, []
        for batch in batches:
            out = []
            names = ("centre", "share", "node", "head", "kind")
            columns = zip(*(batch[name].to_pylist() for name in names), batch["shingles"], strict=True)
            for centre, share, node, head, kind, shingles in columns:
                hashes = np.frombuffer(shingles.as_buffer(), np.uint64)
                if kind == 0:
                    if key != (centre, share):
                        key, held = (centre, share), []
                    held.append((head, hashes.copy()))
                    continue
                out += [
                    (max(head, h), min(head, h), centre, node, head, similar(own, hashes, percent))
                    for h, own in held
                    if h != head
                ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[n] for row in out], field.type) for n, field in enumerate(schema)], schema=schema
            )

    ordered = (
        first.union(others)
        .join(_wanted(sets, possible.select("node").union(possible.select("centre"))), "node")
        .repartition("centre", "share")
        .sortWithinPartitions("centre", "share", "kind")
    )
    compared = staged(
        ordered.mapInArrow(
            compare, "high bigint, low bigint, centre bigint, node bigint, head bigint, linked boolean"
        ),
        "jaccard-judged",
    )
    return compared.union(screened.where("not possible").withColumnRenamed("possible", "linked"))


class Block:
    """Some sets with an index of their shingles, for counting what another set has in common with each."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]) -> None:
        self.heads = [row[0] for row in rows]
        self.components = [row[1] for row in rows]
        self.sizes = np.array([len(row[2]) for row in rows])
        values = np.concatenate([row[2] for row in rows])
        order = np.argsort(values, kind="stable")
        self.owners = np.repeat(np.arange(len(rows)), self.sizes)[order]
        self.values, self.starts, self.counts = np.unique(values[order], return_index=True, return_counts=True)

    def similar(self, hashes: np.ndarray, percent: int) -> np.ndarray:
        """Places of the sets that have the similarity."""
        at = np.minimum(np.searchsorted(self.values, hashes), len(self.values) - 1)
        at = at[self.values[at] == hashes]
        counts = self.counts[at]
        # The index entries of all shingles found, one run after another.
        entries = np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        common = np.bincount(self.owners[entries], minlength=len(self.heads))
        return np.flatnonzero(100 * common >= percent * (self.sizes + len(hashes) - common))


def _rest(judged: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (high, low) of nodes that failed with a centre to nodes of their family in other components.

    Nodes behind a failed node of their batch have not met the centre it failed with: they count as failed.
    """
    linked = components(judged.where("linked")).withColumnsRenamed({"node": "head"})
    families = components(judged).withColumnsRenamed({"node": "head", "component": "family"})
    missed = judged.where("not linked").select("node", "head")
    behind = judged.join(missed.select(F.col("node").alias("centre")).distinct(), "centre", "left_semi").select("head")
    failed = missed.select("head").union(behind).distinct()
    band = F.floor(F.log("n") / math.log(100 / percent)).cast("int")
    placed = staged(
        sets.select("node", "head", F.expr("octet_length(shingles) div 8").alias("n"))
        .join(families, "head")
        .join(linked, "head", "left")
        .join(failed.withColumn("failed", F.lit(True)), "head", "left")
        .select(
            "family",
            band.alias("band"),
            "node",
            "head",
            F.coalesce("component", "head").alias("component"),
            F.coalesce("failed", F.lit(False)).alias("failed"),
            "n",
        ),
        "jaccard-placed",
    )
    # Two nodes have met already, and nodes of one component need no more links.
    open_families = (
        placed.groupBy("family")
        .agg(F.count("*").alias("rows"), F.expr("max(failed) AND min(component) < max(component)").alias("open"))
        .where("open AND rows > 2")
        .select("family")
    )
    members = staged(placed.join(open_families, "family"), "jaccard-family")
    # A failed node can only link to sizes of its own band and the two beside it.
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    failed_rows = members.where("failed").select("family", near, "node", "head", "component", "n")

    def blocks(frame: DataFrame, name: str) -> DataFrame:
        count = F.ceil(F.sum("n") / SHINGLES_A_BLOCK).cast("int").alias(name)
        return frame.groupBy("family", "band").agg(count)

    counts = blocks(members, "blocks").join(blocks(failed_rows, "fail_blocks"), ["family", "band"])
    key = ["family", "band", "block", "fail_block"]

    def dealt(frame: DataFrame, own: str, others: str, own_count: str, other_count: str) -> DataFrame:
        return frame.join(counts, ["family", "band"]).select(
            "family",
            "band",
            F.pmod(F.hash("head"), own_count).alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)).alias(others),
            "node",
            "head",
            "component",
        )

    stream = (
        dealt(members, "block", "fail_block", "blocks", "fail_blocks")
        .select(*key, "node", "head", "component", F.lit(0).alias("kind"))
        .union(
            dealt(failed_rows, "fail_block", "block", "fail_blocks", "blocks").select(
                *key, "node", "head", "component", F.lit(1).alias("kind")
            )
        )
        .join(_wanted(sets, members).select("node", "shingles"), "node")
        .repartition(*key)
        .sortWithinPartitions(*key, "kind")
    )
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64())])

    def connect(batches: Batches) -> Batches:
        current, rows, block, parent = None, [], None, {}

        def root(component: int) -> int:
            while parent.setdefault(component, component) != component:
                component = parent[component]
            return component

        for batch in batches:
            out = []
            names = zip(*(batch[name].to_pylist() for name in (*key, "head", "component", "kind")), strict=True)
            for (*place, head, component, kind), shingles in zip(names, batch["shingles"], strict=True):
                if place != current:
                    current, rows, block, parent = place, [], None, {}
                hashes = np.frombuffer(shingles.as_buffer(), np.uint64)
                if kind == 0:
                    rows.append((head, component, hashes.copy()))
                    continue
                if not rows:
                    continue
                block = block or Block(rows)
                for n in block.similar(hashes, percent).tolist():
                    one, other = root(component), root(block.components[n])
                    if one != other:
                        parent[one] = other
                        out.append((max(head, block.heads[n]), min(head, block.heads[n])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[n] for row in out], pa.int64()) for n in (0, 1)], schema=schema
            )

    return staged(stream.mapInArrow(connect, "high bigint, low bigint"), "jaccard-rest")
