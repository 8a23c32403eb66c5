"""Manifest of a dataset as a Merkle tree: proofs, and roots recomputed for changed rows.

A parent keeps a copy of its SHA-256 state before each of its child slots. What the root becomes
when one child changes is found from there: the matching state resumes with the new child and the
siblings to its right, whatever lies to the left is never hashed again.

Trees are worked on in chunks of two levels. Rows are ordered by ranges, so that every node
knows its place in its tree; a chunk's root is a node of the next layer. Going down again, a chunk gets
the siblings of its path to the root, as the states of its upper parents, once, and serves
all its nodes. A chunk is bounded, so a source with a third of all rows is as many chunks as it needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from linkscope.llm.staging import staged

FANOUT = 16
LEVELS = 2
# Nodes in a chunk: two levels of parents.
CHUNK = FANOUT**LEVELS

Batches = Iterator[pa.RecordBatch]
Level = tuple[str, str]  # the hashes to the left and to the right of a node

_NODES = pa.schema([("tree", pa.int64()), ("width", pa.int64()), ("place", pa.int64()), ("hash", pa.string())])
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(*texts: str) -> str:
    state = hashlib.sha256()
    for text in texts:
        state.update(text.encode())
    return state.hexdigest()


class Parent:
    """One run of children; ``before`` holds a copy of the hash state before each slot."""

    def __init__(self, children: Sequence[str]) -> None:
        self.children = children
        self.before = []
        state = hashlib.sha256()
        for child in children:
            self.before.append(state.copy())
            state.update(child.encode())
        self.hash = state.hexdigest()

    def level(self, slot: int) -> Level:
        return "".join(self.children[:slot]), "".join(self.children[slot + 1 :])


def resume(before, replacement: str, right: str) -> str:
    """Hash of a parent whose child after the state ``before`` is replaced."""
    state = before.copy()
    state.update(replacement.encode())
    state.update(right.encode())
    return state.hexdigest()


def layers(nodes: list[str], levels: int) -> list[list[Parent]]:
    """Parents of ``levels`` levels over the nodes, lowest first."""
    found = []
    for _ in range(levels):
        found.append([Parent(nodes[at : at + FANOUT]) for at in range(0, len(nodes), FANOUT)])
        nodes = [parent.hash for parent in found[-1]]
    return found


def depth(width: int) -> int:
    """Levels of a chunk in a layer of ``width`` nodes: until one node remains, two at most."""
    return 0 if width <= 1 else 1 if width <= FANOUT else LEVELS


def leaf(*values: Column) -> Column:
    """Hash of the values: ``-`` for a null, else the length in UTF-8 bytes, ``:`` and the value."""
    texts = [value.cast("string") for value in values]
    parts = [
        F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts
    ]
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (source, hash and others) with tree, width and place; and the trees (tree, source, width).

    Trees are numbered by source, null first, in byte order; places follow ``order`` within a source, ties
    in any order. Ranges of rows are sorted apart and counted; a range's start is what lies before it.
    """
    names = rows.columns
    # Spread, so that rows which are all alike fill several ranges; stored, as ranges are found by a first pass.
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1024))
    stored = staged(rows.withColumn("spread", spread), "merkle-leaves")
    schema = pa.schema([("run", pa.int64()), ("at", pa.int64())])

    def number(batches: Batches) -> Batches:
        source, run, at = None, -1, 0
        for batch in batches:
            runs, places = [], []
            for own in batch["source"].to_pylist():
                if run < 0 or own != source:
                    source, run, at = own, run + 1, 0
                runs.append(run)
                places.append(at)
                at += 1
            columns = [batch[name] for name in [*names, "part"]]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(pa.array(c, pa.int64()) for c in (runs, places))],
                names=[*names, "part", *schema.names],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ranged = (
        stored.repartitionByRange("source", *order, "spread")
        .sortWithinPartitions("source", *order, "spread")
        .select(*names, F.spark_partition_id().cast("long").alias("part"))
    )
    # Stored, so that a range keeps its rows and its number whatever is lost later.
    kept = staged(ranged.mapInArrow(number, f"{kinds}, part bigint, run bigint, at bigint"), "merkle-rows")

    pieces = kept.groupBy("part", "run").agg(F.first("source").alias("source"), F.count("*").alias("rows"))
    own = Window.partitionBy("source").orderBy("part")
    pieces = staged(
        pieces.withColumn("start", F.sum("rows").over(own) - F.col("rows")).withColumn(
            "width", F.sum("rows").over(Window.partitionBy("source"))
        ),
        "merkle-pieces",
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range: how many trees start before it, and whether its first piece goes on with the last of them.
    ranges = (
        pieces.groupBy("part")
        .agg(F.count_if(F.col("start") == 0).alias("new"), F.count("*").alias("runs"))
        .withColumn("trees_before", F.coalesce(F.sum("new").over(earlier), F.lit(0)))
        .select("part", "trees_before", (F.col("runs") - F.col("new")).alias("continued"))
    )
    tree = (F.col("trees_before") + F.col("run") - F.col("continued")).alias("tree")
    numbered = staged(
        pieces.join(ranges, "part").select("part", "run", "source", "start", "width", tree), "merkle-trees"
    )
    trees = numbered.where("start = 0").select("tree", "source", "width")
    starts = numbered.select("part", "run", "tree", "start", "width")
    whole = kept.join(starts, ["part", "run"]).withColumn("place", F.col("start") + F.col("at"))
    return whole.drop("part", "run", "at", "start"), trees


def _chunk(place: str = "place") -> Column:
    return F.expr(f"{place} div {CHUNK}").alias("chunk")


def _chunks(batches: Batches, names: Sequence[str]) -> Iterator[tuple[tuple[int, int], list[tuple]]]:
    """Rows of each (tree, chunk), in the order they come; a chunk may span batches."""
    key, rows = None, []
    for batch in batches:
        for tree, chunk, *row in zip(*(batch[name].to_pylist() for name in ("tree", "chunk", *names)), strict=True):
            if (tree, chunk) != key:
                if rows:
                    yield key, rows
                key, rows = (tree, chunk), []
            rows.append(row)
    if rows:
        yield key, rows


def _above(nodes: DataFrame) -> DataFrame:
    """The layer above: one node for each chunk."""

    def build(batches: Batches) -> Batches:
        out = []
        for (tree, chunk), rows in _chunks(batches, ("width", "hash")):
            found = layers([row[1] for row in rows], depth(rows[0][0]))
            out.append((tree, -(-rows[0][0] // CHUNK), chunk, found[-1][0].hash if found else rows[0][1]))
            if len(out) == 1000:
                yield _batch(out, _NODES)
                out = []
        yield _batch(out, _NODES)

    dealt = nodes.select("tree", _chunk(), "place", "width", "hash").repartition("tree", "chunk")
    ordered = dealt.sortWithinPartitions("tree", "chunk", "place")
    return staged(ordered.mapInArrow(build, "tree bigint, width bigint, place bigint, hash string"), "merkle-layer")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([row[n] for row in rows], field.type) for n, field in enumerate(schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _raised(nodes: DataFrame, widest: int) -> list[DataFrame]:
    """The layers of all trees, lowest first, until every tree has one node."""
    found = [nodes]
    while widest > 1:
        found.append(_above(found[-1]))
        widest = -(-widest // CHUNK)
    return found


def _with_paths(nodes: DataFrame, paths: DataFrame, run: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """Chunks of ``nodes``, each behind the row of its path, as one sorted stream."""
    columns = [name for name in nodes.columns if name not in ("tree", "place")]
    upper = paths.select(
        "tree",
        F.col("place").alias("chunk"),
        F.lit(None).cast("long").alias("place"),
        *[F.lit(None).cast(nodes.schema[name].dataType).alias(name) for name in columns],
        "path",
        "subroot",
        "root",
    )
    own = nodes.select(
        "tree",
        _chunk(),
        "place",
        *columns,
        F.lit(None).cast(paths.schema["path"].dataType).alias("path"),
        F.lit(None).cast("string").alias("subroot"),
        F.lit(None).cast("string").alias("root"),
    )
    stream = upper.union(own).repartition("tree", "chunk")
    return stream.sortWithinPartitions("tree", "chunk", F.col("place").asc_nulls_first()).mapInArrow(run, schema)


_PATHS = "tree bigint, place bigint, hash string, path array<struct<left: string, right: string>>, subroot string, root string"


def _lowered(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of all nodes of a layer, from the paths of the layer above."""
    schema = pa.schema(
        [("tree", pa.int64()), ("place", pa.int64()), ("hash", pa.string()), ("path", _PATH)]
        + [(name, pa.string()) for name in ("subroot", "root")]
    )

    def extend(batches: Batches) -> Batches:
        for (tree, _), (head, *rows) in _chunks(batches, ("place", "width", "hash", "path", "subroot", "root")):
            *_, path, subroot, root = head
            found = layers([row[2] for row in rows], depth(rows[0][1]))
            out = []
            for n, (place, _, own, *_) in enumerate(rows):
                steps = [dict(zip(("left", "right"), step, strict=True)) for step in _steps(found, n)]
                out.append((tree, place, own, steps + path, subroot, root))
            yield _batch(out, schema)

    return staged(_with_paths(nodes.select("tree", "place", "width", "hash"), paths, extend, _PATHS), "merkle-paths")


def _steps(found: list[list[Parent]], n: int) -> Iterator[Level]:
    for level in found:
        n, slot = divmod(n, FANOUT)
        yield level[n].level(slot)


def manifest(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (source, hash, changed and any others) less changed, with subroot, root, proof_sha256 and folded_root.

    ``hash`` is a row's leaf, lowercase hex. Per source, in the order of ``order``, every 16 consecutive
    nodes become the hash of their hashes, one after another, until one node remains: the subroot. Subroots,
    by source (null first, byte order), likewise give root. proof_sha256 is the hash of all siblings on
    the way, level by level, left to right; folded_root is the root that results when ``changed``, another
    leaf, takes the row's place (null: the row stays as it is). A null source is a source; equal rows tie, and repeated rows are leaves
    of their own; ``order`` may hold nulls, which go first. An empty table gives an empty result.
    """
    leaves, trees = placed(rows, order)
    count, widest = trees.agg(F.count("*"), F.coalesce(F.max("width"), F.lit(0))).first()
    lower = _raised(leaves.select("tree", "width", "place", "hash"), widest)
    one, all_trees = F.lit(0).cast("long"), F.lit(count).cast("long")
    subroots = lower[-1].select(one.alias("tree"), all_trees.alias("width"), F.col("tree").alias("place"), "hash")
    forest = _raised(subroots, count)

    no_steps = F.array().cast("array<struct<left: string, right: string>>")
    no_subroot = F.lit(None).cast("string")
    paths = forest[-1].select(
        "tree", "place", "hash", no_steps.alias("path"), no_subroot.alias("subroot"), F.col("hash").alias("root")
    )
    for layer in reversed(forest[:-1]):
        paths = _lowered(layer, paths)
    paths = paths.select(
        F.col("place").alias("tree"), one.alias("place"), "hash", "path", F.col("hash").alias("subroot"), "root"
    )
    for layer in reversed(lower[1:-1]):
        paths = _lowered(layer, paths)

    kept = [name for name in rows.columns if name not in ("hash", "changed")]
    results = [(name, pa.string()) for name in ("hash", "subroot", "root", "proof_sha256", "folded_root")]
    kinds = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in kept)
    names = ["width", "hash", "changed", "path", "subroot", "root", *kept]
    schema = pa.schema([*to_arrow_schema(rows.select(*kept).schema), *results])

    def prove(batches: Batches) -> Batches:
        for _, (head, *nodes) in _chunks(batches, names):
            _, _, _, path, subroot, root, *_ = head
            # The states of the upper parents before this chunk's slot.
            upper = [(hashlib.sha256(step["left"].encode()), step["left"], step["right"]) for step in path]
            beside = "".join(step["left"] + step["right"] for step in path)
            found = layers([node[1] for node in nodes], depth(nodes[0][0]))
            out = []
            for n, (_, own, changed, _, _, _, *_) in enumerate(nodes):
                proof, folded, at = hashlib.sha256(), changed or own, n
                for level in found:
                    at, slot = divmod(at, FANOUT)
                    left, right = level[at].level(slot)
                    proof.update((left + right).encode())
                    folded = resume(level[at].before[slot], folded, right)
                proof.update(beside.encode())
                for before, _, right in upper:
                    folded = resume(before, folded, right)
                out.append((*nodes[n][6:], own, subroot, root, proof.hexdigest(), folded))
            yield _batch(out, schema)

    bottom = leaves.select("tree", "place", "width", "hash", "changed", *kept)
    return _with_paths(bottom, paths, prove, f"{kinds}, " + ", ".join(f"{name} string" for name, _ in results))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
EVERY = 5


def documents_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    Leaves hash doc_id, source, lang, n_chars and text, all of them nullable. Rows are tampered with where 5
    divides the CRC-32 of the decimal doc_id: their text's A-Z is lower-cased. A null text stays, and a row
    without doc_id is not tampered with; it goes first in its source. Whole texts are hashed, of any
    length; columns beyond these five are ignored.
    """
    lowered = F.translate("text", UPPER, UPPER.lower())
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % EVERY == 0, F.lit(False))
    fields = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars")]
    rows = docs.select(
        "doc_id",
        "source",
        leaf(*fields, F.col("text")).alias("hash"),
        F.when(hit & (lowered != F.col("text")), leaf(*fields, lowered)).alias("changed"),
    )
    return manifest(rows, ["doc_id", "hash"]).select(
        "doc_id",
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
