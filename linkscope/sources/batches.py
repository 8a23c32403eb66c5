"""Batch sources: where event batches come from.

A source lists its batches as rows of ``source_type, source_identifier, fingerprint`` and
returns the lines of the batches an import asks for. A batch is new when that triple is not
in the import ledger, so a file with changed content is a new batch.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from typing import Protocol
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.session import shared_folder, stage

BATCH_KEYS = ("source_type", "source_identifier", "fingerprint")
LINE_COLUMNS = (*BATCH_KEYS, "line_no", "value")
# The number of a batch in one listing. A source that finds it in ``pending`` may hand it on with the lines.
LISTING_NO = "listing_no"
# Numbers in one bitmap (see :func:`number_sets`).
SET_SIZE = 32_768

# The reader is given so many paths at most, and the driver holds no more.
PATHS_A_READ = 10_000
# Path hashes of so many files are sent to all tasks (about 100 MB); beyond that they are joined.
HASHES_SENT = 5_000_000

# Files up to this size are hashed whole, by one task each; larger ones as a tree.
WHOLE_BYTES = 32 << 20
# Lines in a block of a tree.
TREE_LINES = 4096

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


class BatchSource(Protocol):
    source_type: str

    def batches(self, spark: SparkSession) -> DataFrame:
        """All batches there are now; at least the columns ``BATCH_KEYS``."""

    def lines(self, spark: SparkSession, pending: DataFrame) -> DataFrame:
        """Lines of the pending batches; the columns ``LINE_COLUMNS``."""


# -- sets of batches -----------------------------------------------------------


def number_sets(numbered: DataFrame) -> DataFrame:
    """The listing numbers of a frame as bitmaps: a bit for each batch, so that large rows need not be shuffled to them."""
    return numbered.groupBy(F.expr(f"{LISTING_NO} div {SET_SIZE}").alias("number_set")).agg(
        F.expr(f"bitmap_construct_agg({LISTING_NO} % {SET_SIZE})").alias("numbers")
    )


def in_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows whose listing number is in the sets. Stored sets have a known size: Spark broadcasts them unless large."""
    byte = f"hex(substring(numbers, cast({LISTING_NO} % {SET_SIZE} div 8 AS int) + 1, 1))"
    is_in = F.expr(f"shiftright(cast(conv({byte}, 16, 10) AS int), cast({LISTING_NO} % 8 AS int)) & 1 = 1")
    numbered = rows.withColumn("number_set", F.expr(f"{LISTING_NO} div {SET_SIZE}"))
    return numbered.join(sets, "number_set").filter(is_in).drop("number_set", "numbers")


def _number_of(frame: DataFrame) -> list[str]:
    return [LISTING_NO] if LISTING_NO in frame.columns else []


# -- fingerprints --------------------------------------------------------------


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def content_fingerprint(content: Column, universal_newlines: bool = True) -> Column:
    """SHA-256 of the text, by default after CRLF and CR became LF."""
    return F.sha2(normalize_newlines(content) if universal_newlines else content, 256)


def stat_fingerprint(length: Column, modified: Column) -> Column:
    """Like an object store's version tag: changes whenever a file is rewritten."""
    return F.sha2(F.concat_ws("|", length.cast("string"), F.unix_micros(modified).cast("string")), 256)


# -- lines ---------------------------------------------------------------------


def split_lines(batches: DataFrame, content: str = "content") -> DataFrame:
    """Lines of whole batch texts, numbered from 1; blank lines keep their number."""
    keys = [c for c in batches.columns if c != content]
    # The outer form: an inner explode adds a filter that splits the text a second time.
    split = F.posexplode_outer(F.split(F.col(content), "\r\n|\n|\r")).alias("position", "value")
    return batches.select(*keys, split).select(
        *keys, (F.col("position") + 1).cast("long").alias("line_no"), "value"
    )


def with_row_numbers(lines: DataFrame) -> DataFrame:
    """Lines of a text scan with their place in the task that read them, as ``row``."""
    return lines.withColumn("row", F.monotonically_increasing_id())


def line_blocks(rows: DataFrame, by: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """One row per file split: its first row number, and the lines in the file's earlier splits.

    ``rows`` has ``file_path``, ``block_start`` (where the split begins) and ``row``, and has been
    stored: rows that were scanned anew could be split differently. The number of a line is
    then ``row - first_row + earlier + 1``; no file is ever read by one task alone.
    """
    blocks = rows.groupBy(*by, "block_start").agg(
        F.min("row").alias("first_row"), F.count(F.lit(1)).alias("block_lines")
    )
    before = Window.partitionBy(*by).orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("block_lines").over(before), F.lit(0))
    return blocks.withColumn("earlier", earlier).drop("block_lines")


def line_number() -> Column:
    return F.col("row") - F.col("first_row") + F.col("earlier") + 1


def line_hashes(text: DataFrame) -> DataFrame:
    """SHA-256 of each line of a text scan, with its place in the task that read it."""
    return with_row_numbers(text).select("file_path", "block_start", "row", F.sha2("value", 256).alias("hash"))


def joined_hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file_path, block, line_no, hash) with one row for lines of a block that follow one another in a task.

    ``hash`` is the text of their hashes, or, where they are all lines of a full block (``whole``), its SHA-256.
    """
    held: list = []  # the run at the end of what was read: file_path, block, line_no and texts of its lines
    done: list[tuple] = []

    def close() -> None:
        if held:
            path, block, first, texts = held
            whole = len(texts) == TREE_LINES
            text = "".join(texts)
            done.append((path, block, first, hashlib.sha256(text.encode()).hexdigest() if whole else text, whole))

    for part in parts:
        for path, block, line_no, text in zip(*(part[n].to_pylist() for n in range(4)), strict=True):
            if held and line_no == held[2] + len(held[3]) and block == held[1] and path == held[0]:
                held[3].append(text)
            else:
                close()
                held = [path, block, line_no, [text]]
            if len(done) == 1000:
                yield _record_batch(done, _JOINED)
                done.clear()
    close()
    yield _record_batch(done, _JOINED)


_JOINED = pa.schema(
    [("file_path", pa.string()), ("block", pa.int64()), ("line_no", pa.int64()), ("hash", pa.string()), ("whole", pa.bool_())]
)


def tree_fingerprints(hashes: DataFrame, splits: DataFrame) -> DataFrame:
    """``file_path`` and ``fingerprint`` of files whose :func:`line_hashes` and :func:`line_blocks` were stored.

    The SHA-256 of the SHA-256s of blocks of 4,096 lines, each of which hashes its lines' SHA-256s one after
    another. Blocks follow line numbers, so how a file was split does not change the result, and no task holds
    more than a block or the list of a file's blocks. Full blocks are hashed in the task that reads their lines, and
    only blocks that tasks share are shuffled. Line ends do not count.
    """
    numbered = hashes.join(splits, ["file_path", "block_start"])
    block = F.expr(f"(row - first_row + earlier) div {TREE_LINES}").alias("block")
    joined = "listagg(hash) WITHIN GROUP (ORDER BY {0})"
    blocks = (
        numbered.select("file_path", block, line_number().alias("line_no"), "hash")
        .mapInArrow(joined_hashes, "file_path string, block long, line_no long, hash string, whole boolean")
        .groupBy("file_path", "block")
        .agg(F.expr(joined.format("line_no")).alias("hash"), F.expr("bool_or(whole)").alias("whole"))
        .withColumn("hash", F.expr("if(whole, hash, sha2(hash, 256))"))
    )
    return blocks.groupBy("file_path").agg(F.sha2(F.expr(joined.format("block")), 256).alias("fingerprint"))


# -- files ---------------------------------------------------------------------


def _bare(path: str) -> str:
    return re.sub(_SCHEME, "", path).rstrip("/")


@F.pandas_udf(T.BooleanType())
def _is_linked(paths: pd.Series, roots: pd.Series) -> pd.Series:
    """Whether a local path leads through a symbolic link below its root; asked where the files are read."""
    real = {root: os.path.realpath(root) for root in set(roots)}
    return pd.Series(
        [os.path.realpath(path) != real[root] + path[len(root) :] for path, root in zip(paths, roots, strict=True)]
    )


def _literal_path(path: str) -> str:
    """A path whose special characters are no pattern."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


@dataclass(frozen=True)
class FileSource:
    """JSON-lines files under a folder or an object-store prefix.

    ``fingerprint="content"`` hashes the text of each file, line ends taken as LF, so every import reads all
    files: those up to ``whole_bytes`` as a whole (SHA-256 of the text), larger ones split like any text scan
    (:func:`tree_fingerprints`). ``fingerprint="stat"`` uses size and modification time: only new files
    are ever read. Listing, hashing and reading are one job each, however many files there are.
    """

    source_type: str
    root: str
    prefix: str = ""
    pattern: str = "*.jsonl"
    fingerprint: str = "content"
    whole_bytes: int = WHOLE_BYTES

    def __post_init__(self) -> None:
        if self.fingerprint not in ("content", "stat"):
            raise ValueError(f"unknown fingerprint: {self.fingerprint}")

    @property
    def location(self) -> str:
        prefix = self.prefix.strip("/")
        return f"{self.root.rstrip('/')}/{prefix}" if prefix else self.root.rstrip("/")

    def _options(self) -> dict[str, str]:
        return {"recursiveFileLookup": "true", "pathGlobFilter": self.pattern}

    def _identifier(self, path: Column) -> Column:
        """Path relative to the root (for a prefix: the full name below the root)."""
        bare = F.regexp_replace(path, _SCHEME, "")
        return F.substring(bare, F.lit(len(_bare(self.root)) + 2), F.length(bare))

    def identifier_of_uri(self, file_uri: Column) -> Column:
        """The same for a file URI, in which special characters are escaped."""
        return self._identifier(F.url_decode(F.regexp_replace(file_uri, r"\+", "%2B")))

    def files(self, spark: SparkSession) -> DataFrame | None:
        """One row per file, without reading any content; None where the root does not exist."""
        try:
            found = spark.read.format("binaryFile").options(**self._options()).load(self.location)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        if urlparse(self.location).scheme in ("", "file"):  # object stores have no links
            found = found.filter(~_is_linked(F.regexp_replace("path", _SCHEME, ""), F.lit(_bare(self.location))))
        return found

    def batches(self, spark: SparkSession) -> DataFrame:
        found = self.files(spark)
        if found is None:
            return spark.createDataFrame([], _LISTED)

        def listed(files: DataFrame, fingerprint: Column) -> DataFrame:
            return files.select(
                F.lit(self.source_type).alias("source_type"),
                self._identifier(F.col("path")).alias("source_identifier"),
                fingerprint.alias("fingerprint"),
                F.col("_metadata.file_path").alias("file_path"),
                "path",
                F.col("modificationTime").alias("modified"),
            )

        if self.fingerprint == "stat":
            return listed(found, stat_fingerprint(F.col("length"), F.col("modificationTime")))
        # Without the column ``content`` the reader opens no file; with a bound on the length none beyond it.
        whole = listed(
            found.filter(F.col("length") <= self.whole_bytes), content_fingerprint(F.col("content").cast("string"))
        )
        folder = shared_folder(spark, "hashes")
        large = listed(found.filter(F.col("length") > self.whole_bytes), F.lit("")).drop("fingerprint")
        large = stage(large, f"{folder}/files")
        if large.isEmpty():
            return whole
        hashes = stage(line_hashes(self._text(spark, large)), f"{folder}/lines")
        trees = tree_fingerprints(hashes, stage(line_blocks(hashes), f"{folder}/splits"))
        return whole.unionByName(large.join(trees, "file_path"))

    def _text(self, spark: SparkSession, files: DataFrame) -> DataFrame:
        """One text scan that reads the files (file_path, path, modified), and a few others at most.

        Up to some thousand paths are named to the reader. Beyond that the whole location is scanned, without
        the files that are older or newer than all of these, and others are left out by a hash of their path.
        """
        some = files.select("path").limit(PATHS_A_READ + 1).collect()
        reader = spark.read.options(**self._options())
        if len(some) <= PATHS_A_READ:
            text = reader.text([_literal_path(row.path) for row in some])
        else:
            first, last, count = files.agg(F.min("modified"), F.max("modified"), F.count("*")).first()
            wanted = files.select(F.xxhash64("file_path").alias("path_hash")).distinct()
            written = F.col("_metadata.file_modification_time")
            text = reader.text(self.location).filter((written >= F.lit(first)) & (written <= F.lit(last)))
            text = text.withColumns(_place()).withColumn("path_hash", F.xxhash64("file_path"))
            text = text.join(F.broadcast(wanted) if count <= HASHES_SENT else wanted, "path_hash", "left_semi")
            return text.select("value", "file_path", "block_start")
        return text.select("value", *[column.alias(name) for name, column in _place().items()])

    def lines(self, spark: SparkSession, pending: DataFrame) -> DataFrame:
        """Lines of the pending files. The text is scanned once and stored; numbers come from what was stored."""
        folder = shared_folder(spark, "lines")
        if pending.isEmpty():
            return spark.createDataFrame([], _LINES)
        rows = stage(with_row_numbers(self._text(spark, pending)), f"{folder}/rows")
        return numbered_lines(rows, pending, folder)


_LISTED = "source_type string, source_identifier string, fingerprint string, file_path string, path string, modified timestamp"
_LINES = "source_type string, source_identifier string, fingerprint string, line_no long, value string"


def _place() -> dict[str, Column]:
    """Where a scanned line comes from: its file and the beginning of its split."""
    return {"file_path": F.col("_metadata.file_path"), "block_start": F.col("_metadata.file_block_start")}


def numbered_lines(rows: DataFrame, pending: DataFrame, folder: str) -> DataFrame:
    """Stored rows (file_path, block_start, row, value) as lines of the pending batches (file_path and keys)."""
    # Written, its size is known: Spark then broadcasts it, or shuffles if it is large.
    number = _number_of(pending)
    blocks = line_blocks(rows).join(pending.select("file_path", *BATCH_KEYS, *number), "file_path")
    blocks = stage(blocks, f"{folder}/blocks")
    return rows.join(blocks, ["file_path", "block_start"]).select(
        *BATCH_KEYS, line_number().alias("line_no"), "value", *number
    )


def local_source(path: str, **options: object) -> FileSource:
    """Files of a shared folder; the identifier is the path relative to it."""
    return FileSource("local", path, **options)


def object_store_source(uri: str, prefix: str = "", **options: object) -> FileSource:
    """Files below ``uri/prefix`` of any store Spark can read; the identifier keeps the prefix.

    A store changes an object's time whenever it is written, so content is read only if it is new.
    """
    return FileSource("azure", uri, prefix, **{"fingerprint": "stat", **options})


# -- user-defined sources --------------------------------------------------------


@dataclass(frozen=True)
class ContentSource:
    """A source backed by a function that returns batches with their whole text.

    The frame has ``source_identifier`` and ``content``, and may bring its own ``fingerprint``.
    """

    source_type: str
    load: Callable[[SparkSession], DataFrame]

    def batches(self, spark: SparkSession) -> DataFrame:
        loaded = self.load(spark)
        fingerprint = content_fingerprint(F.col("content"))
        if "fingerprint" in loaded.columns:
            fingerprint = F.coalesce(F.nullif(F.col("fingerprint"), F.lit("")), fingerprint)
        return loaded.select(
            F.lit(self.source_type).alias("source_type"),
            "source_identifier",
            fingerprint.alias("fingerprint"),
            "content",
        )

    def lines(self, spark: SparkSession, pending: DataFrame) -> DataFrame:
        number = _number_of(pending)
        return split_lines(pending.select(*BATCH_KEYS, *number, "content")).select(*LINE_COLUMNS, *number)


# A batch is read in ranges of so many bytes. Small ranges share tasks of about as many bytes, once there are more
# ranges than RANGE_TASKS.
RANGE_BYTES = 64 << 20
RANGE_TASKS = 200
_READ_STEP = 1 << 20
# What is read behind a range at first, for the line that runs beyond it.
_READ_TAIL = 4096
_LINE_END = re.compile(rb"\r\n|\n|\r")

# (identifier, first byte, number of bytes) -> bytes, fewer only at the end; called in tasks.
ReadBytes = Callable[[str, int, int], bytes]


def lines_of_range(read: Callable[[int, int], bytes], start: int, end: int) -> Iterator[bytes]:
    """The lines that begin at bytes ``start`` to ``end - 1``; the last of them may run on beyond.

    Ranges that follow one another give every line of a text once, whatever their size. Lines end at LF, CR or CRLF.
    A small range reads little beyond it, and twice as much with every step of a line that goes on.
    """
    step = min(_READ_STEP, end - start + _READ_TAIL)
    held = read(max(0, start - 1), step + 1)
    over = len(held) <= step
    base, at = max(0, start - 1), min(start, 1)
    # A line that runs across the start, or the LF of a CRLF that does, belongs to the range before.
    before, first = held[:at], held[at : at + 1]
    skip = start > 0 and not (before == b"\n" or (before == b"\r" and first != b"\n"))
    searched = at
    while base + at < end:
        found = _LINE_END.search(held, searched)
        # A CR at the end of what is held may be half of a CRLF.
        if not over and (found is None or found.end() == len(held)):
            more = read(base + len(held), step)
            over, step = len(more) < step, min(_READ_STEP, 2 * step)
            searched = (found.start() if found else len(held)) - at
            held, base, at = held[at:] + more, base + at, 0
            continue
        if found is None:
            if at < len(held) and not skip:
                yield held[at:]
            return
        if not skip:
            yield held[at : found.start()]
        skip, at = False, found.end()
        searched = at


@dataclass(frozen=True)
class RangedSource:
    """A source backed by a function that reads bytes of a batch, for batches of any size.

    ``load`` returns ``source_identifier`` and ``length`` (bytes), and may bring a ``fingerprint``. ``read`` runs in
    tasks. Batches are dealt out in ranges: hashed in fixed ranges where they bring no fingerprint (the SHA-256 of
    the ranges' SHA-256s), and read by the lines that begin in each range.
    """

    source_type: str
    load: Callable[[SparkSession], DataFrame]
    read: ReadBytes
    range_bytes: int = RANGE_BYTES

    def _ranges(self, batches: DataFrame) -> DataFrame:
        """Rows (file_path, block_start, block_end), a partition for each, or for about ``RANGE_BYTES`` of small ones."""
        length, step = F.col("length").cast("long"), F.lit(self.range_bytes).cast("long")
        starts = F.sequence(F.lit(0).cast("long"), F.greatest(length - 1, F.lit(0).cast("long")), step)
        ranges = batches.select(
            F.col("source_identifier").alias("file_path"), length.alias("length"), F.explode(starts).alias("block_start")
        )
        ranges = ranges.withColumn("block_end", F.least(F.col("block_start") + self.range_bytes, F.col("length")))
        total = ranges.agg(F.count("*").alias("n"), F.sum(F.col("block_end") - F.col("block_start")).alias("size")).first()
        tasks = min(total.n, max(RANGE_TASKS, -(-(total.size or 0) // RANGE_BYTES)), 100_000)
        return ranges.drop("length").repartition(max(1, tasks), "file_path", "block_start")

    def batches(self, spark: SparkSession) -> DataFrame:
        loaded = self.load(spark)
        kept = [F.lit(self.source_type).alias("source_type"), "source_identifier"]
        if "fingerprint" in loaded.columns:
            return loaded.select(*kept, "fingerprint", "length")
        read = self.read

        def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                digests = []
                for name, start, end in zip(*(part[n].to_pylist() for n in range(3)), strict=True):
                    state = hashlib.sha256()
                    for at in range(start, end, _READ_STEP):
                        state.update(read(name, at, min(_READ_STEP, end - at)))
                    digests.append(state.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(digests, pa.string())], names=["file_path", "block_start", "hash"]
                )

        hashes = self._ranges(loaded).mapInArrow(hashed, "file_path string, block_start long, hash string")
        tree = "sha2(listagg(hash) WITHIN GROUP (ORDER BY block_start), 256)"
        trees = hashes.groupBy(F.col("file_path").alias("source_identifier")).agg(F.expr(tree).alias("fingerprint"))
        return loaded.join(trees, "source_identifier").select(*kept, "fingerprint", "length")

    def lines(self, spark: SparkSession, pending: DataFrame) -> DataFrame:
        read, folder = self.read, shared_folder(spark, "lines")
        schema = pa.schema(
            [("file_path", pa.string()), ("block_start", pa.int64()), ("row", pa.int64()), ("value", pa.string())]
        )

        def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for name, start, end in zip(*(part[n].to_pylist() for n in range(3)), strict=True):
                    rows: list[tuple] = []
                    for n, line in enumerate(lines_of_range(partial(read, name), start, end)):
                        rows.append((name, start, n, line.decode("utf-8", "replace")))
                        if len(rows) == 1000:
                            yield _record_batch(rows, schema)
                            rows = []
                    yield _record_batch(rows, schema)

        rows = self._ranges(pending).mapInArrow(split, "file_path string, block_start long, row long, value string")
        rows = stage(rows, f"{folder}/rows")
        keys = pending.select(F.col("source_identifier").alias("file_path"), *BATCH_KEYS, *_number_of(pending))
        return numbered_lines(rows, keys, folder)


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([row[n] for row in rows], field.type) for n, field in enumerate(schema)], schema=schema
    )


_REGISTRY: dict[str, ContentSource | RangedSource] = {}


def register_source(
    source_type: str, load: Callable[[SparkSession], DataFrame], read: ReadBytes | None = None, **options: object
) -> ContentSource | RangedSource:
    """Make a batch source available by name: of whole texts, or with ``read`` of batches that are read in ranges."""
    if not source_type:
        raise ValueError("a source needs a type")
    source = RangedSource(source_type, load, read, **options) if read else ContentSource(source_type, load)
    _REGISTRY[source_type] = source
    return source


def registered_source(source_type: str) -> ContentSource | RangedSource:
    return _REGISTRY[source_type]


# -- source sets -----------------------------------------------------------------


def sources_for_mode(
    mode: str, local_path: str = "", store_uri: str = "", store_prefix: str = "", **options: object
) -> list[FileSource]:
    """Sources of an import mode; ``hybrid`` is local files, then the object store."""
    local = [local_source(local_path, **options)] if mode in ("local", "hybrid") else []
    store = (
        [object_store_source(store_uri, store_prefix, **options)] if mode in ("azure", "hybrid") else []
    )
    if mode != "disabled" and not local + store:
        raise ValueError(f"unsupported import mode: {mode}")
    return local + store


def union_batches(spark: SparkSession, sources: list[BatchSource]) -> DataFrame:
    """Batch keys of all sources as one frame."""
    union = spark.createDataFrame([], ", ".join(f"{key} string" for key in BATCH_KEYS))
    for source in sources:
        union = union.unionByName(source.batches(spark).select(*BATCH_KEYS))
    return union
