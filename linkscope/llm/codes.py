"""Vectors as short codes: each part of a vector is the index of its nearest codebook entry.

Nearest entries are found by equal-average search. Entries are sorted by the sum of their components;
from a part's own sum the search goes outward, the nearer sum first. As (difference of sums)^2 / dimension
never exceeds the squared distance, a part is done once that bound strictly exceeds its best
distance; an entry whose bound equals it can still tie and is looked at. All in whole numbers.

Codebooks are a few entries for each part, whatever the number of rows. A training round sends them
to every task, and each task returns one sum and count for each entry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from linkscope.llm.staging import staged

Batches = Iterator[pa.RecordBatch]


class Codebooks(NamedTuple):
    """``entries[part]`` is a matrix of whole numbers, one row for each entry."""

    entries: list[np.ndarray]
    scale: int

    def sha256(self) -> str:
        """Digest of all components by part, entry and position."""
        whole = (str(int(x)) for part in self.entries for x in part.ravel())
        return hashlib.sha256(",".join(whole).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for."""
        chosen = [part[index] for part, index in zip(self.entries, bytes.fromhex(code), strict=True)]
        return np.concatenate(chosen).astype(float) / self.scale


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of every component, exact; Python numbers where 64 bits do not hold them."""
    if np.abs(values).max(initial=0) < 2**50 / scale:
        return np.floor(values * scale).astype(np.int64)
    exact = [math.floor(Fraction(x) * scale) for x in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def search(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each part; ties to the lower index."""
    length, count = parts.shape[1], len(entries)
    largest = max(abs(int(one)) for found in (parts, entries) for one in (found.max(initial=0), found.min(initial=0)))
    kind = np.int64 if largest * length < 2**30 else object
    parts, entries = parts.astype(kind), entries.astype(kind)
    order = np.argsort(entries.sum(1), kind="stable")
    sums, own = entries.sum(1)[order], parts.sum(1)
    right = np.searchsorted(sums, own)
    left = right - 1
    code, best = np.zeros(len(parts), np.int64), np.full(len(parts), -1, kind)
    rows = np.arange(len(parts))
    while len(rows):
        low, high = left[rows], right[rows]
        below, above = own[rows] - sums[low], sums[np.minimum(high, count - 1)] - own[rows]
        down = (low >= 0) & ((high >= count) | (below <= above))
        gap, seen = np.where(down, below, above), best[rows]
        go = ((low >= 0) | (high < count)) & ((seen < 0) | (gap * gap <= seen * length))
        rows, down, entry = rows[go], down[go], order[np.where(down, low, np.minimum(high, count - 1))[go]]
        distance, seen = ((parts[rows] - entries[entry]) ** 2).sum(1), best[rows]
        better = (seen < 0) | (distance < seen) | ((distance == seen) & (entry < code[rows]))
        best[rows[better]], code[rows[better]] = distance[better], entry[better]
        left[rows[down]] -= 1
        right[rows[~down]] += 1
    return code, best


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding is neither null nor empty and whose components are all there and finite."""
    finite = F.forall(
        "embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    )
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise ValueError(f"vectors of {width} and of {int(lengths[lengths != width][0])} components in one table")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _parts(column: pa.Array, books: Codebooks) -> list[np.ndarray]:
    values = whole(_matrix(column, sum(part.shape[1] for part in books.entries)), books.scale)
    return np.split(values, len(books.entries), axis=1)


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the componentwise floor of the mean of its parts; unused ones stay."""
    number = pa.decimal128(38, 0)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", number), ("rows", pa.int64())])

    def add(batches: Batches) -> Batches:
        totals = [np.zeros(part.shape, object) for part in books.entries]
        counts = [np.zeros(len(part), np.int64) for part in books.entries]
        for batch in batches:
            for n, (parts, entries) in enumerate(zip(_parts(batch["embedding"], books), books.entries, strict=True)):
                code, _ = search(parts, entries)
                sums = np.zeros(entries.shape, parts.dtype)
                np.add.at(sums, code, parts)
                totals[n] += sums
                counts[n] += np.bincount(code, minlength=len(entries))
        found = [
            (n, entry, place, Decimal(int(total[entry, place])), int(count[entry]))
            for n, (total, count) in enumerate(zip(totals, counts, strict=True))
            for entry, place in np.ndindex(*total.shape)
            if count[entry]
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[n] for row in found], field.type) for n, field in enumerate(schema)], schema=schema
        )

    sums = vectors.select("embedding").mapInArrow(
        add, "part int, entry int, place int, total decimal(38,0), rows bigint"
    )
    moved = [part.astype(object) for part in books.entries]
    # As many rows as the codebooks have components.
    for row in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows")).collect():
        moved[row["part"]][row["entry"], row["place"]] = int(row["total"]) // row["rows"]
    return books._replace(entries=moved)


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks of ``parts`` equal parts, fitted to all usable vectors; None where there are none.

    Each starts as its part of the ``entries`` rows with the smallest vec_id (null ids last, equal ids by their
    vector); with fewer rows it has fewer entries. Repeated rows count each time.
    """
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = vectors.orderBy(*order).select("embedding").limit(entries).collect()
    if not first:
        return None
    values = np.array([row["embedding"] for row in first], float)
    if values.shape[1] % parts:
        raise ValueError(f"{values.shape[1]} components do not make {parts} equal parts")
    books = Codebooks(np.split(whole(values, scale), parts, axis=1), scale)
    for _ in range(rounds):
        books = _moved(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with code, two hex digits for each part, and error, the squared distances' sum."""
    fields = to_arrow_schema(vectors.select(*keep).schema)
    schema = pa.schema([*fields, ("code", pa.string()), ("error", pa.int64())])

    def assign(batches: Batches) -> Batches:
        for batch in batches:
            found = [
                search(parts, entries)
                for parts, entries in zip(_parts(batch["embedding"], books), books.entries, strict=True)
            ]
            digits = np.stack([code for code, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            step = 2 * len(found)
            codes = [digits[at : at + step] for at in range(0, len(digits), step)]
            error = sum(distance.astype(object) for _, distance in found)
            columns = [batch[name] for name in keep] + [pa.array(codes, pa.string()), pa.array(error.tolist(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kinds = [f"`{name}` {vectors.schema[name].dataType.simpleString()}" for name in keep]
    return vectors.select(*keep, "embedding").mapInArrow(assign, ", ".join([*kinds, "code string", "error bigint"]))


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row (vec_id, embedding, label).

    Rows whose embedding is null, empty or holds null or non-finite components are left out. Repeated rows,
    repeated and null ids are rows like others; errors are summed over equal labels, null being one of them.
    Vectors of different lengths, or whose length is no multiple of 8, raise an error. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = staged(usable(vectors).select("vec_id", "label", "embedding"), "codes-vectors")
    books = train(rows)
    if books is None:
        return rows.selectExpr(
            "vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256"
        )
    coded = staged(encode(rows, books, ["vec_id", "label"]), "codes-coded")
    labels = coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    return coded.join(labels, coded["label"].eqNullSafe(labels["own"])).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
