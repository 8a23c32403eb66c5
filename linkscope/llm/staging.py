"""Intermediate tables in the shared folder, and a fixed-size membership filter."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscope.session import remove_folder, shared_folder

_STAGED: list[str] = []

# Spark deletes the shuffle files of an action at its end, instead of when the driver collects its garbage.
_DELETE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Bits of a membership filter: 2 MB, however large the corpus is.
FILTER_BITS = 24


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_DELETE_SHUFFLES, None)
    spark.conf.set(_DELETE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DELETE_SHUFFLES)
        else:
            spark.conf.set(_DELETE_SHUFFLES, before)


def staged(frame: DataFrame, label: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Write a frame once to the folder that all executors share, and read it back.

    What depends on the result is fixed from then on: a lost executor rereads files instead of
    recomputing rows, so row numbers and partition numbers stored in them cannot change. The shuffle
    files of the frame are deleted as soon as it is written. ``path`` is a folder that was taken before.
    """
    spark = frame.sparkSession
    path = path or shared_folder(spark, label)
    with _shuffles_deleted(spark):
        frame.write.option("compression", codec).parquet(path)
    _STAGED.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every staged table of this driver, once the results made from them are stored."""
    while _STAGED:
        remove_folder(spark, _STAGED.pop())


def membership_filter(frame: DataFrame, value: Column, bits: int = FILTER_BITS) -> Broadcast:
    """Bitmap with one bit set for each 64-bit hash in ``value``, broadcast to the executors.

    The bitmap has ``2 ** bits`` bits whatever the row count, is or-ed together on the executors
    and only ever lets extra rows through: callers must stay right when ``maybe_in`` is wrongly true.
    """
    slot = F.shiftrightunsigned(value, 64 - bits)
    words = (
        frame.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("mask"))
    )
    table = np.zeros(1 << (bits - 6), np.uint64)
    rows = words.toArrow()  # at most 2 ** (bits - 6) rows
    table[rows["word"].to_numpy()] = rows["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return frame.sparkSession.sparkContext.broadcast(table)


def maybe_in(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where the filter may hold the hash; false only where it does not."""
    shift = np.uint64(64 - (len(table).bit_length() + 5))
    slots = hashes.astype(np.uint64, copy=False) >> shift
    return (table[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def may_be_in(filter_: Broadcast, value: Column) -> Column:
    """``maybe_in`` as a column: rows that a join need not shuffle are left out by it first."""

    @F.pandas_udf("boolean")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            yield pd.Series(maybe_in(filter_.value, hashes.to_numpy(np.int64).view(np.uint64)))

    return held(value)
