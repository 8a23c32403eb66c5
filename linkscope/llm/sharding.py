"""Balanced shards by histogram sort.

Shards are ranges of a 62-bit key. Their boundaries are found without sorting anything: one pass
counts the exact bytes below evenly spaced candidate keys, the next pass looks only between the
two candidates around each boundary, until the bytes below every boundary are within tolerance.
Rows move once, after the boundaries are known. All work is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkscope.llm.staging import staged

KEY_BITS = 62
PROBE_BITS = 12
ROWS_PER_CELL = 50_000


def hash_key(*columns: str, seed: int = 23) -> Column:
    """A key that shuffles rows evenly and alike in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 2)


def splitters(keyed: DataFrame, shards: int, tolerance: float = 0.001) -> list[int]:
    """First keys of shards 1, 2, ... so that the bytes below each are near an equal share.

    ``keyed`` has key (0 to 2 ** 62 - 1) and size. The distance from the equal share is at most
    ``tolerance`` shards, or one key's rows where a key weighs more. Every pass brings at most
    ``shards * 2 ** PROBE_BITS`` counts to the driver, whatever the row count.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    goals = [total * n / shards for n in range(1, shards)]
    slack = tolerance * total / shards
    found: dict[int, int] = {}
    # Boundary -> (prefix of the key range that holds it, bits of the prefix, bytes below it).
    brackets = {n: (0, 0) for n in range(len(goals))}
    bits = 0
    while brackets:
        step = min(PROBE_BITS, KEY_BITS - bits)
        prefixes = sorted({prefix for prefix, _ in brackets.values()})
        prefix = F.shiftright("key", KEY_BITS - bits)
        inside = keyed.where(prefix.isin(prefixes)) if bits else keyed
        counted = {
            row["probe"]: row["bytes"]
            for row in inside.groupBy(F.shiftright("key", KEY_BITS - bits - step).alias("probe"))
            .agg(F.sum("size").alias("bytes"))
            .collect()
        }
        ordered: dict[int, list[int]] = {}
        for probe in sorted(counted):
            ordered.setdefault(probe >> step, []).append(probe)
        bits += step
        refined = {}
        for n, (old, below) in brackets.items():
            for probe in ordered.get(old, []):
                above = below + counted[probe]
                if above >= goals[n]:
                    break
                below = above
            else:  # nothing left above the goal: only in an empty table
                found[n] = (old + 1) << (KEY_BITS - bits + step)
                continue
            near_low, near_high = goals[n] - below, above - goals[n]
            if bits == KEY_BITS or min(near_low, near_high) <= slack:
                first = probe if near_low <= near_high else probe + 1
                found[n] = first << (KEY_BITS - bits)
            else:
                refined[n] = (probe, below)
        brackets = refined
    return [found[n] for n in sorted(found)]


def shard(
    docs: DataFrame,
    size: Column,
    shards: int,
    key: Column | None = None,
    tolerance: float = 0.001,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """All columns of ``docs`` plus shard_size, shard (0 to ``shards - 1``) and slot (gapless from 0).

    Shards hold near equal sums of ``size``. Without ``key`` rows are dealt by a hash of doc_id and
    text. Null ids and texts are values like others; equal rows tie and are interchangeable;
    existing columns of the added names are replaced; an empty table gives an empty result.
    """
    base = docs.drop("shard_size", "shard", "slot", "shard_key", "shard_cell")
    rows = base.withColumns(
        {"shard_size": size.cast("long"), "shard_key": hash_key("doc_id", "text") if key is None else key}
    )
    keyed = staged(rows.select(F.col("shard_key").alias("key"), F.col("shard_size").alias("size")), "shard-keys")
    bounds = splitters(keyed, shards, tolerance)
    count = keyed.count()
    cell_bits = max(0, math.ceil(math.log2(max(1, count / rows_per_cell))))
    starts = F.array(*[F.lit(bound) for bound in bounds]) if bounds else F.array().cast("array<bigint>")

    def placed(frame: DataFrame, name: str) -> DataFrame:
        return frame.withColumns(
            {
                "shard": F.size(F.filter(starts, lambda first: first <= F.col(name))).cast("int"),
                "shard_cell": F.shiftright(name, KEY_BITS - cell_bits),
            }
        )

    # Rows of a shard are numbered cell by cell; the cells' counts give each cell its first slot.
    earlier = Window.partitionBy("shard").orderBy("shard_cell").rowsBetween(Window.unboundedPreceding, -1)
    first_slots = (
        placed(keyed, "key")
        .groupBy("shard", "shard_cell")
        .agg(F.count("*").alias("cell_rows"))
        .select("shard", "shard_cell", F.coalesce(F.sum("cell_rows").over(earlier), F.lit(0)).alias("first_slot"))
    )
    in_cell = Window.partitionBy("shard", "shard_cell").orderBy("shard_key", "doc_id")
    return (
        placed(rows, "shard_key")
        .join(first_slots, ["shard", "shard_cell"])
        .withColumn("slot", F.col("first_slot") + F.row_number().over(in_cell) - 1)
        .select(*base.columns, "shard_size", "shard", "slot")
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Store shards as one folder each; adaptive execution splits a large shard over several files."""
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
