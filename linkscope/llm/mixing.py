"""Mix sources to target weights.

Every document gets a hash-random key, documents are ordered by key within their source, sizes
are summed up along that order, and each source is cut where its budget ends. Orders are cut into
key ranges of bounded row count: range totals give each range its start, so that no task sees
a whole source and a source with a third of all rows is spread like the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkscope.llm.staging import staged

ROWS_PER_RANGE = 10_000
SEED = 17


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Size budget of each source; one row per source in, one row out.

    ``sizes`` has source (may be null) and source_size. Sources take the weights in turn, in code
    point order with null last. All sizes together are shared by weight; a share stops at
    ``cap`` times the source's size, and what is cut off is shared among the others by weight.
    With ``level`` for size per weight, the share is ``min(cap * size, level * weight)``: sources
    ordered by the level at which they are full give the level in one pass.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    ranked = sizes.withColumn("weight", weight).withColumn(
        "full_at", F.lit(float(cap)) * F.col("source_size") / F.col("weight")
    )
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.coalesce(F.sum(F.lit(float(cap)) * F.col("source_size")).over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - full) / F.sum("weight").over(onward)
    levels = ranked.withColumn("level", level)
    # The first source, in that order, which its level does not fill sets the level of all that follow.
    found = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level")))
    return levels.withColumn("found", found.over(everything)["level"]).select(
        "source",
        "source_size",
        F.least(
            F.lit(float(cap)) * F.col("source_size"),
            F.coalesce("found", F.lit(float("inf"))) * F.col("weight"),
        ).alias("target"),
    )


def document_key(seed: int = SEED) -> Column:
    """The hash that orders documents within their source; not negative."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 2)


def mix(
    docs: DataFrame,
    size: Column,
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3.0,
    seed: int = SEED,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Decide how much of every document a mix takes: doc_id, source, size, source_size, target,
    taken, copies, epochs, key; one row per row of ``docs`` (doc_id, text, source and any other column).

    ``taken`` is in units of ``size``: each source's sum is its target rounded to a whole number,
    so the document at the cut counts with its part; ``copies`` counts that document whole. A target
    above the source's size repeats the source: whole epochs first, then the beginning of the
    same order. Keys are hashes of ``seed``, doc_id and text, so reruns agree; equal rows tie
    and are interchangeable. Null ids and texts are values like others, a null source is a source,
    a document of size 0 takes nothing, an empty table gives an empty result.
    """
    # One narrow table, written once: later passes do not read texts again.
    keyed = staged(
        docs.select(
            "doc_id",
            "source",
            size.alias("size"),
            document_key(seed).alias("key"),
            F.coalesce("source", F.lit("")).alias("source_name"),
            F.col("source").isNull().alias("no_source"),
        ),
        "mix-keys",
    )
    ranges = max(1, -(-keyed.count() // rows_per_range))
    width = -(-(1 << 62) // ranges)
    cells = keyed.withColumn("cell", F.expr(f"key div {width}"))

    source = ["source_name", "no_source"]
    totals = cells.groupBy("source", *source, "cell").agg(F.sum("size").alias("cell_size"))
    earlier = Window.partitionBy(*source).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(
        totals.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, cap
    )
    starts = (
        totals.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)))
        .join(
            targets.withColumns(
                {"source_name": F.coalesce("source", F.lit("")), "no_source": F.col("source").isNull()}
            ).drop("source"),
            source,
        )
        .select(*source, "cell", "cell_start", "source_size", "target")
    )
    in_cell = (
        Window.partitionBy(*source, "cell")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    return (
        cells.join(starts, [*source, "cell"])
        .withColumn("start", F.col("cell_start") + F.sum("size").over(in_cell) - F.col("size"))
        .withColumn("budget", budget)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (
                F.col("epochs") * F.col("size")
                + F.greatest(F.lit(0), F.least(F.col("rest") - F.col("start"), F.col("size")))
            ).cast("long").alias("taken"),
            (F.col("epochs") + (F.col("start") < F.col("rest")).cast("long")).alias("copies"),
            "epochs",
            "key",
        )
    )


def sample(docs: DataFrame, size: Column, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, the one at a source's cut whole.

    A source's decision is its number of epochs and the last key of the part that follows, so one small
    row for each source is all that documents are joined with, and texts are not shuffled while that
    table is small enough for Spark to send around.
    """
    decided = mix(docs, size, weights, cap)
    cuts = staged(
        decided.groupBy("source").agg(
            F.first("epochs").alias("mix_epochs"),
            F.max(F.when(F.col("copies") > F.col("epochs"), F.col("key"))).alias("mix_last"),
        ),
        "mix-cuts",
    ).withColumnRenamed("source", "mix_source")
    more = F.coalesce((document_key() <= F.col("mix_last")).cast("long"), F.lit(0))
    return (
        docs.join(cuts, docs["source"].eqNullSafe(cuts["mix_source"]))
        .withColumn("mix_copies", F.col("mix_epochs") + more)
        .where("mix_copies > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
        .select([docs[name] for name in docs.columns])
    )
