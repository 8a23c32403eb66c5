"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector with a few Gaussian projections, each cut into slots of one width. The
difference of two vectors at distance d projects to a normal variable of spread d, which gives each bucket
around a query an estimated probability of holding a neighbour. A query visits buckets in falling order of
that estimate until it adds up to the wanted success, in each of several tables; candidates of all tables
are merged and ranked by their exact distance.

The first visit assumes a typical neighbour distance. A query whose k-th candidate is farther than that
visits more buckets, until the estimate reaches the wanted success at that candidate's own distance. With fewer
than k candidates, or where that takes very many buckets, it visits all vectors of its length.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.llm.blocks import best, visit
from linkscope.llm.staging import staged

TABLES = 2
PROJECTIONS = 3
SLOT_WIDTH = 0.9  # in typical neighbour distances
SUCCESS = 0.72  # of each table; two tables miss (1 - 0.72) ** 2 of the neighbours
SAMPLE_ROWS = 2048
PAGE_ROWS = 2048
MOST_PROBES = 1000  # of a table; a query that needs more visits all vectors of its length
_REACH = 4.0  # slots beyond this many spreads are never probed


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """id and vector (double) of every usable row.

    Left out: null ids, null or zero vectors, and vectors with null or non-finite components. Rows that
    repeat an id count once, with the smallest vector.
    """
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall(
        "embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    )
    return (
        vectors.where(whole & finite & F.exists("embedding", lambda x: x != 0))
        .select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
        .groupBy("id")
        .agg(F.min("vector").alias("vector"))
    )


def typical_distances(vectors: DataFrame, k: int, sample_rows: int) -> dict[int, float]:
    """Median distance to the k-th neighbour within a bounded sample, for each vector length.

    In all rows neighbours are nearer than in a sample, so probing by this distance errs on the safe side.
    """
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").toArrow()["vector"]
    groups: dict[int, list] = {}
    for one in rows.to_pylist():
        groups.setdefault(len(one), []).append(one)
    found = {}
    for size, group in groups.items():
        table = np.array(group)
        squares = (table**2).sum(1)
        apart = np.sort(np.maximum(squares[:, None] + squares[None] - 2 * table @ table.T, 0), axis=1)
        found[size] = max(float(np.sqrt(np.median(apart[:, min(k, len(group) - 1)]))), 1e-9)
    return found


def projections(size: int, table: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions of a table, and offsets as parts of a slot."""
    random = np.random.default_rng([seed, size, table])
    return random.normal(size=(size, count)), random.uniform(size=count)


def probes(places: np.ndarray, spread: float, success: float) -> list[tuple[int, ...]]:
    """Buckets around a query, likeliest first, until their estimates reach ``success``.

    ``places`` are the query's projections in slots, ``spread`` that of a neighbour's difference.
    """
    reach = math.ceil(_REACH * spread)
    chances = []
    for place in places:
        slots = np.arange(math.floor(place) - reach, math.floor(place) + reach + 2)
        below = np.array([0.5 * (1 + math.erf((edge - place) / spread / math.sqrt(2))) for edge in slots])
        inside = np.diff(below)
        order = np.argsort(-inside, kind="stable")
        chances.append([(float(inside[n]), int(slots[n])) for n in order])
    start = (0,) * len(chances)

    def chance(state: tuple[int, ...]) -> float:
        return math.prod(slots[n][0] for slots, n in zip(chances, state, strict=True))

    heap, seen, found, total = [(-chance(start), start)], {start}, [], 0.0
    while heap and total < success:
        negative, state = heapq.heappop(heap)
        total -= negative
        found.append(tuple(slots[n][1] for slots, n in zip(chances, state, strict=True)))
        for n in range(len(state)):
            following = (*state[:n], state[n] + 1, *state[n + 1 :])
            if following[n] < len(chances[n]) and following not in seen:
                seen.add(following)
                heapq.heappush(heap, (-chance(following), following))
    return found


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    tables: int = TABLES,
    count: int = PROJECTIONS,
    width: float = SLOT_WIDTH,
    success: float = SUCCESS,
    seed: int = 5,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's ``k`` nearest candidates found.

    Both inputs have id and vector (see ``usable_vectors``); a candidate with the query's id is left
    out. Every row is indexed in every table. Ties go to the smaller vec_id, vectors are compared with those
    of equal length only, and empty tables give no rows. A bucket of any size is
    dealt out in pages, all of which a probe visits. Each query reaches ``success`` for the distance of its own
    k-th candidate; with fewer candidates than ``k`` it sees all.
    """
    spreads = typical_distances(vectors, k, SAMPLE_ROWS)

    def places(table: np.ndarray, number: int) -> np.ndarray:
        directions, offsets = projections(table.shape[1], number, count, seed)
        return table @ directions / (width * spreads.get(table.shape[1], 1.0)) + offsets

    def rows_of(batch: pa.RecordBatch) -> tuple[list, list[np.ndarray]]:
        ids, values = batch["id"].to_pylist(), [np.array(one) for one in batch["vector"].to_pylist()]
        return ids, values

    def place(batches, probing: bool):
        """Buckets of vectors or, probing, of queries; those of a query with a spread lack its first ones."""
        kinds = {"id": pa.int64(), "number": pa.int32(), "bucket": pa.list_(pa.int64()), "length": pa.int32()}
        for batch in batches:
            ids, values = rows_of(batch)
            out: dict[str, list] = {name: [] for name in kinds}
            own_spreads = batch["spread"].to_pylist() if probing else [None] * len(ids)
            for own, value, spread in zip(ids, values, own_spreads, strict=True):
                for number in range(tables):
                    at = places(value[None], number)[0]
                    slots = probes(at, 1 / width, success) if probing else [tuple(np.floor(at).astype(int).tolist())]
                    if spread is not None:
                        slots = sorted(set(probes(at, spread, success)).difference(slots))
                    for bucket in slots:
                        for name, cell in zip(kinds, (own, number, bucket, len(value)), strict=True):
                            out[name].append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], kind) for n, kind in kinds.items()], list(kinds))

    def placed(frame: DataFrame, probing: bool) -> DataFrame:
        found = frame.mapInArrow(
            lambda batches: place(batches, probing), "id bigint, number int, bucket array<bigint>, length int"
        )
        return found.select("id", "number", F.xxhash64("bucket", "length").alias("bucket"), "length")

    indexed = staged(placed(vectors, False).join(vectors, "id"), "lsh-index")
    buckets = (
        indexed.groupBy("number", "bucket", "length")
        .agg(F.count("*").alias("members"))
        .select("number", "bucket", "length", F.ceil(F.col("members") / page_rows).cast("int").alias("pages"))
    )
    key = ["number", "bucket", "length"]
    stored = indexed.join(buckets, key).withColumn("page", F.pmod(F.xxhash64("id"), "pages").cast("int"))
    in_pages = F.explode(F.sequence(F.lit(0), F.col("pages") - 1))

    def asked(frame: DataFrame) -> DataFrame:
        found = placed(frame, True).join(buckets, key).join(frame.drop("spread"), "id")
        return found.withColumn("page", in_pages).withColumn("bound", F.lit(0.0))

    def search(_, ids, table, query_ids, query_table, __):
        squares = (table**2).sum(1)
        found = []
        for own, one in zip(query_ids, query_table, strict=True):
            rows = np.flatnonzero(ids != own)
            rough = squares[rows] - 2 * table[rows] @ one
            if len(rows) > k:
                slack = 1e-9 * (float(squares.max()) + float(one @ one))
                rows = rows[rough <= np.partition(rough, k - 1)[k - 1] + slack]
            exact = np.sqrt(((table[rows] - one) ** 2).sum(1))
            order = np.lexsort((ids[rows], exact))[:k]
            found.append((ids[rows][order], exact[order]))
        return (
            np.repeat(query_ids, [len(one[0]) for one in found]),
            np.concatenate([one[0] for one in found]),
            np.concatenate([one[1] for one in found]),
        )

    def ranked(hits: DataFrame) -> DataFrame:
        merged = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return best(merged, k, F.col("score"))

    blind = queries.select("id", "vector", F.lit(None).cast("double").alias("spread"))
    first = staged(ranked(visit(stored, asked(blind), [*key, "page"], search, "double")), "lsh-first")

    # Slots that a query's k-th distance spans; null where it has fewer candidates.
    last = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("last"))
    pairs = [F.lit(x) for pair in ((-1, 1.0), *spreads.items()) for x in pair]
    typical = F.coalesce(F.try_element_at(F.create_map(*pairs), F.size("vector")), F.lit(1.0))
    spread = F.col("last") / (width * typical)
    again = staged(
        queries.join(last, "id", "left")
        .where(F.col("last").isNull() | (F.col("last") > typical))
        .select("id", "vector", spread.alias("spread")),
        "lsh-again",
    )
    # No bucket is likelier than 1 / (spread * sqrt(2 * pi)) ** count.
    far = F.col("spread").isNull() | (success * (F.col("spread") * math.sqrt(2 * math.pi)) ** count > MOST_PROBES)
    near = asked(again.where(~far))

    # All vectors of a length in pages of bounded size, whatever their buckets are.
    length = F.size("vector").alias("length")
    pages = vectors.groupBy(length).agg(F.ceil(F.count("*") / page_rows).cast("int").alias("pages"))
    everything = vectors.select("id", "vector", length).join(pages, "length")
    everyone = again.where(far).select("id", "vector", length).join(pages, "length").withColumn("page", in_pages)
    hits = first.select("query_id", "vec_id", "score").union(visit(stored, near, [*key, "page"], search, "double"))
    if again.where(far).limit(1).count():
        dealt = everything.withColumn("page", F.pmod(F.xxhash64("id"), "pages").cast("int"))
        hits = hits.union(
            visit(dealt, everyone.withColumn("bound", F.lit(0.0)), ["length", "page"], search, "double")
        )
    return ranked(hits)
