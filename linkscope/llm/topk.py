"""Exact top-k by inner product, with a paged M-tree.

The upper level of the tree is a bounded set of routing objects. Every vector belongs to the
nearest one; its vectors form pages of bounded size, and each page is a subtree of small nodes
with a routing object, a covering radius and stored distances to the parent. For a query q and
anything within distance r of an object o, the inner product is at most ``q.o + |q| * r``.

A first visit, to one page under the best routing object, gives each query a score to beat. The second
visit goes to all pages whose bound reaches it. Inside a page nodes are taken best bound first;
distances stored in the tree rule out nodes and vectors before their own products are computed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.llm.blocks import best, visit
from linkscope.llm.staging import staged

ROUTING_OBJECTS = 64
SAMPLE_ROWS = 2048
PAGE_ROWS = 2048
NODE_ROWS = 64

_INT64 = np.iinfo(np.int64)


def quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """id and vector of whole numbers, ``floor(scale * x)``, of every usable row of ``vectors``.

    Left out: null ids, null vectors, and vectors with null or non-finite components. Rows that repeat
    an id count once, with the smallest vector. Components beyond 64 bits saturate.
    """
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall(
        "embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    )
    return (
        vectors.where(usable & finite)
        .select(
            F.col("vec_id").cast("long").alias("id"),
            F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
        )
        .groupBy("id")
        .agg(F.min("vector").alias("vector"))
    )


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond 64 bits they saturate."""
    largest = float(np.abs(vectors.astype(float)).max(initial=0)) * float(np.abs(query.astype(float)).sum())
    if largest < 2**53:
        return (vectors.astype(float) @ query.astype(float)).astype(np.int64)
    whole = vectors.astype(object) @ query.astype(object)
    return np.array([min(max(int(x), _INT64.min), _INT64.max) for x in whole], np.int64)


def _distances(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(1)[:, None] + (others**2).sum(1)[None] - 2 * vectors @ others.T
    return np.sqrt(np.maximum(squares, 0))


class Page:
    """The subtree of one page: nodes with routing object, covering radius and parent distances.

    Distances are padded by their rounding error, so that a bound never falls below a true score.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, parent: np.ndarray | None) -> None:
        self.ids, self.vectors = ids, vectors
        exact = vectors.astype(float)
        self.pad = 1e-6 * (1 + float(np.abs(exact).max(initial=0)) * exact.shape[1])
        objects = exact[:: max(1, NODE_ROWS)]
        apart = _distances(exact, objects)
        nearest = apart.argmin(1)
        self.nodes = []
        for n in range(len(objects)):
            rows = np.flatnonzero(nearest == n)
            if len(rows):
                stored = apart[rows, n] + self.pad
                up = None if parent is None else float(np.sqrt(((objects[n] - parent) ** 2).sum())) + self.pad
                self.nodes.append((objects[n], float(stored.max()), up, rows, stored))
        self.parent = parent

    def search(self, own: int, query: np.ndarray, k: int, beat: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of at most ``k`` candidates that reach ``beat``, best first."""
        exact = query.astype(float)
        norm = float(np.sqrt((exact**2).sum())) * (1 + 1e-9)
        above = None if self.parent is None else float(exact @ self.parent)
        heap = []
        for n, (obj, radius, up, _, _) in enumerate(self.nodes):
            if above is not None and above + norm * (up + radius) < beat:
                continue  # ruled out by the stored distance to the parent
            product = float(exact @ obj)
            heapq.heappush(heap, (-(product + norm * radius), n, product))
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while heap:
            bound, n, product = heapq.heappop(heap)
            if -bound + 1 < beat:
                break
            _, _, _, rows, stored = self.nodes[n]
            rows = rows[product + norm * stored + 1 >= beat]
            rows = rows[self.ids[rows] != own]
            if not len(rows):
                continue
            ids = np.concatenate((ids, self.ids[rows]))
            scores = np.concatenate((scores, exact_products(self.vectors[rows], query)))
            if len(ids) > k:
                first = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[first], scores[first]
            if len(ids) == k:
                beat = max(beat, float(scores.min()))
        return ids, scores


def routing_objects(vectors: DataFrame, count: int, sample_rows: int) -> list[np.ndarray]:
    """At most ``count`` far-apart vectors of a bounded sample, chosen by a hash of the id.

    The sample shapes the tree only; every row is indexed.
    """
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").toArrow()["vector"]
    groups: dict[int, list] = {}
    for one in rows.to_pylist():
        groups.setdefault(len(one), []).append(one)
    found = []
    for group in groups.values():
        table = np.array(group, float).reshape(len(group), -1)
        share = max(1, count * len(group) // len(rows))
        apart, chosen = np.full(len(table), np.inf), 0
        for _ in range(min(share, len(table))):
            if apart[chosen] == 0:
                break
            found.append(table[chosen])
            apart = np.minimum(apart, ((table - table[chosen]) ** 2).sum(1))
            chosen = int(apart.argmax())
    return found


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    objects: int = ROUTING_OBJECTS,
    sample_rows: int = SAMPLE_ROWS,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` highest inner products.

    Both inputs have id and a vector of whole numbers (see ``quantized``); a candidate with the
    query's id is its own and left out. Ties go to the smaller vec_id; vectors are compared with
    those of equal length only; fewer candidates than ``k`` are all returned; empty tables
    give no rows.
    """
    spark = vectors.sparkSession
    found = routing_objects(vectors, objects, sample_rows)
    shared = spark.sparkContext.broadcast(found)  # at most sample_rows vectors
    lengths = np.array([len(one) for one in found])

    @F.pandas_udf("object int, apart double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            out = pd.DataFrame({"object": np.full(len(column), -1), "apart": np.full(len(column), np.inf)})
            sizes = column.map(len).to_numpy()
            for size in set(sizes.tolist()):
                names = np.flatnonzero(lengths == size)
                rows = np.flatnonzero(sizes == size)
                if len(names):
                    table = np.array(column.iloc[rows].tolist(), float).reshape(len(rows), -1)
                    objects_ = np.array([shared.value[n] for n in names]).reshape(len(names), -1)
                    apart = _distances(table, objects_)
                    # Padded by the rounding error of the squares, as in a page.
                    largest = np.maximum(np.abs(table).max(1, initial=0), np.abs(objects_).max(initial=0))
                    out.loc[rows, "object"] = names[apart.argmin(1)]
                    out.loc[rows, "apart"] = apart.min(1) + 1e-6 * (1 + largest * size)
            yield out

    indexed = staged(
        vectors.withColumn("to", nearest("vector")).select(
            "id", "vector", "to.object", "to.apart", F.size("vector").alias("length")
        ),
        "topk-index",
    )
    nodes = indexed.groupBy("object", "length").agg(F.count("*").alias("members"), F.max("apart").alias("radius"))
    # One row for each routing object, and one for each length that the sample lacks.
    tree = nodes.withColumn("pages", F.ceil(F.col("members") / page_rows).cast("int"))
    paged = indexed.join(tree, ["object", "length"]).select(
        "object", "length", F.pmod(F.xxhash64("id"), "pages").cast("int").alias("page"), "id", "vector"
    )

    @F.pandas_udf("array<double>")
    def products(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series(
                [
                    np.array([one.astype(float) @ o if len(o) == len(one) else 0.0 for o in shared.value], float)
                    for one in column.map(np.asarray)
                ]
            )

    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    asked = staged(
        queries.select("id", "vector", F.size("vector").alias("length"), norm.alias("norm"))
        .withColumn("products", products("vector")),
        "topk-queries",
    )
    reach = (
        asked.join(tree, "length")
        .withColumn("product", F.when(F.col("object") >= 0, F.get("products", F.col("object"))))
        .withColumn(
            "bound",
            F.when(F.col("object") < 0, F.lit(float("inf"))).otherwise(
                F.col("product") + F.col("norm") * F.col("radius") * (1 + 1e-9) + 1
            ),
        )
        .drop("products")
    )

    def search(key, ids, table, query_ids, query_table, bounds):
        name = key[0]
        page = Page(ids, table, shared.value[name] if name >= 0 else None)
        parts = [page.search(own, one, k, beat) for own, one, beat in zip(query_ids, query_table, bounds, strict=True)]
        return (
            np.repeat(query_ids, [len(part[0]) for part in parts]),
            np.concatenate([part[0] for part in parts]),
            np.concatenate([part[1] for part in parts]),
        )

    page = ["object", "length", "page"]
    nowhere = float("-inf")
    first = (
        reach.groupBy("id")
        .agg(F.max_by(F.struct("object", "length", "vector"), "product").alias("best"))
        .select("id", "best.object", "best.length", "best.vector", F.lit(0).alias("page"), F.lit(nowhere).alias("bound"))
        .where("object is not null")
    )
    seeds = staged(
        best(visit(paged, first, page, search, "bigint"), k, F.col("score").desc()), "topk-seeds"
    )
    beat = seeds.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("beat"))
    second = (
        reach.join(beat, "id", "left")
        .withColumn("beat", F.coalesce("beat", F.lit(nowhere)))
        .where("bound >= beat")
        .select("id", "object", "length", "vector", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"), F.col("beat").alias("bound"))
    )
    return best(visit(paged, second, page, search, "bigint"), k, F.col("score").desc())
