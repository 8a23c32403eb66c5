"""Pages of vectors visited by queries.

Rows of kind 0 carry a page's vectors, rows of kind 1 the queries that visit the page. Both are shuffled
by page and sorted by kind, so that a task holds one page at a time, and queries pass by in batches.
Pages are of bounded size: whoever deals the vectors out salts what is larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERIES_A_STEP = 256

Hits = tuple[np.ndarray, np.ndarray, np.ndarray]
Search = Callable[[tuple, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Hits]


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def visit(vectors: DataFrame, queries: DataFrame, page: list[str], search: Search, score: str) -> DataFrame:
    """Run ``search`` on every page with its queries: query_id, vec_id and score of what it returns.

    Both inputs have the ``page`` columns, id and vector; queries also have bound. ``search`` gets the
    page key, the page's ids and vectors, the queries' ids, vectors and bounds.
    """
    number = "<i8" if dict(vectors.dtypes)["vector"] == "array<bigint>" else "<f8"
    schema = pa.schema(
        [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if score == "bigint" else pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held = None, [], []
        for batch in batches:
            kinds = batch["kind"].to_numpy()
            keys = list(zip(*(batch[name].to_pylist() for name in page), strict=True))
            edges = [0] + [n for n in range(1, len(keys)) if keys[n] != keys[n - 1] or kinds[n] != kinds[n - 1]]
            for first, last in zip(edges, [*edges[1:], len(keys)], strict=True):
                if first == last:
                    continue
                if keys[first] != key:
                    key, ids, held = keys[first], [], []
                part = batch.slice(first, last - first)
                own, values = part["id"].to_numpy(), matrix(part["vector"], number)
                if kinds[first] == 0:
                    ids.append(own)
                    held.append(values)
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                bounds = part["bound"].to_numpy(zero_copy_only=False).astype(float)
                for at in range(0, len(own), QUERIES_A_STEP):
                    step = slice(at, at + QUERIES_A_STEP)
                    found = search(key, ids[0], held[0], own[step], values[step], bounds[step])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one, field.type) for one, field in zip(found, schema, strict=True)], schema=schema
                    )

    columns = [*page, "id", "vector"]
    stream = (
        vectors.select(*columns, F.lit(0.0).alias("bound"), F.lit(0).alias("kind"))
        .union(queries.select(*columns, "bound", F.lit(1).alias("kind")))
        .repartition(*page)
        .sortWithinPartitions(*page, "kind")
    )
    return stream.mapInArrow(run, f"query_id bigint, vec_id bigint, score {score}")


def best(hits: DataFrame, k: int, order: Column) -> DataFrame:
    """The ``k`` first distinct candidates of each query with their rank; ties to the smaller vec_id.

    Spark cuts each task's rows to ``k`` a query before the shuffle.
    """
    ranked = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
