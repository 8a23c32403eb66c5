"""Toxicity scores from a classifier that is indifferent to who is mentioned.

The model is a logistic regression over words and word beginnings. Besides the labelled texts it
sees their counterfactuals: the same text with identity terms swapped within their group, or with one added where
there is none. The loss adds the squared change of the log odds between both, so a group's name cannot raise
the score of a neutral sentence. Scoring runs where the text is read and covers all of it.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope.llm.staging import staged

Batches = Iterator[pa.RecordBatch]

# Bounds of the fit: labelled rows of each class, and features of the model.
ROWS_A_CLASS = 3000
MAX_FEATURES = 1000  # besides those of the identity terms
LEAST_ROWS = 3

# Terms that name people, by language; each is swapped for the next one of its group. Fixed values, and the
# default of a parameter.
IDENTITY_TERMS = {
    "en": (
        ("women", "men", "girls", "boys"),
        ("woman", "man", "girl", "boy"),
        ("christian", "jewish", "muslim", "hindu", "buddhist", "atheist"),
        ("christians", "jews", "muslims", "hindus", "buddhists", "atheists"),
        ("black", "white", "asian", "latino", "arab"),
        ("gay", "straight", "lesbian", "bisexual", "transgender"),
        ("african", "american", "european", "mexican", "chinese", "indian"),
        ("immigrant", "native", "refugee", "foreigner"),
        ("immigrants", "natives", "refugees", "foreigners"),
        ("old", "young", "blind", "deaf", "disabled"),
    ),
    "fr": (
        ("femmes", "hommes", "filles", "garçons"),
        ("chrétiens", "juifs", "musulmans", "bouddhistes", "athées"),
        ("noirs", "blancs", "asiatiques", "arabes"),
        ("immigrés", "réfugiés", "étrangers"),
    ),
    "de": (
        ("frauen", "männer", "mädchen", "jungen"),
        ("christen", "juden", "muslime", "buddhisten", "atheisten"),
        ("schwarze", "weiße", "asiaten", "araber"),
        ("einwanderer", "flüchtlinge", "ausländer"),
    ),
    "es": (
        ("mujeres", "hombres", "niñas", "niños"),
        ("cristianos", "judíos", "musulmanes", "budistas", "ateos"),
        ("negros", "blancos", "asiáticos", "árabes"),
        ("inmigrantes", "refugiados", "extranjeros"),
    ),
}
Groups = tuple[tuple[str, ...], ...]
IDENTITY_GROUPS: Groups = tuple(group for groups in IDENTITY_TERMS.values() for group in groups)

_EDGES = ".,;:!?\"'()[]{}<>|*%#-_/\\"
_PREFIXES = (4, 5, 6)
_CACHED_TOKENS = 300_000


def tokens(text: str) -> set[str]:
    """Distinct lower-cased tokens of the whole text."""
    return set(text.lower().split())


def features(token: str) -> list[str]:
    """The word itself and its beginnings."""
    word = token.strip(_EDGES)
    if not word:
        return []
    return ["=" + word, *("^" + word[:n] for n in _PREFIXES if len(word) >= n)]


def swaps(groups: Groups) -> dict[str, str]:
    """The term that takes the place of each; a term of several groups is swapped within the first."""
    found: dict[str, str] = {}
    for group in groups:
        for n, term in enumerate(group):
            found.setdefault(term, group[(n + 1) % len(group)])
    return found


def counterfactual(found: set[str], others: dict[str, str]) -> tuple[set[str], set[str]] | None:
    """Two token sets that should score alike; None without any terms.

    A sentence that names people, against itself with every term swapped. One that names nobody, against
    itself with one term added, which a hash of its tokens chooses among all: a mere mention is neutral.
    """
    pairs = {token: others.get(token.strip(_EDGES)) for token in found}
    if any(pairs.values()):
        return found, {other or token for token, other in pairs.items()}
    if not others:
        return None
    terms = sorted(others)
    place = zlib.crc32(" ".join(sorted(found)).encode("utf-8", "surrogatepass")) % len(terms)
    return found, found | {terms[place]}


@dataclass
class Model:
    """Weights of features, the log odds of a text without any, and how many counterfactual pairs the fit saw."""

    weights: dict[str, float]
    bias: float
    pairs: int = 0

    def log_odds(self, found: set[str], cache: dict[str, float]) -> float:
        for token in found.difference(cache):
            cache[token] = sum(self.weights.get(name, 0.0) for name in features(token))
        return self.bias + math.fsum(map(cache.__getitem__, found))


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """True for the rows whose labels the fit never sees; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def usable_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of every id with a label that the fit may see."""
    return (
        labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )


def labelled_sample(docs: DataFrame, usable: DataFrame, rows_a_class: int = ROWS_A_CLASS) -> DataFrame:
    """text and toxic of at most ``rows_a_class`` documents of each class, chosen by a hash of their id.

    ``usable`` names ids of documents once each. The chosen ids are bounded, so they may be broadcast.
    """
    chosen = [
        usable.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_a_class)
        for value in (0, 1)
    ]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("text", "toxic")


def train(
    docs: DataFrame,
    labels: DataFrame,
    rows_a_class: int = ROWS_A_CLASS,
    max_features: int = MAX_FEATURES,
    strength: float = 4.0,
    l2: float = 0.0003,
    groups: Groups = IDENTITY_GROUPS,
) -> Model:
    """Fit the model to a bounded sample of labelled rows, which weigh as much as all rows of their class.

    Every sampled row has a counterfactual; ``strength`` weighs the squared score change between both, and
    ``groups`` are the terms that name people. Held-out rows, null labels and labels without a document take no
    part; where labels of an id differ, toxic wins. Without labelled rows, or with one class only, every text gets
    the share of toxic labels as its score.
    """
    usable = staged(usable_labels(labels).join(docs.select("doc_id"), "doc_id", "left_semi"), "toxicity-labels")
    sample = staged(labelled_sample(docs, usable, rows_a_class), "toxicity-sample")
    classes = {row["toxic"]: row["n"] for row in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = classes.get(0, 0), classes.get(1, 0)
    if not clean or not toxic:
        return Model({}, 30.0 if toxic else -30.0)
    counts = pa.schema([("feature", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])

    def count(batches: Batches) -> Batches:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                seen[label].update({name for token in tokens(text) for name in features(token)})
            names = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([part[n] for n in names], pa.int64()) for part in seen)],
                schema=counts,
            )

    ratio = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    chosen = (
        sample.mapInArrow(count, "feature string, clean bigint, toxic bigint")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("clean") + F.col("toxic") >= LEAST_ROWS)
        .orderBy((F.abs(ratio) * F.sqrt(F.col("clean") + F.col("toxic"))).desc(), "feature")
        .limit(max_features)
        .toArrow()["feature"]
        .to_pylist()
    )
    others = swaps(groups)
    # Terms are features even where no text has them, so that each pair differs in the model.
    chosen += sorted({name for term in others for name in features(term)}.difference(chosen))
    place = {name: n for n, name in enumerate(chosen)}
    rows = pa.schema([("toxic", pa.int32()), ("columns", pa.list_(pa.int32())), ("added", pa.list_(pa.int32())), ("removed", pa.list_(pa.int32()))])

    def columns_of(found: set[str]) -> list[int]:
        return [place[name] for token in found for name in features(token) if name in place]

    def project(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                found = tokens(text)
                one, other = counterfactual(found, others) or (found, found)
                out.append(
                    {
                        "toxic": label,
                        "columns": columns_of(found),
                        "added": columns_of(other - one),
                        "removed": columns_of(one - other),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, rows)

    table = sample.mapInArrow(
        project, "toxic int, columns array<int>, added array<int>, removed array<int>"
    ).toArrow()  # at most twice rows_a_class rows
    totals = {row["toxic"]: row["n"] for row in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    stands_for = [max(1.0, totals.get(value, 0) / rows_a_class) for value in (0, 1)]
    weights, bias = _fit(table, len(chosen), strength, l2, stands_for)
    changes = pc.add(pc.list_value_length(table["added"]), pc.list_value_length(table["removed"]))
    pairs = pc.sum(pc.greater(changes, 0)).as_py() or 0
    return Model({name: float(weights[n]) for name, n in place.items() if weights[n]}, bias, pairs)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every list element."""
    lists = column.combine_chunks()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()


def _fit(
    table: pa.Table, size: int, strength: float, l2: float, stands_for: list[float], steps: int = 300
) -> tuple[np.ndarray, float]:
    """Minimise log loss, half the ridge and the counterfactual penalty by Adam over all rows.

    A row of a class counts as the ``stands_for`` rows of that class.
    """
    labels = table["toxic"].to_numpy().astype(float)
    rows, columns = _flat(table["columns"])
    added, removed = _flat(table["added"]), _flat(table["removed"])
    swap_rows = np.concatenate((added[0], removed[0]))
    swap_columns = np.concatenate((added[1], removed[1]))
    swap_signs = np.concatenate((np.ones(len(added[0])), -np.ones(len(removed[0]))))
    share = np.where(labels == 1, stands_for[1], stands_for[0])
    share = share / share.sum()
    count, weights = len(labels), np.zeros(size + 1)  # the last weight is the bias
    mean, spread = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        odds = weights[size] + np.bincount(rows, weights[columns], count)
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels) * share
        gradient = np.append(np.bincount(columns, error[rows], size) + l2 * weights[:size], error.sum())
        if len(swap_rows):
            change = np.bincount(swap_rows, swap_signs * weights[swap_columns], count) * share
            gradient[:size] += 2 * strength * np.bincount(swap_columns, swap_signs * change[swap_rows], size)
        mean = 0.9 * mean + 0.1 * gradient
        spread = 0.999 * spread + 0.001 * gradient**2
        weights -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-9)
    return weights[:size], float(weights[size])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus toxic_score (0 to 1) from the whole text.

    A null text counts as empty and gets the score of no evidence; equal texts have equal scores; a
    column of that name is replaced; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features weights and those of the terms

    @F.pandas_udf("double")
    def odds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, float] = {}
        for texts in batches:
            if len(cache) > _CACHED_TOKENS:
                cache.clear()
            yield pd.Series([shared.value.log_odds(tokens(text), cache) for text in texts], dtype="float64")

    bounded = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds(F.coalesce("text", F.lit("")))))
    return docs.withColumn("toxic_score", 1 / (1 + F.exp(-bounded)))
