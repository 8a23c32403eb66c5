"""Allow and block decisions for URLs by the longest matching rule.

Rules live in one trie: reversed host labels lead from the top-level domain downwards, path
segments continue below each host. The trie goes to every task; lookups walk one URL once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Keys of a trie node that are no label: path rules of a host, and rules ending inside a segment.
_PATHS, _ENDS = 0, 1


def url_host(url: Column) -> Column:
    """Host of a URL, A-Z lower-cased: after the first ``://`` up to / ? # or the end, else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """Path of a URL up to ? # or the end; empty without ``://`` or without a path."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: Iterable[tuple[str, str, str]], max_rules: int = MAX_RULES) -> dict:
    """Trie of (verdict, host, path) rules; block wins over allow for the same host and path.

    Raises above ``max_rules``: the trie goes to every task, so its size must stay bounded.
    """
    root: dict = {}
    count = 0
    for verdict, host, path in rules:
        count += 1
        if count > max_rules:
            raise ValueError(f"more than {max_rules} rules; split them by top-level domain")
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(_PATHS, {})
        *segments, last = path.split("/")
        for segment in segments:
            node = node.setdefault(segment, {})
        ends = node.setdefault(_ENDS, {})
        if ends.get(last, ("", ""))[1] != "block":
            ends[last] = (host + path, verdict)
    return root


def _match_path(node: dict, path: str) -> tuple[str, str] | None:
    """The rule of this host with the longest path that ``path`` starts with."""
    best = None
    for segment in path.split("/"):
        ends = node.get(_ENDS)
        if ends:
            fitting = [end for end in ends if segment.startswith(end)]
            if fitting:
                best = ends[max(fitting, key=len)]
        node = node.get(segment)
        if node is None:
            break
    return best


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest match: the deepest host first, then the longest path."""
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if _PATHS in node:
            best = _match_path(node[_PATHS], path) or best
    return best


def judge(
    pages: DataFrame,
    allow: Iterable[tuple[str, str]] = (),
    block: Iterable[tuple[str, str]] = (),
    default: str = "allow",
    max_rules: int = MAX_RULES,
) -> DataFrame:
    """All columns of ``pages`` plus host, path, rule and verdict; columns of these names are replaced.

    A rule (host, path) fits its host and all subdomains where the URL's path starts with the
    rule's. URLs without a fitting rule get ``default`` and a null rule; a null URL, or one without
    ``://``, has an empty host and path. Equal rows are judged alike; an empty table stays empty.
    """
    rules = [("allow", *rule) for rule in allow] + [("block", *rule) for rule in block]
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules, max_rules))

    @F.pandas_udf("rule string, verdict string")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        root = trie.value
        for hosts, paths in batches:
            found = [match(root, host, path) or (None, default) for host, path in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    kept = [name for name in pages.columns if name not in ("host", "path", "rule", "verdict")]
    split = pages.select(*kept, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = split.withColumn("judged", decide("host", "path"))
    return judged.select(*kept, "host", "path", "judged.rule", "judged.verdict")
