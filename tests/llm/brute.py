"""Plain versions of the corpus operators, for small inputs."""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@functools.cache
def tokenizer(name: str) -> Tokenizer:
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return found


def token_digests(docs: list[tuple]) -> list[tuple]:
    coder = tokenizer("word_bpe_49k.json")
    out = []
    for doc_id, text in docs:
        ids = coder.encode(text or "", add_special_tokens=False).ids
        decoded = coder.decode(ids, skip_special_tokens=False)
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        out.append((doc_id, len(ids), sha, hashlib.sha256(decoded.encode()).hexdigest()))
    return out


def token_file_rows(docs: list[tuple]) -> list[tuple]:
    coder = tokenizer("byte_bpe_50k.json")
    out, start = [], 0
    for doc_id, text in docs:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def shingles(text: str | None, width: int) -> set[tuple]:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[n : n + width]) for n in range(len(words) - width + 1)}


def near_duplicates(docs: list[tuple], width: int = 4, percent: int = 85) -> list[tuple]:
    """(doc_id, n_shingles, component_id), all pairs compared; doc_ids are not null."""
    sets = [shingles(text, width) for _, text in docs]
    parent = list(range(len(docs)))

    def root(n: int) -> int:
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for n, (doc_id, _) in enumerate(docs):
        least[root(n)] = min(doc_id, least.get(root(n), doc_id))
    return [(doc_id, len(sets[n]), least[root(n)]) for n, (doc_id, _) in enumerate(docs)]


def targets(sizes: dict, weights=(5, 2, 1), cap: int = 3) -> dict:
    """Targets by repeated resharing, as the rule is told."""
    names = sorted(sizes, key=lambda name: (name is None, (name or "").encode()))
    weight = {name: weights[n % len(weights)] for n, name in enumerate(names)}
    found = {name: 0.0 for name in names}
    open_names, rest = list(names), float(sum(sizes.values()))
    while open_names and rest > 1e-9:
        share = {name: rest * weight[name] / sum(weight[other] for other in open_names) for name in open_names}
        rest = 0.0
        for name in list(open_names):
            found[name] += share[name]
            if found[name] > cap * sizes[name]:
                rest += found[name] - cap * sizes[name]
                found[name] = float(cap * sizes[name])
                open_names.remove(name)
    return found


def nearest(vectors: dict[int, np.ndarray], score, k: int, largest: bool) -> list[tuple]:
    out = []
    for own in sorted(vectors):
        if own % 100:
            continue
        ranked = sorted(
            ((score(vectors[own], one), other) for other, one in vectors.items() if other != own),
            key=lambda found: (-found[0] if largest else found[0], found[1]),
        )
        out += [(own, n, other, value) for n, (value, other) in enumerate(ranked[:k], 1)]
    return out


def hashed(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row: tuple) -> str:
    return hashed(*("-" if value is None else f"{len(str(value).encode())}:{value}" for value in row))


def tree_root(nodes: list[str], at: int | None = None, new: str = "") -> tuple[str, str]:
    """Root of the nodes, with ``new`` in place ``at``; and the siblings' hashes on its way."""
    nodes, beside = list(nodes), ""
    if at is not None:
        nodes[at] = new
    while len(nodes) > 1:
        if at is not None:
            first = at // 16 * 16
            beside += "".join(node for n, node in enumerate(nodes[first : first + 16], first) if n != at)
            at //= 16
        nodes = [hashed(*nodes[n : n + 16]) for n in range(0, len(nodes), 16)]
    return nodes[0], beside


def manifest(docs: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text)."""
    trees: dict = {}
    for row in docs:
        trees.setdefault(row[1], []).append(row)
    names = sorted(trees, key=lambda name: (name is not None, (name or "").encode()))
    for name in names:
        trees[name].sort(key=lambda row: (row[0] is not None, row[0] or 0, leaf(row)))
    subroots = [tree_root([leaf(row) for row in trees[name]])[0] for name in names]
    out = []
    for place, name in enumerate(names):
        leaves = [leaf(row) for row in trees[name]]
        for n, row in enumerate(trees[name]):
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                changed = (*row[:4], row[4].translate(LOWER))
            _, low = tree_root(leaves, n, leaves[n])
            folded, _ = tree_root(leaves, n, leaf(changed))
            root, high = tree_root(subroots, place, subroots[place])
            top, _ = tree_root(subroots, place, folded)
            out.append((row[0], leaves[n], subroots[place], root, hashed(low, high), top, top == root))
    return out


def codes(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> list[tuple]:
    """(vec_id, code, error, label_error, codebooks_sha256) of (vec_id, vector, label), every entry compared."""
    rows = [row for row in rows if row[1] and all(x is not None and np.isfinite(x) for x in row[1])]
    whole = [[int(np.floor(scale * float(x))) for x in row[1]] for row in rows]
    step = len(whole[0]) // parts
    cut = [[tuple(one[p * step : (p + 1) * step]) for p in range(parts)] for one in whole]
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, rows[n][1]))
    books = [[cut[n][p] for n in order[:entries]] for p in range(parts)]

    def gap(one, other) -> int:
        return sum((a - b) ** 2 for a, b in zip(one, other, strict=True))

    def best(p: int, part) -> tuple[int, int]:
        return min((gap(part, entry), n) for n, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups: dict[int, list] = {}
            for one in cut:
                groups.setdefault(best(p, one[p])[1], []).append(one[p])
            for n, members in groups.items():
                books[p][n] = tuple(sum(values) // len(members) for values in zip(*members, strict=True))
    digest = hashed(",".join(str(x) for book in books for entry in book for x in entry))
    found = [[best(p, one[p]) for p in range(parts)] for one in cut]
    errors = [sum(distance for distance, _ in one) for one in found]
    labels: dict = {}
    for row, error in zip(rows, errors, strict=True):
        labels[row[2]] = labels.get(row[2], 0) + error
    return [
        (row[0], "".join(f"{n:02x}" for _, n in one), error, labels[row[2]], digest)
        for row, one, error in zip(rows, found, errors, strict=True)
    ]
