"""Sets of word shingles of whole texts, as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

_LONGEST = 4096


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    values = values.astype(np.uint64)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


def _table(size: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


# Fixed value: blanks are space, tab, LF, VT, FF and CR.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = _table(256, 1)[_LOWER]
_PLACE = _table(_LONGEST, 2)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ink = ~_BLANK[data]
    edges = np.flatnonzero(np.diff(ink, prepend=False, append=False))
    first, last = edges[::2], edges[1::2]
    ends = np.cumsum([len(text) + 1 for text in texts])
    counts = np.diff(np.searchsorted(first, ends), prepend=0)
    if not len(first):
        return np.zeros(0, np.uint64), counts
    lengths = last - first
    starts = np.cumsum(lengths) - lengths
    letters = data[ink]
    place = np.arange(len(letters)) - np.repeat(starts, lengths)
    hashes = np.add.reduceat(_BYTE[letters] * _PLACE[place % _LONGEST], starts)
    for n in np.flatnonzero(lengths > _LONGEST):
        word = _LOWER[data[first[n] : last[n]]].tobytes()
        hashes[n] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return mix(hashes + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), counts


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``width`` words each, or all words if there are fewer."""
    words, counts = word_hashes(texts)
    factors = _table(width, 3)
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for n, factor in enumerate(factors):
        runs += words[n : n + len(runs)] * factor
    runs = mix(runs)
    sets, at = [], 0
    for count in counts.tolist():
        if count >= width:
            sets.append(np.unique(runs[at : at + count - width + 1]))
        elif count:
            short = (words[at : at + count] * factors[:count]).sum(dtype=np.uint64)
            sets.append(mix(np.array([short + np.uint64(count)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += count
    return sets


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set in two signed halves."""
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    high, low = np.frombuffer(digest, "<i8").tolist()
    return high, low
