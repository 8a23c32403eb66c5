"""Content-defined chunks of a text, cut by a rolling hash."""

from __future__ import annotations

import hashlib

import numpy as np

MEAN_BITS = 11
SHORTEST, LONGEST = 512, 8192


def chunk_ends(text: str, mean_bits: int = MEAN_BITS, shortest: int = SHORTEST, longest: int = LONGEST) -> list[int]:
    """Character offsets at which chunks end; the last is the length of the text.

    The hash at a character covers the 32 characters before and with it, so equal passages are
    cut alike wherever they stand, from their first cut on. An empty text has no chunk.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    rolling = codes * np.uint32(2654435761)
    rolling ^= rolling >> np.uint32(15)
    for reach in (1, 2, 4, 8, 16):
        # The sum over twice the reach, each character shifted by its distance.
        earlier = rolling[:-reach] << np.uint32(reach)
        rolling = rolling.copy()
        rolling[reach:] += earlier
    cuts = np.flatnonzero(rolling >> np.uint32(32 - mean_bits) == 0) + 1
    ends, start = [], 0
    for cut in cuts.tolist():
        while cut - start > longest:
            start += longest
            ends.append(start)
        if cut - start >= shortest:
            ends.append(cut)
            start = cut
    while len(text) - start > longest:
        start += longest
        ends.append(start)
    if len(text) > start:
        ends.append(len(text))
    return ends


def chunk_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, high, low) of each chunk, with its 128-bit content hash in two signed halves."""
    spans, start = [], 0
    for end in chunk_ends(text):
        digest = hashlib.blake2b(text[start:end].encode("utf-8", "surrogatepass"), digest_size=16).digest()
        high, low = np.frombuffer(digest, "<i8").tolist()
        spans.append((start, end, high, low))
        start = end
    return spans
