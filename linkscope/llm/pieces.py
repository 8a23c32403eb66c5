"""Exact and fast token ids of whole texts, with a vocabulary file of the tokenizers library.

A text is cut before blanks that follow a non-blank. No pre-token of the supported files spans
such a place: their patterns take blanks only at the beginning of a pre-token or drop them, and
neither normalisation nor special tokens reach across a blank. Points and commas behind a letter or
digit begin a pre-token as well. So the pieces are encoded each on its own, and one that was seen
before is looked up. In byte-level vocabularies the pre-tokens of a new piece go to the vocabulary's
model, without the steps around it.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from collections.abc import Callable

import numpy as np

CACHED_PIECES = 800_000
LONGEST_CACHED = 64

_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_BLANK_RUN = re.compile(r"\s[ \n]")
# Characters behind which a point or comma begins a pre-token.
_LETTERS = frozenset(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC0, 0x250)])) - {"\u00d7", "\u00f7"}


# Pre-tokens of byte-level vocabularies that a piece may consist of: a line end alone, and runs of letters, of digits and
# of marks with the blank before them. Apostrophes and other alphabets are left to the library.
_WORD = re.compile(r"\n| ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+")


def _is_word(piece: str) -> bool:
    """Whether a piece is a run of two or more letters below U+0250, or one behind a blank; cheaper than the pattern."""
    return (
        piece[1:].isalpha()
        and (piece[0] == " " or piece[0].isalpha())
        and (piece.isascii() or max(piece) < "\u0250")
    )


def _byte_letters(alphabet: list[str]) -> dict[int, str]:
    """The letter that stands for each byte: itself where it has one, else the next of those above all bytes."""
    own = {ord(letter) for letter in alphabet if ord(letter) < 256}
    above = sorted(letter for letter in alphabet if ord(letter) >= 256)
    return dict(zip((byte for byte in range(256) if byte not in own), above, strict=True))


class _Seen(dict):
    """Ids of pieces; those of a new piece are found when they are asked for."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self._encode(piece)
        if len(piece) <= LONGEST_CACHED:
            self[piece] = ids
        return ids


def _marks_stand_apart(text: str) -> bool:
    """Whether every point and comma follows a letter or digit."""
    return all(part[-1:] in _LETTERS for mark in ".," for part in text.split(mark)[:-1])


class PieceEncoder:
    """Encodes texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        # One thread for each task: Spark already runs a task on every core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.drops_blanks = self._direct(["a", " a", "a \n "]) == [self._direct(["a"])[0]] * 3
        self._cache: dict[str, bytes] = {}
        self._added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self._words = None if self.drops_blanks else self._word_encoder()
        if self._words:
            self._cache = _Seen(self._piece)

    def _direct(self, texts: list[str]) -> list[bytes]:
        """Ids without any cutting."""
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(one.ids, "<u4").tobytes() for one in encoded]

    def _word_encoder(self) -> Callable[[str], bytes] | None:
        """Encodes a pre-token by the vocabulary's model alone; None where more than the model has a say in it."""
        from tokenizers.pre_tokenizers import ByteLevel

        steps = self.tokenizer.pre_tokenizer
        kind = json.loads(steps.__getstate__()) if isinstance(steps, ByteLevel) else {}
        if self.tokenizer.normalizer or not kind.get("use_regex") or kind.get("add_prefix_space"):
            return None
        if any(map(_WORD.fullmatch, self._added)):
            return None
        letters, tokenize = _byte_letters(ByteLevel.alphabet()), self.tokenizer.model.tokenize
        blank, formats = letters[ord(" ")], [f"<{n}I" for n in range(LONGEST_CACHED)]

        def encode(word: str) -> bytes:
            if word.isascii() and word[1:].isalpha():  # letters stand for themselves
                word = blank + word[1:] if word[0] == " " else word
            else:
                word = word.encode().decode("latin-1").translate(letters)
            ids = [token.id for token in tokenize(word)]
            return struct.pack(formats[len(ids)] if len(ids) < LONGEST_CACHED else f"<{len(ids)}I", *ids)

        return encode

    def _piece(self, piece: str) -> bytes:
        """Ids of a new piece, from those of its pre-tokens where these are plain to see."""
        if _is_word(piece) or _WORD.fullmatch(piece):
            return self._words(piece)
        words = _WORD.findall(piece)
        if sum(map(len, words)) != len(piece) or " " in piece[1:] or "\n" in piece[1:]:
            return self._direct([piece])[0]
        if any(token in piece for token in self._added):
            return self._direct([piece])[0]
        return b"".join(map(self._cache.__getitem__, words))

    def pieces(self, text: str) -> list[str]:
        """Parts of a text whose ids, one after another, are those of the text."""
        marks = _marks_stand_apart(text)
        if self.drops_blanks:
            if marks:
                text = text.replace(".", " .").replace(",", " ,")
            return text.replace("\n", " ").split(" ")
        if "\0" in text or _BLANK_RUN.search(text):
            return _CUT.split(text)
        if marks:
            text = text.replace(".", "\0.").replace(",", "\0,")
        return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        cache = self._cache
        if len(cache) > CACHED_PIECES:
            cache.clear()
        if self._words:
            return [b"".join(map(cache.__getitem__, self.pieces(text))) for text in texts]
        split = [self.pieces(text) for text in texts]
        missing = list(set().union(*split).difference(cache))
        cache.update(zip(missing, self._direct(missing), strict=True))
        ids = [b"".join(map(cache.__getitem__, pieces)) for pieces in split]
        for piece in missing:
            if len(piece) > LONGEST_CACHED:
                del cache[piece]
        return ids

    def agrees(self, left: str, right: str, reach: int = 48) -> bool:
        """Whether both sides of a join, encoded apart, have the ids of the text across it."""
        left, right = left[-reach:], right[:reach]
        across, one, other = self._direct([left + right, left, right])
        return across == one + other

    @functools.cached_property
    def _tokens(self) -> np.ndarray:
        size = self.tokenizer.get_vocab_size()
        return np.array([self.tokenizer.id_to_token(n) for n in range(size)], object)

    def decode(self, ids: bytes) -> str:
        """Text of the ids, special tokens kept."""
        numbers = np.frombuffer(ids, "<u4")
        if self.tokenizer.decoder is None:  # the tokens with blanks between them
            return " ".join(self._tokens[numbers])
        return self.tokenizer.decode(numbers.tolist(), skip_special_tokens=False)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and file."""
    return PieceEncoder(path)
