"""Byte-level BPE with the tokenizers library, remembering the ids of pieces already seen.

A byte-level BPE encodes each piece of its splitting pattern on its own, so the ids of a text are those of its
pieces in order. Pieces repeat, texts rarely do: the library's model is asked once a piece.
"""

from __future__ import annotations

import re
from array import array

import public_tokenizers
from tokenizers import Tokenizer

#: Default vocabulary; only its path is used, the file is never copied.
VOCABULARY = "byte_bpe_50k.json"
#: Pieces remembered by one worker, some 110 MB; beyond it the memory starts anew.
MEMORY = 600_000

# Letters and numbers of Unicode below U+0250, as the splitting pattern's \p{L} and \p{N} take them.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_PIECES = re.compile(f" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBERS}]+| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+")
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids by piece."""

    def __init__(self, model):
        super().__init__()
        self.ask, self.letters = model.tokenize, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        ids = self[piece] = array("I", [t.id for t in self.ask(spelled)]).tobytes()
        return ids


class Encoder:
    """encode(text): the ids as little-endian unsigned 32-bit integers.

    Texts with characters from U+0250 on, unusual white space or an added token's string are given whole to the
    library; results are the same either way.
    """

    def __init__(self, path: str | None = None):
        self.whole = Tokenizer.from_file(path or vocabulary_path())
        self.pieces = _Pieces(self.whole.model)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _OTHER.search(text) or any(a in text for a in self.added):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.pieces) > MEMORY:
            self.pieces.clear()
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary; it outlives single tasks, within MEMORY."""
    path = path or vocabulary_path()
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
