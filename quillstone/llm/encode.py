"""Token ids of whole texts with a public tokenizer, through a cache of pieces.

The tokenizers that `FITTING` names cut a text at white space before merging, so a piece
between white space always has the same ids. `Encoder` has the tokenizers library encode a
piece when it first meets it and joins the ids of known pieces. Texts in which white space
could matter (tabs, runs of blanks, control characters, markers such as `<|endoftext|>`), and
all texts of other tokenizers, go to the library whole, so the ids always equal those of
encoding the text at once.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

#: Pieces in a generation of the cache, and the longest piece that is kept (in characters).
GENERATION, LONGEST = 200_000, 40

#: How the fitting tokenizers cut texts, and whether a blank belongs to the piece after it.
FITTING = [
    ({"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None, True),
    (
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        False,
    ),
]

#: Plain punctuation after a word of Latin letters: both tokenizers cut between the two.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """Letter that byte-level BPE writes for each byte: printable Latin-1 stands for itself."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def packed(ids) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()


class _Pieces(dict):
    """Piece -> packed ids. Pieces of the last generation that are met again move into this one.

    `before` is what stands between a piece and the one ahead of it: nothing or a blank.
    """

    def __init__(self, owner: Encoder, before: str, old: dict | None = None):
        super().__init__()
        self.owner, self.old = owner, old or {}
        self.before, self.lead = before, before and _LETTERS[0x20]
        self.tokenize, self.glued = owner.model.tokenize, owner.glued

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.learn(piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def learn(self, piece: str) -> bytes:
        word = piece.rstrip(_TAIL)
        plain = word.isascii()
        if not (word.isalpha() and (plain or _LATIN.fullmatch(word))):
            if piece[:1] == "\n":  # after a blank that stands for nothing
                return self.owner.line + self.owner.bare[piece[1:]]
            return packed(self.owner.tokenizer.encode(self.before + piece, add_special_tokens=False).ids)
        if len(word) < len(piece):
            return self[word] + self.owner.bare[piece[len(word) :]]
        if not self.glued and not word.islower():
            return self[word.lower()]
        letters = word if plain else word.encode().decode("latin-1").translate(_LETTERS)
        return packed([t.id for t in self.tokenize(self.lead + letters)])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        own = [glued for cut, normalizer, glued in FITTING if spec["pre_tokenizer"] == cut and spec["normalizer"] == normalizer]
        plain = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and all(a["content"].startswith("<|") for a in spec["added_tokens"])
        self.glued = own[0] if own and plain else None
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bare, self.spaced = _Pieces(self, ""), _Pieces(self, " ")
        self.line = packed(self.tokenizer.encode("\n", add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        whole = self.glued is None or "<|" in text or not text.replace("\n", "").isprintable()
        if self.glued and not whole:
            whole = text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n " in text or " \n" in text or "\n\n" in text
        if whole:
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.bare) > GENERATION:
            self.bare = _Pieces(self, "", dict(self.bare))
        if len(self.spaced) > GENERATION:
            self.spaced = _Pieces(self, " ", dict(self.spaced))
        if not self.glued:
            return b"".join(map(self.bare.__getitem__, text.split()))
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per tokenizer file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
