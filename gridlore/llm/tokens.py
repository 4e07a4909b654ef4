"""Tokenizing with the tokenizers library, one encoder per worker process.

A text is cut where the tokenizer's own splitting always cuts: at each run of
non-blank characters (with the one space in front of it, for byte-level
vocabularies).  Ids of a piece are asked of the library once and kept in a bounded
table.  Pieces of plain letters, digits and marks are split further by the same rule
the vocabulary states and go straight to the library's BPE model; every other piece
goes through the library's whole ``encode``.  ``tests/llm`` compares with whole-text
encoding.  This holds for the splitting rules in ``RULES``, which a vocabulary file must
state as they are here; a file with other rules is encoded whole, text by text.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed values: (pre_tokenizer, normalizer) of the vocabulary files whose splitting this module knows.
RULES = (
    ({"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None),
    ({"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
     {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}),
)

#: White_Space of Unicode, as the vocabularies' splitting rules see it.
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WITH_SPACE = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
WORDS_ONLY = re.compile(f"[^{WS}]+")
#: Letters of Latin-1, digits, and ASCII marks but the apostrophe: the rules agree on these.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = "!-&(-/:-@\\[-`{-~"
PLAIN = re.compile(f" ?[{_LETTERS}0-9{_MARKS}]+")
RUNS = re.compile(f" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+")
RUNS_LOWER = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
CACHE_PIECES = 700_000  # about 180 bytes each
MAX_PIECE = 48  # longer pieces are not kept

_ENCODERS: dict[tuple, "Encoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others follow from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Table(dict):
    """Ids by piece; an unknown piece gets a place that is filled before it is used."""

    def __init__(self):
        super().__init__()
        self.waiting: dict[str, bytearray] = {}

    def __missing__(self, piece: str) -> bytearray:
        place = self[piece] = self.waiting[piece] = bytearray()
        return place


class Encoder:
    """Ids of whole texts as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, dtype: str, keep: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        with open(path, encoding="utf-8") as source:
            stated = json.load(source)
        added = [t for t in stated.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        plain_bpe = stated["model"]["type"] == "BPE" and not stated["model"].get("byte_fallback") and not stated["model"].get("dropout")
        self.known = plain_bpe and not added and (stated["pre_tokenizer"], stated["normalizer"]) in RULES
        if not self.known:
            return
        self.lower = self.tokenizer.normalizer is not None
        self.pattern = WORDS_ONLY if self.lower else WITH_SPACE
        self.runs = RUNS_LOWER if self.lower else RUNS
        self.model = self.tokenizer.model
        self.model._resize_cache(0)
        self.letters = str.maketrans(_byte_letters())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep = keep
        self.table = _Table()

    def _whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of one run, which the vocabulary's rule never splits."""
        got = self.table.get(part)
        if type(got) is bytes:
            return got
        tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
        ids = np.array([t.id for t in tokens], dtype=self.dtype).tobytes()
        if got is None and len(self.table) < self.keep:
            self.table[part] = ids  # a run is a piece, too
        return ids

    def _learn(self, piece: str) -> bytes:
        if PLAIN.fullmatch(piece) and not ("<|" in piece and any(s in piece for s in self.special)):
            return b"".join(map(self._part, self.runs.findall(piece.lower() if self.lower else piece)))
        return self._whole(piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.known:
            return [self._whole(t) for t in texts]
        table, find = self.table, self.pattern.findall
        found = [[table[p] for p in find(t)] for t in texts]
        waiting, table.waiting = table.waiting, {}
        for piece, place in waiting.items():
            ids = self._learn(piece)
            place += ids
            if len(table) <= self.keep and len(piece) <= MAX_PIECE:
                table[piece] = ids
            else:  # only needed here
                del table[piece]
        return [b"".join(f) for f in found]


def encoder(path: str, dtype: str = "<u4", keep: int = CACHE_PIECES) -> Encoder:
    """The worker's encoder for a vocabulary file; made once per process."""
    key = (path, dtype, keep)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, dtype, keep)
    return _ENCODERS[key]


def slices(texts: list[str], chars: int = 2_000_000):
    """(start, stop) of runs of texts with about ``chars`` characters each."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield start, i
            start = i
            total = 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
