"""Encoding with the tokenizers library, in which each distinct pre-token goes through the library's model once.

Pre-tokens are cut by ``pretokens``; what that leaves to its caller, and everything where a tokenizer's file
says other rules than the two that are known here, goes through the library as it is.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa

from prospectrum.llm import pretokens
from prospectrum.llm.common import quiet_tokenizers

_ENCODERS: dict[tuple[str, str], Encoder] = {}

# Normaliser and pre-tokenizer for which pretokens cuts as the library does.
RULES = {
    "byte": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    ),
}


def encoder(kind: str, path: str) -> Encoder:
    """The worker's encoder: kind "word" or "byte"."""
    key = (kind, path)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(kind, path)
    return _ENCODERS[key]


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


def known_rules(kind: str, path: str) -> bool:
    """Whether the tokenizer's file has the rules of its kind, and added tokens only that hold a <."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    own = (spec.get("normalizer"), spec.get("pre_tokenizer"))
    return own == RULES[kind] and all("<" in t["content"] for t in spec.get("added_tokens", []))


class Encoder:
    def __init__(self, kind: str, path: str) -> None:
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.rule = {"byte": pretokens.BYTE, "word": pretokens.WORD}[kind] if known_rules(kind, path) else None
        self.known = pretokens.Known(self.learn)

    def library(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, handed to the model in the byte-level alphabet."""
        letter, tokenize = LETTERS.__getitem__, self.model.tokenize
        return [array("I", [t.id for t in tokenize("".join(map(letter, p)))]).tobytes() for p in pieces]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ends with a leading zero, ids) of a column of strings in a row; null is the empty text."""
        if self.rule is None:
            rows = [self.library(t or "") for t in texts.to_pylist()]
            return np.cumsum([0, *map(len, rows)]) // 4, as_ids(b"".join(rows))
        t = pretokens.cut(texts, self.rule)
        ends, data = t.join(self.known(t.pieces), [self.library(c) if c else b"" for c in t.others])
        return ends.astype(np.int64) // 4, data.view("<u4")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ends, ids = self.column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def as_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")
