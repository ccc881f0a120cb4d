"""Texts as rows of distinct pre-tokens, by whole columns.

A text is cut at single spaces, and each distinct cut is cut once into runs of letters, digits or signs, on the
column's bytes. That is what the pre-tokenizers of the two tokenizers used here do with plain Latin text (see
``BYTE`` and ``WORD``); a cut with any other character goes to a function of the caller, and so does a whole text
where a single space is no certain boundary. What a caller knows of distinct pre-tokens is then put together to
cuts, and cuts to texts, by Arrow's ``take``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of each part of a worker's cache, beside those of one column (bounds memory, never results).
CACHE_ENTRIES = 120_000

BAD, LETTER, DIGIT, SIGN, SPACE, BREAK = range(6)


@dataclass(frozen=True)
class Rule:
    """spaced: a pre-token takes one leading space, and line breaks are pre-tokens; else blanks only separate, digits
    stand alone and capitals become small."""

    spaced: bool


BYTE, WORD = Rule(True), Rule(False)


def _classes() -> np.ndarray:
    """Of bytes below 128. An apostrophe may begin a contraction and < a special token: those cuts aren't plain."""
    out = np.zeros(256, np.uint8)
    for b in range(0x21, 0x7F):
        c = chr(b)
        out[b] = BAD if c in "'<" else LETTER if c.isalpha() else DIGIT if c.isdigit() else SIGN
    out[0x20], out[0x0A] = SPACE, BREAK
    return out


CLASSES = _classes()


def classes(raw: np.ndarray) -> np.ndarray:
    """A class for each byte of UTF-8: Latin letters from U+00C0 to U+00FF are letters, all else beyond ASCII is BAD."""
    out = CLASSES[raw]
    high = np.flatnonzero(raw >= 0x80)
    if len(high):
        b, before = raw[high], raw[np.maximum(high, 1) - 1]
        # 0xD7 and 0xF7, the signs among them, end in 0x97 and 0xB7.
        ok = (b == 0xC3) | ((b < 0xC0) & (before == 0xC3) & (b != 0x97) & (b != 0xB7))
        out[high] = np.where(ok, LETTER, BAD)
    return out


def small(raw: np.ndarray) -> np.ndarray:
    """Capital A-Z and U+00C0 to U+00DE as small letters; right for cuts that are plain."""
    out = raw.copy()
    out[(raw >= 0x41) & (raw <= 0x5A)] += 32
    tail = np.flatnonzero((raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97))
    tail = tail[raw[np.maximum(tail, 1) - 1] == 0xC3]
    out[tail] += 32
    return out


def strings(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends with a leading zero, bytes) of a string or binary array without nulls, from its first byte on."""
    ends = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return ends - ends[0], data[ends[0] : ends[-1]]


def binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class Known:
    """Values of pre-tokens: those met lately (in two halves, of which the older is given up), and longer those that
    were met again."""

    def __init__(self, learn: Callable[[list], list]) -> None:
        self.learn, self.again, self.young, self.old = learn, {}, {}, {}

    def __call__(self, pieces: list) -> list:
        """A value for each distinct piece."""
        if len(self.again) > CACHE_ENTRIES:
            self.again, self.old = {}, self.again
        if len(self.young) > CACHE_ENTRIES:
            self.young, self.old = {}, self.young
        again, young, old = self.again, self.young, self.old
        out = list(map(again.get, pieces))
        new = []
        for i, v in enumerate(out):
            if v is None:
                p = pieces[i]
                v = young.pop(p, None) or old.pop(p, None)
                if v is None:
                    new.append(i)
                else:
                    again[p] = out[i] = v
        for i, v in zip(new, self.learn([pieces[i] for i in new]), strict=True):
            young[pieces[i]] = out[i] = v
        return out


@dataclass
class Texts:
    """pieces: distinct pre-tokens; of: for each cut's pre-tokens in a row their number; cuts: where each distinct cut's
    begin in it; others: texts and cuts for the caller; rows: numbers of cuts, then of others; ends: of each text in rows."""

    pieces: list[bytes]
    of: np.ndarray
    cuts: np.ndarray
    others: list[str]
    rows: np.ndarray
    ends: np.ndarray

    def join(self, values: list[bytes], others: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ends with a leading zero, bytes) of the texts, put together from what stands for pieces and others."""
        ends, data = strings(pa.array(values, pa.binary()).take(pa.array(self.of)))
        table = pa.concat_arrays([binary(ends[self.cuts], data), pa.array([*others, b""], pa.binary())])
        ends, data = strings(table.take(pa.array(self.rows)))
        return ends[self.ends], data


def cut(texts: pa.Array, rule: Rule) -> Texts:
    """texts: strings; null is the empty text."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    lists = pc.split_pattern(texts if rule.spaced else pc.replace_substring(texts, "\n", " "), " ")
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    flat = lists.flatten()
    begin = ends[:-1]
    rest = np.ones(len(flat), bool)
    if rule.spaced:
        rest[begin] = False  # no space before a text's first cut
    coded = (flat.filter(pa.array(rest)) if rule.spaced else flat).dictionary_encode()
    distinct, n = coded.dictionary, len(coded.dictionary)
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if rule.spaced:  # a space before each cut
        distinct = pc.binary_join_element_wise("", distinct, " ") if n else distinct
    word, raw = strings(distinct)
    kind = classes(raw)
    new = np.zeros(len(raw) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    starts, filled = word[:-1], word[1:] > word[:-1]
    bad = np.zeros(n, bool)
    if rule.spaced:
        new[starts + 1] = False  # the space goes with what follows
        last = np.flatnonzero(kind == BREAK)
        new[last[(last + 1 >= len(kind)) | (kind[np.minimum(last + 1, len(kind) - 1)] != BREAK)]] = True  # a run's last break
        if n:
            empty = word[1:] - starts < 2
            edge = np.where(empty, BREAK, kind[np.minimum(starts + 1, len(kind) - 1)]), kind[word[1:] - 1]
            bad = empty | (edge[0] == BREAK) | (edge[1] == BREAK)
    else:
        new[:-1] |= kind == DIGIT
        raw = small(raw)
    new[starts[filled]] = True
    odd = np.flatnonzero((kind == BAD) if rule.spaced else (kind == BAD) | (kind == BREAK))
    other = np.zeros(n, bool)
    other[np.searchsorted(word, odd, "right") - 1] = True
    place = np.flatnonzero(new[:-1])
    of_word = np.searchsorted(word, place, "right") - 1
    good = ~(other | bad)[of_word] if n else np.zeros(0, bool)
    # Runs of cuts for the caller are left out: they may split a character.
    coded = binary(np.append(place, len(raw)), raw).filter(pa.array(good)).dictionary_encode() if len(place) else pa.array([], pa.binary()).dictionary_encode()
    cuts = np.concatenate([[0], np.cumsum(np.bincount(of_word[good], minlength=n))]) if n else np.zeros(1, np.int64)
    others: list[str] = []
    row = np.arange(n)
    for i in np.flatnonzero(other).tolist():
        c = distinct[i].as_py()
        if rule.spaced and (c[1].isspace() or c[-1].isspace()):
            bad[i] = True
            continue
        row[i] = n + len(others)
        others.append(c)
    rows = np.empty(len(flat), np.int64)
    rows[rest] = row[number]
    if rule.spaced and len(texts):
        whole = np.zeros(len(flat), bool)
        whole[rest] = bad[number]
        heads = flat.take(pa.array(begin)).to_pylist()
        parts = np.diff(ends)
        broken = np.logical_or.reduceat(whole, begin)
        empty = -1
        for t, h in enumerate(heads):
            if broken[t] or (parts[t] > 1 and h and h[-1].isspace()):
                rows[begin[t] : ends[t + 1]] = empty
                h = texts[t].as_py()
            rows[begin[t]] = n + len(others)
            others.append(h)
        rows[rows == empty] = n + len(others)  # an empty row after the others
    return Texts(coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), cuts, others, rows, ends)
