"""Removal of repeated word windows with FM-index shards (operator 5).

A shard is a bucket of ``anchors``: the parts of documents (contexts) whose key recurs, so every occurrence of a
repeated window is in its shard; that is a filter, which drops only windows that occur once. The shard's distinct
contexts are indexed: Burrows-Wheeler transform in a wavelet matrix, whose levels are bits in blocks, of which those
that are all zeros or all ones are not stored. Documents' contexts are then streamed right to left through the index,
all in step: backward search keeps the interval of the longest match, which is cut to the window's length at marks
between suffixes that differ in it. Windows whose interval weighs two or more are reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from prospectrum.llm import anchors, common

WINDOW, KEY = 35, 8
CACHE_ENTRIES = 400_000


class Bits:
    """Rank on a row of bits, 64 to a word; words that are all zeros or all ones aren't stored."""

    def __init__(self, bit: np.ndarray) -> None:
        raw = np.packbits(np.concatenate([bit, np.zeros(64 + -len(bit) % 64, np.uint8)]), bitorder="little").view("<u8")
        mixed = (raw != 0) & (raw != ~np.uint64(0))
        # A word's place among the stored ones; the two kinds that aren't come first.
        self.place = np.where(mixed, np.cumsum(mixed) + 1, raw != 0).astype(np.int32)
        self.words = np.concatenate([np.array([0, ~np.uint64(0)], np.uint64), raw[mixed]])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(raw), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[self.place[word]] & low)


class WaveletMatrix:
    """Rank queries on a row of symbols."""

    def __init__(self, row: np.ndarray, symbols: int) -> None:
        self.depth = max(1, int(symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (row >> level & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.base = self.walk(np.arange(symbols), np.zeros(symbols, np.int64)).astype(np.int32)

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bits, zeros, level in zip(self.levels, self.zeros, range(self.depth - 1, -1, -1), strict=True):
            ones = bits.rank(at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self.walk(symbol, at) - self.base[symbol]


class FmIndex:
    """Over contexts of word symbols 1.., each ended by a zero. Suffixes are sorted by their first 64 symbols,
    which is enough for patterns of up to WINDOW + 1."""

    def __init__(self, text: np.ndarray, symbols: int, weight: np.ndarray) -> None:
        n = len(text)
        rank, kept = text.astype(np.int64), None
        for step in (1, 2, 4, 8, 16, 32):
            if step == 32:
                kept = rank
            far = np.zeros(n, np.int64)
            far[: n - step] = rank[step:] + 1
            pair = rank * (n + 2) + far
            order = np.argsort(pair, kind="stable")
            ordered = pair[order]
            new = np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
        far = np.zeros(n, np.int64)
        far[: n - (WINDOW - 32)] = kept[WINDOW - 32 :] + 1
        head, tail = kept[order], far[order]
        new = np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])
        self.mark, self.edges = Bits(new.astype(np.uint8)), np.append(np.flatnonzero(new), n).astype(np.int32)  # suffixes that differ in WINDOW symbols from the one before
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int32)
        self.bwt = WaveletMatrix(text[order - 1].astype(np.int32), symbols)
        self.weight = np.concatenate([[0], np.cumsum(weight[order])])

    def stream(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each place of the text the weight of all occurrences of the window that starts there; 0 where none does."""
        out = np.zeros(len(text), np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[by_size], sizes[by_size]
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(text), np.int64)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t, "left"))  # longer than t
            at = starts[:live] + sizes[:live] - 1 - t
            c = text[at]
            both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo[:live], hi[:live]]))
            lo, hi = self.first[c] + both[:live], self.first[c] + both[live:]
            if t >= WINDOW - 1:
                group = self.mark.rank(lo + 1) - 1  # all suffixes of the interval agree in the window
                lo, hi = self.edges[group], self.edges[group + 1]
                out[at] = self.weight[hi] - self.weight[lo]
        return out


def recurring(contexts: list[bytes], key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (context, first window, windows, occurrences) of the windows that occur more than once."""
    sizes = np.array([len(c) // 8 for c in contexts])
    words, symbol = np.unique(np.frombuffer(b"".join(contexts), np.uint64), return_inverse=True)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    text[np.arange(len(symbol)) + of] = symbol + 1
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    found = FmIndex(text, len(words) + 1, weight[owner]).stream(text, starts, sizes)
    many = found > 1
    new = np.flatnonzero(many & ~np.concatenate([[False], many[:-1] & (owner[1:] == owner[:-1]) & (found[1:] == found[:-1])]))
    stop = np.flatnonzero(many & ~np.concatenate([many[1:] & (owner[1:] == owner[:-1]) & (found[1:] == found[:-1]), [False]]))
    return owner[new], new - starts[owner[new]], stop - new + 1, found[new]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        value = self[word] = xxhash.xxh64_digest(word)
        return value


_HASHES = _Hashes()


def word_units(t: pa.Table) -> list[np.ndarray]:
    """64-bit hashes of each row's words."""
    if len(_HASHES) > CACHE_ENTRIES:
        _HASHES.clear()
    get = _HASHES.__getitem__
    # bytes.split() splits at the six ASCII blanks and nothing else.
    return [np.frombuffer(b"".join(map(get, (x.as_py() or b"").split())), np.uint64) for x in t.column("raw")]


SEARCH = anchors.Search(WINDOW, KEY, word_units, recurring, "count")
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def kept_words(raw: bytes | None, mask: np.ndarray) -> bytes:
    words = (raw or b"").split()
    return b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m] if mask.any() else words)


def digest(t: pa.Table, masks: list[np.ndarray], units: list[np.ndarray]) -> pa.Table:
    kept = [hashlib.sha256(kept_words(r.as_py(), m)).hexdigest() for r, m in zip(t.column("raw"), masks, strict=True)]
    return pa.table([t.column("doc_id"), pa.array([len(u) for u in units], pa.int64()), pa.array([int(m.sum()) for m in masks], pa.int64()), pa.array(kept, pa.string())], schema=DIGEST)


def remaining(t: pa.Table, masks: list[np.ndarray], units: list[np.ndarray]) -> pa.Table:
    texts = [None if r.as_py() is None else kept_words(r.as_py(), m).decode() for r, m in zip(t.column("raw"), masks, strict=True)]
    return pa.table({"doc_id": t.column("doc_id"), "text": pa.array(texts, pa.string()), "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64())})


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text (kept words joined by one space) and n_removed of each row: words covered by a window of 35
    words that also starts anywhere else are gone. Null text stays null; texts of fewer words stay whole;
    repeated rows are occurrences of each other, whatever their doc_id; texts of any length are searched whole, in parts
    that overlap by a window; an empty table gives an empty result; extra columns are ignored."""
    return SEARCH.run(docs, remaining, "doc_id long, text string, n_removed long")


def substring_dedup_digest(docs: DataFrame) -> DataFrame:
    """As substring_dedup, but per row doc_id, n_words, n_removed and kept_sha256; null text has no words."""
    return SEARCH.run(docs, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup_digest(common.documents(spark, sf_dir))


QUERIES: dict[str, Callable] = {"op5_substring_dedup": op5_substring_dedup}
