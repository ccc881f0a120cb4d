"""BPE encoding and decoding by a pair occurrence index (operator 4).

Texts are cut to distinct pre-tokens by whole columns (see ``pretokens``). Those that a partition has not met before are laid out as one row of symbols. An index
maps each pair of neighbours to all its positions. The ranks that occur are applied in ascending order from
a heap; each merge updates the lists of the two pairs it touches. Ranks, vocabulary and byte alphabet come
from the tokenizer's file; the library itself is not used.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.llm import common, pretokens

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_MODELS: dict[str, PairIndexBpe] = {}


def model(path: str) -> PairIndexBpe:
    if path not in _MODELS:
        _MODELS[path] = PairIndexBpe(path)
    return _MODELS[path]


class PairIndexBpe:
    def __init__(self, path: str) -> None:
        from prospectrum.llm.fast_encode import byte_letters

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.of_byte = [vocab[letters[b]] for b in range(256)]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        #: pair of ids -> (rank, id of the merged symbol)
        self.merges = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self.cut = regex.compile(PATTERN).findall
        self.stop = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known = pretokens.Known(self.learn)
        # Fixed value: the pre-tokenizer for which pretokens cuts texts as the pattern does.
        own = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.columns = spec.get("normalizer") is None and spec.get("pre_tokenizer") == own and all("<" in t for t in self.added)

    def apply(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        merges, of_byte = self.merges, self.of_byte
        sym: list[int] = []
        starts = []
        for w in words:
            starts.append(len(sym))
            sym.extend(map(of_byte.__getitem__, w))
            sym.append(-1)  # ends a word: no pair has it
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[tuple[int, int], list[int]] = {}
        for i, pair in enumerate(zip(sym, sym[1:], strict=False)):
            if pair in merges:
                index.setdefault(pair, []).append(i)
        heap = [(merges[p][0], p) for p in index]
        heapq.heapify(heap)
        while heap:
            _, pair = heapq.heappop(heap)
            places = index.pop(pair, None)
            if places is None:
                continue
            a, b = pair
            new = merges[pair][1]
            places.sort()  # left to right, as overlapping pairs of one symbol need
            for i in places:
                j = after[i]
                if sym[i] != a or j >= n or sym[j] != b:
                    continue  # changed since it was listed
                sym[i], sym[j] = new, -2
                k = after[j]
                after[i] = k
                if k < n:
                    before[k] = i
                    right = (new, sym[k])
                    if right in merges:
                        if right in index:
                            index[right].append(i)
                        else:
                            index[right] = [i]
                            heapq.heappush(heap, (merges[right][0], right))
                h = before[i]
                if h >= 0:
                    left = (sym[h], new)
                    if left in merges:
                        if left in index:
                            index[left].append(h)
                        else:
                            index[left] = [h]
                            heapq.heappush(heap, (merges[left][0], left))
        out = []
        for s in starts:
            ids = []
            while sym[s] != -1:
                ids.append(sym[s])
                s = after[s]
            out.append(ids)
        return out

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens; an added token stands for itself."""
        if self.stop is None or not any(t in text for t in self.added):
            return self.cut(text)
        out = []
        for k, part in enumerate(self.stop.split(text)):
            out.extend([part] if k % 2 else self.cut(part))
        return out

    def learn(self, pieces: list[bytes | str]) -> list[tuple[bytes, bytes]]:
        """(decimal ids with a comma after each, decoded bytes) of pre-tokens; an added token comes as a string."""
        coded = iter(self.apply([p for p in pieces if isinstance(p, bytes)]))
        return [self.entry([self.added[p]] if isinstance(p, str) else next(coded)) for p in pieces]

    def entry(self, ids: list[int]) -> tuple[bytes, bytes]:
        return ("".join([f"{i}," for i in ids]).encode(), self.decode(ids))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids; ill-formed UTF-8 is replaced when they become text."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def column(self, texts: pa.Array) -> tuple[pretokens.Texts, list[bytes], list[bytes]]:
        """Cuts of a column, and of each pre-token and then of each other piece its decimal ids and its decoded bytes."""
        if self.columns:
            t = pretokens.cut(texts, pretokens.BYTE)
        else:
            whole = [x or "" for x in texts.to_pylist()]
            t = pretokens.Texts([], np.empty(0, np.int32), np.zeros(1, np.int64), whole, np.arange(len(whole)), np.arange(len(whole) + 1))
        parts = [[p if p in self.added else p.encode() for p in self.pretokens(c)] for c in t.others]
        every = list(dict.fromkeys([*t.pieces, *(p for c in parts for p in c)]))
        found = dict(zip(every, self.known(every), strict=True))
        rows = [[found[p]] for p in t.pieces] + [[found[p] for p in c] for c in parts]
        return t, *([b"".join([e[k] for e in r]) for r in rows] for k in (0, 1))

    def encode(self, text: str | None) -> list[int]:
        pieces = [p if p in self.added else p.encode() for p in self.pretokens(text or "")]
        distinct = list(dict.fromkeys(pieces))
        found = dict(zip(distinct, self.known(distinct), strict=True))
        return [int(x) for p in pieces for x in found[p][0].split(b",")[:-1]]


def digest_batch(bpe: PairIndexBpe, texts: pa.Array | list[str | None]) -> list[tuple[int, str, str]]:
    """(n_tokens, sha256 of the decimal ids, sha256 of the decoded text) of each text."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    t, ids, back = bpe.column(texts)
    n, out = len(t.pieces), []
    rows = [(ends.tolist(), memoryview(data)) for ends, data in (t.join(x[:n], x[n:]) for x in (ids, back))]
    (at, coded), (end, decoded) = rows
    for i in range(len(texts)):
        own = bytes(coded[at[i] : at[i + 1]])
        # Ids do not cross pre-tokens, so the bytes of all ids in a row are those of the pre-tokens in a row.
        text = bytes(decoded[end[i] : end[i + 1]]).decode("utf-8", "replace")
        out.append((own.count(b","), hashlib.sha256(own[:-1]).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


def encode_column(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array<int>) of each whole text; a null or empty text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer)
        for b in common.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.encode(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, ids array<int>")


def decode_column(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of each row's ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer)
        for b in common.slices(batches):
            texts = [None if i is None else bpe.decode(i).decode("utf-8", "replace") for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return common.map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def encode_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256. One pass without a shuffle; null and empty texts
    have no ids; repeated rows give repeated rows; an empty table an empty result; extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer)
        for b in common.sized(batches, "text"):
            n, ids, back = zip(*digest_batch(bpe, b.column("text")), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(common.documents(spark, sf_dir), common.tokenizer_file("byte_bpe_50k.json"))


QUERIES: dict[str, Callable] = {"op4_bpe_round_trip": op4_bpe_round_trip}
