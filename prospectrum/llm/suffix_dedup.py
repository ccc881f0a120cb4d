"""Removal of repeated byte strings with range-partitioned suffix arrays (operator 3).

Suffixes are those that can repeat: the strings of contexts whose key recurs (see ``anchors``); that is a filter,
which drops only strings that occur once. Sampled splitters deal contexts to buckets by the leading bytes at their
key. A bucket sorts its suffixes by multikey quicksort; strings that agree in all bytes form a class, whose least
doc_id decides. A splitter is as long as a key, and equal strings have equal keys at equal places: so the strings on
the two sides of a bucket's boundary differ in their keys, and comparing across it could find nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.llm import anchors, common

SIZE, KEY = 50, 16
#: Groups of up to so many strings are sorted without a pivot.
FEW = 32_768
SAMPLE_BYTES = 1_000_000


def letters(b: np.ndarray, at: np.ndarray, depth: np.ndarray, size: int) -> np.ndarray:
    """Eight bytes of each string from its depth on as one number, bytes beyond the string's end as zeros."""
    out = b[at + depth].view(">u8").ravel().astype(np.uint64)
    last = np.flatnonzero(depth + 8 > size)
    if len(last):
        beyond = (depth[last] + 8 - size).astype(np.uint64) * np.uint64(8)
        out[last] = out[last] >> beyond << beyond
    return out


def partitioned(of: np.ndarray, side: np.ndarray, groups: int) -> np.ndarray:
    """The order that puts the members of each group, which stand together, below, at and above its pivot."""
    key = 3 * of + side.astype(np.int64)
    counts = np.bincount(key, minlength=3 * groups)
    start = np.cumsum(counts) - counts
    order = np.empty(len(of), np.int64)
    for s in range(3):
        own = np.flatnonzero(side == s)
        before = np.cumsum(counts[s::3]) - counts[s::3]
        order[(start[s::3] - before)[of[own]] + np.arange(len(own))] = own
    return order


def sorted_classes(buffer: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Classes of two or more equal strings buffer[i:i+size], i in at, as indexes into at; they are sorted by multikey
    quicksort with eight bytes for a letter.

    A group of strings that agree up to its depth is split at a pivot letter into those below, at and above it;
    those at it go eight bytes deeper. All groups are split in step. Groups of up to FEW are sorted letter by letter."""
    # Letters are gathered for live strings only; all places' letters would take eight times the buffer.
    b = np.lib.stride_tricks.sliding_window_view(np.concatenate([buffer, np.zeros(size + 8, np.uint8)]), 8)
    many = len(at) > 1
    live, sizes, depth = np.arange(len(at) if many else 0), np.array([len(at)] * many, np.int64), np.zeros(int(many), np.int64)
    found: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    aside: list[tuple[np.ndarray, ...]] = []

    def split(new: np.ndarray, deeper: np.ndarray) -> None:
        """Goes on with the groups that new begins, each deeper or not; whole strings are classes."""
        nonlocal live, sizes, depth
        start = np.flatnonzero(new)
        sizes = np.diff(np.append(start, len(live)))
        depth = deeper[start]
        done = (depth >= size) & (sizes > 1)
        if done.any():
            found.append(live[np.repeat(done, sizes)])
            ends.append(sizes[done])
        go = (sizes > 1) & ~done
        live, sizes, depth = live[np.repeat(go, sizes)], sizes[go], depth[go]

    while len(live):
        few = sizes <= FEW
        if few.any():
            aside.append((live[np.repeat(few, sizes)], sizes[few], depth[few]))
            live, sizes, depth = live[np.repeat(~few, sizes)], sizes[~few], depth[~few]
            if not len(live):
                break
        of = np.repeat(np.arange(len(sizes)), sizes)
        letter = letters(b, at[live], depth[of], size)
        first = np.cumsum(sizes) - sizes
        # The middle one of three letters of each group is its pivot.
        pivot = np.sort(np.stack([letter[first], letter[first + sizes // 2], letter[first + sizes - 1]]), axis=0)[1][of]
        side = (letter >= pivot).astype(np.uint8) + (letter > pivot)
        order = partitioned(of, side, len(sizes))
        live, side = live[order], side[order]
        split(np.concatenate([[True], (of[1:] != of[:-1]) | (side[1:] != side[:-1])]), depth[of] + 8 * (side == 1))
    if aside:
        live, sizes, depth = (np.concatenate(x) for x in zip(*aside, strict=True))
    while len(live):
        of = np.repeat(np.arange(len(sizes)), sizes)
        letter = letters(b, at[live], depth[of], size)
        order = np.lexsort((letter, of)) if len(sizes) > 1 else np.argsort(letter)
        live, letter = live[order], letter[order]
        split(np.concatenate([[True], (of[1:] != of[:-1]) | (letter[1:] != letter[:-1])]), depth[of] + 8)
    if not found:
        return []
    sizes = np.concatenate(ends)
    return [np.concatenate(found), np.cumsum(sizes) - sizes]


def least_ids(contexts: list[bytes], key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (context, first string, strings, least doc_id of equal strings) of all strings of all contexts."""
    sizes = np.array([len(c) for c in contexts])
    strings = sizes - SIZE + 1
    of = np.repeat(np.arange(len(contexts)), strings)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = np.repeat(np.cumsum(sizes) - sizes, strings) + nth
    value = weight[of]
    found = sorted_classes(np.frombuffer(b"".join(contexts), np.uint8), at, SIZE)
    if found:
        live, first = found
        least = np.minimum.reduceat(value[live], first)
        value[live] = np.repeat(least, np.diff(np.append(first, len(live))))
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (value[1:] != value[:-1])]))
    return of[new], nth[new], np.diff(np.append(new, len(of))), value[new]


def raw_units(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", np.uint8) for x in t.column("raw").to_pylist()]


SEARCH = anchors.Search(SIZE, KEY, raw_units, least_ids, "id")


def sampled_splitters(docs: DataFrame, buckets: int, n_bytes: int) -> np.ndarray:
    """Leading bytes that cut a bounded sample of suffixes into equal shares. They balance; results don't depend on them."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer((x or b"")[:20_000], np.uint8) for x in b.column("raw").to_pylist()]
            for units, key, at, n, _ in anchors.contexts_of(own, SIZE, KEY):
                data = [units[s : s + m + SIZE - 1].tobytes() for s, m in zip(at.tolist(), n.tolist(), strict=True)]
                if data:
                    yield pa.RecordBatch.from_arrays([pa.array(anchors.leading(data, key, SIZE, KEY)[::8].tolist(), pa.binary())], names=["lead"])

    part = docs.select(F.col("text").cast("string").cast("binary").alias("raw")).sample(min(1.0, SAMPLE_BYTES / max(1, n_bytes)), seed=5)
    common.ship(docs.sparkSession)
    got = np.sort(np.array([r[0] for r in part.mapInArrow(lead, "lead binary").limit(50_000).collect()], f"S{KEY}"))
    cut = np.unique(got[np.linspace(0, len(got), buckets, endpoint=False).astype(int)[1:]]) if len(got) else got
    return cut


def spans_of(mask: np.ndarray) -> int:
    return int(np.count_nonzero(np.diff(np.concatenate([[0], mask.astype(np.int8)])) == 1))


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def digest(t: pa.Table, masks: list[np.ndarray], units: list[np.ndarray]) -> pa.Table:
    kept = [hashlib.sha256(u[~m].tobytes()).hexdigest() for m, u in zip(masks, units, strict=True)]
    return pa.table([t.column("doc_id"), pa.array([len(u) for u in units], pa.int64()), pa.array([int(m.sum()) for m in masks], pa.int64()), pa.array([spans_of(m) for m in masks], pa.int64()), pa.array(kept, pa.string())], schema=DIGEST)


def remaining(t: pa.Table, masks: list[np.ndarray], units: list[np.ndarray]) -> pa.Table:
    texts = [None if r is None else u[~m].tobytes().decode("utf-8", "ignore") for r, m, u in zip(t.column("raw").to_pylist(), masks, units, strict=True)]
    spans = []
    for m in masks:
        edge = np.diff(np.concatenate([[0], m.astype(np.int8), [0]]))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
    return pa.table({"doc_id": t.column("doc_id"), "text": pa.array(texts, pa.string()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "rest": t.column("rest")})


def run(docs: DataFrame, finish: Callable, schema: str, rest: list[str] | None = None) -> DataFrame:
    n_bytes = common.text_bytes(docs)
    splitters = sampled_splitters(docs, anchors.SPLIT * common.groups_for(n_bytes), n_bytes)
    return SEARCH.run(docs, finish, schema, splitters, rest)


def suffix_array_dedup(docs: DataFrame) -> DataFrame:
    """Documents without each byte that a 50-byte string covers which also starts in a document of smaller doc_id.

    Adds ``removed``, the spans (start, end) of bytes taken out of the text's UTF-8; keeps the other columns. A
    character cut by a span's border goes with it. Null text stays null and short texts stay whole. Documents
    of equal doc_id, repeated rows among them, do not remove from each other; a null doc_id counts as larger than all.
    Texts of any length are searched whole, in parts that overlap by a string. Other columns may have any names; one
    named ``removed`` is replaced. An empty table gives an empty result."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "removed")]
    kinds = dict(docs.dtypes)
    inner = "string" if not rest else "struct<" + ",".join(f"c{i}:{kinds[c]}" for i, c in enumerate(rest)) + ">"
    out = run(docs, remaining, f"doc_id long, text string, removed array<struct<start: long, end: long>>, rest {inner}", rest)
    return out.select("doc_id", "text", *([F.col(f"rest.c{i}").alias(c) for i, c in enumerate(rest)]), "removed")


def suffix_dedup_digest(docs: DataFrame) -> DataFrame:
    """As suffix_array_dedup, but per row doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the bytes kept
    (which may split a character). Null text is empty; an empty table gives an empty result."""
    return run(docs, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup_digest(common.documents(spark, sf_dir))


QUERIES: dict[str, Callable] = {"op3_suffix_dedup": op3_suffix_dedup}
