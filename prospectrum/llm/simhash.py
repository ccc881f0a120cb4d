"""SimHash near-duplicates by a byte-position inverted index with count filtering (operator 10).

Fingerprints at three or fewer differing bits differ in at most three of eight bytes, so they share five
positional bytes or more. Any five of the eight positions hold three from one half, so the index has a list
for each of the eight triples of positions inside a half and each value of its three bytes. Two fingerprints
that meet in a list have their shared positional bytes tallied; pairs under five are dropped, the rest verified.
Equal fingerprints are one entry. A list's links come out as a spanning forest of its linked entries, not as
all pairs: what is linked within a list is linked in the forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.llm import common
from prospectrum.llm.components import components

BITS, SHARED, SEED, SHINGLE = 3, 5, 42, 3
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Entries of the index that a bucket gets.
BUCKET_ROWS = 200_000
#: Lists up to this length are compared in step, longer ones one by one.
SHORT = 24
#: Ids from here on stand for fingerprints that only rows without doc_id have.
NO_ID = 1 << 62


def shingles(raw: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The digests (8 bytes each) of XXH64 of all runs of so many words; of fewer words there is one; none without."""
    words = (raw or b"").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.empty((0, 8), np.uint8)
    if len(words) <= shingle:
        hashes = xxhash.xxh64_digest(b" ".join(words), SEED)
    else:
        text = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(text[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)])
    return np.frombuffer(hashes, np.uint8).reshape(-1, 8)


def majority(rows: np.ndarray) -> int:
    """64 majority bits of digests; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 4096):
        ones += np.unpackbits(rows[at : at + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big")


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """64 majority bits of the shingles' XXH64; 0 without words."""
    return majority(shingles(raw, shingle))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            fp = np.array([fingerprint(x) for x in b.column("raw").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw")), run, "doc_id long, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes of each difference: positional bytes that a pair shares."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs pass the count filter and the check of their bits."""
    x = a ^ b
    ok = shared_bytes(x) >= SHARED
    ok[ok] = np.bitwise_count(x[ok]) <= BITS
    return ok


def forest(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (indexes) that connect what is linked within each list; key is sorted."""
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    sizes = np.diff(np.append(new, len(key)))
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    for step in range(1, SHORT):
        i = np.flatnonzero((size_of[:-step] <= SHORT) & (key[step:] == key[:-step])) if len(key) > step else np.empty(0, np.int64)
        if not len(i):
            break
        i = i[linked(fp[i], fp[i + step])]
        left.append(i)
        right.append(i + step)
    for first, n in zip(new[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
        rest = np.arange(first, first + n)
        while len(rest):
            wave, rest = [int(rest[0])], rest[1:]
            while wave and len(rest):
                at = wave.pop()
                hit = linked(fp[rest], np.broadcast_to(fp[at], len(rest)))
                got = rest[hit]
                if len(got):
                    left.append(np.full(len(got), at))
                    right.append(got)
                    wave += got.tolist()
                    rest = rest[~hit]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): rep pairs that connect linked fingerprints of distinct (fp, rep)."""
    n = distinct.count()
    buckets = max(16, -(-n * len(TRIPLES) // BUCKET_ROWS))

    def value(triple: tuple[int, ...]) -> F.Column:
        out = F.lit(TRIPLES.index(triple)).cast("long")
        for k in triple:
            out = out * 256 + F.shiftright("fp", 8 * (7 - k)).bitwiseAND(255)
        return out

    entries = distinct.select("fp", "rep", F.explode(F.array(*map(value, TRIPLES))).alias("key"))
    dealt = entries.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        key, fp, rep = (t.column(c).combine_chunks().to_numpy() for c in ("key", "fp", "rep"))
        order = np.argsort(key, kind="stable")
        key, fp, rep = key[order], fp[order].view(np.uint64), rep[order]
        a, b = forest(key, fp)
        return pa.table({"a": rep[a], "b": rep[b]})

    common.ship(distinct.sparkSession)
    return dealt.groupBy("bucket").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links reach.

    Null and empty texts have fingerprint zero and link like any other. Rows without doc_id take part, but
    give no component id. Repeated rows share theirs, and so do different texts of equal fingerprints; half of the
    shingles is no majority, so a tie leaves a bit at 0. A text of any length is hashed whole, 4,096 shingles at a
    time. An empty table gives an empty result; extra columns are ignored."""
    rows = common.written(fingerprints(docs))
    n = rows.count()
    distinct = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")).select("fp", F.coalesce("rep", F.lit(NO_ID) + F.pmod(F.xxhash64("fp"), F.lit(1 << 60))).alias("rep")), rows=n)
    roots = components(links(distinct), n).withColumnRenamed("node", "rep")
    classes = distinct.join(roots, "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


QUERIES: dict[str, Callable] = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
