"""Best-fit packing of token sequences (operator 1).

Pieces of one length are alike, so the plan is made on the histogram of lengths: at most ``capacity``
numbers, whatever the number of documents. Pieces over a third of the capacity are matched greedily,
the longest with the longest that still fits, at most two in a sequence; shorter ones then go, longest
first, into the tightest gap that holds them. The plan's rows say which ranks of which length go to
which sequences; pieces learn their rank within their length in a second pass over small rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prospectrum.llm import common

#: Ranks of one length are counted in so many shares at least, and in one more for so many pieces.
SHARES, ROWS_A_SHARE = 32, 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long"


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, pieces of the length in each sequence, offset).

    Ranks first..first+ranks-1 of the length fill sequences in a row, that many to each, from the offset.
    Steps depend on the number of distinct lengths, not on the counts."""
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    gaps: list[int] = []  # sorted distinct gaps
    groups: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, sequences)

    def place(length: int, pieces: int, first: int, each: int, offset: int) -> None:
        rows.append((length, used[length], pieces, first, each, offset))
        used[length] += pieces
        left[length] -= pieces

    def open_gap(gap: int, first: int, n: int) -> None:
        if n and gap > 0:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((first, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    live = sorted(large)
    for n in large:
        while left[n]:
            while (i := bisect_left(live, capacity - n + 1) - 1) >= 0 and not left[live[i]]:
                live.pop(i)
            mate = live[i] if i >= 0 else None
            if mate == n and left[n] == 1:  # alone of its length: the next shorter one
                i -= 1
                while i >= 0 and not left[live[i]]:
                    i -= 1
                mate = live[i] if i >= 0 else None
            if mate is None:
                k = left[n]
                place(n, k, sequences, 1, 0)
                open_gap(capacity - n, sequences, k)
            elif mate == n:
                k = left[n] // 2
                place(n, 2 * k, sequences, 2, 0)
                open_gap(capacity - 2 * n, sequences, k)
            else:
                k = min(left[n], left[mate])
                place(n, k, sequences, 1, 0)
                place(mate, k, sequences, 1, n)
                open_gap(capacity - n - mate, sequences, k)
            sequences += k
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect_left(gaps, n)
            if i == len(gaps):
                each = capacity // n
                k, odd = divmod(left[n], each)
                if k:
                    place(n, k * each, sequences, each, 0)
                    open_gap(capacity - each * n, sequences, k)
                    sequences += k
                if odd:
                    place(n, odd, sequences, odd, 0)
                    open_gap(capacity - odd * n, sequences, 1)
                    sequences += 1
                continue
            gap = gaps[i]
            first, m = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(i)
            each = gap // n
            k = min(m, left[n] // each)
            if k:
                place(n, k * each, first, each, capacity - gap)
                open_gap(gap - each * n, first, k)
            if k < m:
                odd = left[n] if left[n] < each else 0
                if odd:
                    place(n, odd, first + k, odd, capacity - gap)
                    open_gap(gap - odd * n, first + k, 1)
                open_gap(gap, first + k + bool(odd), m - k - bool(odd))
    return rows


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row for each piece of each document's ids (with the end id), capacity at most; nth counts a task's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from prospectrum.llm.fast_encode import encoder

        enc, end, nth = encoder("word", tokenizer), np.asarray([end_id], "<u4"), 0
        for b in common.sized(batches, "text"):
            ends, flat = enc.column(b.column("text"))
            sizes = np.diff(ends) + 1
            pieces = -(-sizes // capacity)
            of = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, sizes[of] - start)
            raw = memoryview(np.insert(flat, ends[1:], end)).cast("B")
            first = 4 * ((ends[:-1] + np.arange(len(sizes)))[of] + start)
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.arange(nth, nth + len(of)))], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth"])
            nth += len(of)
        common.give_back()

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, PIECES)


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces, which is read three times. Shares are drawn by the
    rows' numbers, so that equal rows don't meet in one."""
    n = pieces.count()
    shares = max(SHARES, -(-n // ROWS_A_SHARE))
    salted = pieces.withColumn("_share", F.pmod(F.xxhash64("nth", "ids_crc32"), F.lit(shares)).cast("int"))
    per_share = salted.groupBy("length", "_share").agg(F.count(F.lit(1)).alias("_n"))
    # At most capacity lengths, whatever the corpus.
    counts = {r["length"]: r["_n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("_n")).collect()}
    plan = sorted(plan_packing(counts, capacity))
    before = W.partitionBy("length").orderBy("_share").rowsBetween(W.unboundedPreceding, -1)
    starts = per_share.select("length", "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy("length", "_share").orderBy("doc_id", "piece", "ids_crc32", "nth")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_share"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_share", "_before")
    table = np.asarray(plan, np.int64).reshape(-1, 6)
    shift = max(40, int(table[:, 2].max(initial=1)).bit_length() + 1)  # ranks fit below the length
    wide = (table[:, 0].astype(object) * (1 << shift) + table[:, 1]) if shift > 50 else (table[:, 0] << shift) + table[:, 1]
    schema = ranked.drop("_rank")
    names = schema.columns

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            key = (length.astype(object) * (1 << shift) + rank) if shift > 50 else (length << shift) + rank
            at = table[np.searchsorted(wide, key, "right") - 1]
            nth = rank - at[:, 1]
            seq, off = at[:, 3] + nth // at[:, 4], at[:, 5] + nth % at[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    return common.map_arrow(ranked, put, f"{types}, sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A null or empty text is the end id alone. A text of more than ``capacity`` tokens is cut into pieces of
    that length, however long it is; the last may be shorter. Rows that repeat, or share a doc_id or have none, are
    packed each for itself; pieces of one length are alike, so ties of doc_id change who is where, not how many
    sequences there are. An empty table gives an empty result. Extra columns are ignored, whatever their names. The
    tokens are computed once: the pieces (six numbers each) are written to the shared folder before they are counted and ranked."""
    pieces = common.written(cut_pieces(docs, tokenizer, capacity, end_id))
    return place_pieces(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(common.documents(spark, sf_dir), common.tokenizer_file("word_bpe_49k.json"))


QUERIES: dict[str, Callable] = {"op1_best_fit_packing": op1_best_fit_packing}
