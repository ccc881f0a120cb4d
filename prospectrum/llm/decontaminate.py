"""Benchmark decontamination by winnowing (operator 13).

A window of L words has L - K + 1 runs of K words; the run of least hash in it (the rightmost of equal ones) is its
fingerprint. A document and an item that share a window choose the same run of it, so a join of fingerprints misses
no shared window. Each hit is then extended word by word to both sides, as far as L - K words go: an extended hit of L words
or more is a shared span, and its words are hit. Items shorter than WINDOW words are one window, and each such length
has fingerprints of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.llm import common
from prospectrum.llm.near_copies import bit_words

#: Words of a window, and of a fingerprint where the window has as many.
WINDOW, GRAM = 10, 4
_SEPARATOR = 32
#: A-Z become small letters, ASCII that is no letter or digit a blank; other bytes belong to words.
FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else _SEPARATOR for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.uint64).max


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of a column of texts in a row: bytes (folded), start and end of each word, and first (the number of
    words before each text, with the total at its end)."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        n, offset = len(texts), texts.offset
        ends = np.frombuffer(texts.buffers()[1], np.int64)[offset : offset + n + 1]
        size = int(ends[-1] - ends[0]) if n else 0
        raw = texts.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes() if size else b""
        self.raw = np.frombuffer(raw.translate(FOLD), np.uint8)
        inside = self.raw != _SEPARATOR
        starts = ends[:-1] - ends[0] if n else np.empty(0, np.int64)
        before = np.empty(size, bool)
        before[:1], before[1:] = False, inside[:-1]
        after = np.empty(size, bool)
        after[-1:], after[:-1] = False, inside[1:]
        inner = starts[(starts > 0) & (starts < size)]  # a text's words don't go on in the next
        before[inner] = False
        after[inner - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.append(np.searchsorted(self.start, starts), len(self.start))

    def hashes(self) -> np.ndarray:
        """A 64-bit number of each word: its bytes as digits, mixed."""
        size = self.end - self.start
        if not len(size):
            return np.empty(0, np.uint64)
        powers = np.cumprod(np.append(np.uint64(1), np.full(int(size.max()) - 1, _FACTOR)), dtype=np.uint64)
        out = np.empty(len(size), np.uint64)
        bounds = np.unique(np.append(np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), 1 << 22)), len(size)))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):  # some 4 MB of letters at a time
            own = size[a:b]
            at = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            letters = self.raw[np.repeat(self.start[a:b], own) + at].astype(np.uint64) + np.uint64(1)
            out[a:b] = np.add.reduceat(letters * powers[at], np.cumsum(own) - own)
        return mixed(out)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1, one blank between them."""
        return b" ".join(self.raw[self.start[a] : self.end[b - 1]].tobytes().split()) if b > a else b""


def fingerprints(words: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash): the runs of gram words that are the fingerprint of a window, each once."""
    gram, n = min(gram, window), len(hashes)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        runs = runs * _FACTOR + hashes[k : n - gram + 1 + k]
    runs = mixed(runs + np.uint64(window))
    least, at = runs[: n - window + 1].copy(), np.arange(n - window + 1)
    for k in range(1, window - gram + 1):
        better = runs[k : n - window + 1 + k] <= least
        least[better] = runs[k : n - window + 1 + k][better]
        at[better] = np.flatnonzero(better) + k
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    own = text[: n - window + 1] == text[window - 1 :]  # windows inside one text
    at = np.unique(at[own])
    return at, runs[at]


def contexts(words: Words, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last) of each fingerprint with the window - gram words around it that its text has."""
    gram = min(gram, window)
    text = np.searchsorted(words.first, at, "right") - 1
    return text, np.maximum(words.first[text], at - (window - gram)), np.minimum(words.first[text + 1], at + window)


def extent(mine: list[bytes], i: int, theirs: list[bytes], j: int) -> tuple[int, int]:
    """First and last (exclusive) word of mine of the equal stretch around mine[i] and theirs[j]; empty if these differ."""
    a, b, x, y = i, i, j, j
    while a > 0 and x > 0 and mine[a - 1] == theirs[x - 1]:
        a, x = a - 1, x - 1
    while b < len(mine) and y < len(theirs) and mine[b] == theirs[y]:
        b, y = b + 1, y + 1
    return a, b


def benchmark_prints(bench: DataFrame, window: int, gram: int) -> DataFrame:
    """(window, hash, lead, context, items): each context once, with the sorted ids of the items that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sized(batches, "text"):
            ids = b.column("item_id").to_pylist()
            for k, raw in enumerate(b.column("text").to_pylist()):
                words = Words(pa.array([raw], pa.large_binary()))
                own = min(window, len(words.start))
                at, hashes = fingerprints(words, words.hashes(), own, gram) if own else (np.empty(0, np.int64), np.empty(0, np.uint64))
                _, a, z = contexts(words, at, own, gram)
                rows = [words.text(x, y) for x, y in zip(a.tolist(), z.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), own, np.int32)), pa.array(hashes.view(np.int64)), pa.array((at - a).astype(np.int32)), pa.array(rows, pa.binary()), pa.array([ids[k]] * len(at), pa.int64())], names=["window", "hash", "lead", "context", "item_id"])

    rows = common.map_arrow(bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")), run, "window int, hash long, lead int, context binary, item_id long")
    return rows.groupBy("window", "hash", "lead", "context").agg(F.collect_set("item_id").alias("items"))


def suspects(docs: DataFrame, lengths: list[int], bits: np.ndarray, gram: int) -> DataFrame:
    """All columns of docs but text, with row (a number of the row), n_words and found: the fingerprints whose bit is set, with
    their context. bits: 64-bit words; a number's bit is given by its last bits."""
    keep, kinds, mask = [c for c in docs.columns if c != "text"], dict(docs.dtypes), np.int64(len(bits) * 64 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sized(batches, "text"):
            words = Words(b.column("text"))
            hashes, found = words.hashes(), []
            for window in lengths:
                at, h = fingerprints(words, hashes, window, gram)
                h = h.view(np.int64)
                told = (bits[(h & mask) >> 6] >> (h & 63) & 1).astype(bool)
                at, h = at[told], h[told]
                text, a, z = contexts(words, at, window, gram)
                found += [(t, {"window": window, "hash": x, "lead": i - p, "first": p - int(words.first[t]), "context": words.text(p, q)}) for t, x, i, p, q in zip(text.tolist(), h.tolist(), at.tolist(), a.tolist(), z.tolist(), strict=True)]
            rows: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for t, hit in found:
                rows[t].append(hit)
            kind = pa.list_(pa.struct([("window", pa.int32()), ("hash", pa.int64()), ("lead", pa.int32()), ("first", pa.int64()), ("context", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.diff(words.first)), pa.array(rows, kind)], names=[*keep, "n_words", "found"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_words long", "found array<struct<window: int, hash: long, lead: int, first: long, context: binary>>"])
    out = common.map_arrow(docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").cast("binary").alias("text")), run, schema)
    return common.written(out.withColumn("row", F.monotonically_increasing_id()))  # the numbers hold, as the table is written


def decontaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, spans (array of start and end in words: the hit stretches, merged,
    in order), items (sorted ids of the items of which a window occurs).

    bench: (item_id, text). Null and empty texts have no words: as documents they have no hit, as items no window. An item
    without id hits words and is not among items; items that repeat count once. Rows that repeat and rows without
    doc_id are documents each. A word inside several spans counts once. Texts of any length are looked at whole, and a
    fingerprint that a large share of documents hold is a skewed join, which Spark splits. Empty tables give no rows or no
    hits. Extra columns are ignored."""
    common.ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = common.written(benchmark_prints(bench, window, gram))
    lengths = sorted(r[0] for r in prints.select("window").distinct().collect())  # window numbers at most
    words, size = bit_words(prints, "hash", prints.count())
    bits = np.zeros(size // 64, np.int64)
    for r in words.collect():  # bounded by near_copies.MOST_BITS: 2 MB
        bits[r["word"]] = r["bits"]
    seen = suspects(docs, lengths, bits, gram)

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sized(batches, "context", 1 << 20):
            rows = zip(*(b.column(c).to_pylist() for c in ("window", "lead", "first", "context", "lead_b", "context_b")), strict=True)
            spans = [(f + a, f + z, z - a >= w) for w, i, f, mine, j, theirs in rows for a, z in [extent(mine.split(), i, theirs.split(), j)]]
            start, end, ok = (np.array([s[k] for s in spans], t) for k, t in ((0, np.int64), (1, np.int64), (2, bool)))
            got = pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("n_words"), pa.array(start), pa.array(end), b.column("items")], names=["row", "doc_id", "n_words", "start", "end", "items"])
            yield got.filter(pa.array(ok))

    held = seen.where(F.size("found") > 0).select("row", "doc_id", "n_words", F.inline("found"))
    met = held.hint("merge").join(prints.select("window", "hash", F.col("lead").alias("lead_b"), F.col("context").alias("context_b"), "items"), ["window", "hash"])
    hits = common.map_arrow(met.select("row", "doc_id", "n_words", "window", "lead", "first", "context", "lead_b", "context_b", "items"), extended, "row long, doc_id long, n_words long, start long, end long, items array<long>")
    per_row = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("raw"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    last = "element_at(s, -1)"
    merged = F.expr(
        f"aggregate(raw, array(), (s, x) -> if(size(s) > 0 and x.start <= {last}.end, "
        f"concat(slice(s, 1, size(s) - 1), array(named_struct('start', {last}.start, 'end', greatest({last}.end, x.end)))), concat(s, array(x))))".replace("array(),", "cast(array() as array<struct<start: bigint, end: bigint>>),")
    )
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    per_row = per_row.select("row", merged.alias("spans"), "items")
    clear = seen.where(F.size("found") == 0).select("doc_id", "n_words", none.alias("spans"), F.expr("cast(array() as array<bigint>)").alias("items"))
    rest = seen.where(F.size("found") > 0).select("row", "doc_id", "n_words").join(per_row, "row", "left")
    return clear.unionByName(rest.select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items")))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminated(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES: dict[str, Callable] = {"op13_decontamination": op13_decontamination}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op13_decontamination": f"""
with items as (select item_id, {_WORDS} as w from benchmark where text is not null),
windows as (
  select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as words
  from (select item_id, w, least(len(w), {WINDOW}) as size, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as i from items where len(w) > 0)),
docs as (select row_number() over () as r, doc_id, case when text is null then [] else {_WORDS} end as w from documents),
sizes as (select distinct size from windows),
spots as (select r, size, i, array_to_string(w[i:i + size - 1], ' ') as words from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, sizes)),
found as (select r, item_id, i, s.size from spots s join windows v on s.size = v.size and s.words = v.words),
hit as (select r, count(distinct place) as n_hit from (select r, unnest(range(i, i + size)) as place from (select distinct r, i, size from found)) group by r),
named as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, cast(item_id as varchar) as id from found where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)"""
}
