"""Exact search for strings of a fixed length that occur more than once, in bounded groups.

A string of L units has a *key*: the k-gram in it whose hash is least (the leftmost of equals). Equal strings
have equal keys at equal places, so all occurrences of a string meet under its key. Neighbouring strings mostly
share their key's place; together they form a *context*. Five passes, of which each sees one bounded group:

1. text group: the distinct keys of its documents, dealt to buckets;
2. bucket: keys that occur more than once, sent back to the groups that have them;
3. text group: the contexts of those keys, equal ones once, dealt to buckets;
4. bucket: an index over the contexts (suffix array or FM-index) finds which strings recur; sent back;
5. text group: recurring strings cover units of documents.

Groups are dealt by a hash of doc_id and text and are as many as the text needs. A key or context reaches a bucket once
from each text group, however often it occurs there: a third of all rows being copies of one text adds one
context per key and group. Rows are arrays in binary columns: a row for each pair of group and bucket that
have something to tell each other, so never more rows than keys.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectrum.llm import common

CHUNK = 1 << 19  # units that are hashed at a time
LONG = 1 << 20  # documents from this length on are cut; places in a chunk take 20 bits
NO_ID = np.iinfo(np.int64).max
BLOCK = 1 << 14  # contexts whose leading bytes are found at a time
SPLIT = 4  # buckets of contexts for each text group: an index over them takes many times their bytes
_RNG = np.random.default_rng(20)
BYTE_HASH = _RNG.integers(0, 2**64, 256, np.uint64)
STEPS = _RNG.integers(0, 2**63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    return h


def kgram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-grams that start at each place (k a power of two)."""
    h = BYTE_HASH[units] if units.dtype == np.uint8 else mixed(units)
    n = 1
    for step in STEPS:
        if n == k:
            break
        h = h[:-n] * step + h[n:] if len(h) > n else h[:0]
        n *= 2
    return mixed(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def anchors(units: np.ndarray, ends: np.ndarray, size: int, k: int) -> tuple[np.ndarray, ...]:
    """Of documents in a row, which end at ``ends``: for each context its key, first string and number of strings."""
    empty = np.empty(0, np.int64)
    if len(units) < size:
        return np.empty(0, np.uint64), empty, empty
    h = kgram_hashes(units, k)
    order = h & ~np.uint64(0xFFFFF) | np.arange(len(h), dtype=np.uint64)
    owner = (sliding_min(order, size - k + 1) & np.uint64(0xFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    flag = np.zeros(len(owner) + 1, np.int32)  # strings inside one document
    long = ends - starts >= size
    np.add.at(flag, starts[long], 1)
    np.add.at(flag, ends[long] - size + 1, -1)
    inside = np.flatnonzero(np.cumsum(flag[:-1]))
    if not len(inside):
        return np.empty(0, np.uint64), empty, empty
    owner = owner[inside]
    new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return h[owner[new]], inside[new], np.diff(np.append(new, len(inside)))


def chunks(docs: list[np.ndarray], size: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Documents in a row, up to CHUNK units; longer ones alone: (numbers, units, ends)."""
    own: list[int] = []
    held = 0
    for i, d in enumerate(docs):
        if own and held + len(d) > CHUNK:
            yield own, np.concatenate([docs[j] for j in own]), np.cumsum([len(docs[j]) for j in own])
            own, held = [], 0
        if len(d) >= size:
            own.append(i)
            held += len(d)
    if own:
        yield own, np.concatenate([docs[j] for j in own]), np.cumsum([len(docs[j]) for j in own])


def contexts_of(docs: list[np.ndarray], size: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunk by chunk: units, and for each context its key, first string (in the units), strings, document."""
    for own, units, ends in chunks(docs, size):
        if len(units) < LONG:
            key, at, n = anchors(units, ends, size, k)
            yield units, key, at, n, np.array(own)[np.searchsorted(ends, at, "right")]
            continue
        for start in range(0, len(units) - size + 1, CHUNK):  # a long document: strings from start on
            part = units[start : start + CHUNK + size - 1]
            key, at, n = anchors(part, np.array([len(part)]), size, k)
            yield part, key, at, n, np.full(len(key), own[0]) + 0 * at


def long_offsets(docs: list[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """For each yield of contexts_of: where each document starts in the chunk's units (negative: before)."""
    for own, units, ends in chunks(docs, size):
        if len(units) < LONG:
            start = np.zeros(len(docs), np.int64)
            start[own] = np.concatenate([[0], ends[:-1]])
            yield start
            continue
        for at in range(0, len(units) - size + 1, CHUNK):
            start = np.zeros(len(docs), np.int64)
            start[own[0]] = -at
            yield start


def packed_rows(**columns: list) -> pa.Table:
    kinds = {"bucket": pa.int32(), "p": pa.int32()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in columns.items()})


def cut_by(values: np.ndarray, buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Indexes by bucket, in their order."""
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.diff(buckets[order])) + 1
    for own in np.split(order, edges) if len(order) else []:
        yield int(buckets[own[0]]), values[own]


def lean(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """fn for a group, after which the worker gives back the memory it no longer uses: workers live on between stages."""

    def run(t: pa.Table) -> pa.Table:
        out = fn(t)
        common.give_back()
        return out

    return run


def lean2(fn: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """As lean, for two sides."""

    def run(t: pa.Table, other: pa.Table) -> pa.Table:
        out = fn(t, other)
        common.give_back()
        return out

    return run


class Search:
    """size: units of a string; k: units of a key; docs_of(table) -> units of each row; bucket_of(keys, contexts'
    leading units) for pass 4; solve(contexts) for pass 4; weigh: what is kept of equal contexts in a group."""

    def __init__(self, size: int, k: int, units_of: Callable[[pa.Table], list[np.ndarray]], solve: Callable, weigh: str) -> None:
        self.size, self.k, self.units_of, self.solve, self.weigh = size, k, units_of, solve, weigh

    def keys(self, buckets: int) -> Callable[[pa.Table], pa.Table]:
        """Pass 1."""

        def run(t: pa.Table) -> pa.Table:
            p = t.column("_p")[0].as_py()
            got = [c[1] for c in contexts_of(self.units_of(t), self.size, self.k)]
            key, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.empty(0, np.uint64), np.empty(0, np.int64))
            out: dict[str, list] = {"bucket": [], "p": [], "once": [], "more": []}
            for b, own in cut_by(np.arange(len(key)), (key % np.uint64(buckets)).astype(np.int64)):
                out["bucket"].append(b)
                out["p"].append(p)
                out["once"].append(key[own[n[own] == 1]].tobytes())
                out["more"].append(key[own[n[own] > 1]].tobytes())
            return packed_rows(**out)

        return run

    @staticmethod
    def repeated(t: pa.Table) -> pa.Table:
        """Pass 2."""
        p = t.column("p").to_pylist()
        once = [np.frombuffer(x, np.uint64) for x in t.column("once").to_pylist()]
        more = [np.frombuffer(x, np.uint64) for x in t.column("more").to_pylist()]
        known = np.unique(np.concatenate(more))
        every = np.concatenate([*once, known])
        every.sort()
        again = np.union1d(every[1:][every[1:] == every[:-1]], known)
        out: dict[str, list] = {"p": [], "keys": []}
        for i, a, b in zip(p, once, more, strict=True):
            own = np.concatenate([a[np.isin(a, again, assume_unique=True)], b])
            if len(own):
                out["p"].append(i)
                out["keys"].append(own.tobytes())
        return packed_rows(**out)

    def contexts(self, buckets: int, splitters: np.ndarray | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
        """Pass 3. Equal contexts of the group meet in one entry, with the least and greatest id or a count."""

        def run(t: pa.Table, keys: pa.Table) -> pa.Table:
            out: dict[str, list] = {c: [] for c in ("bucket", "p", "key", "hash", "data", "ends", "low", "high")}
            if not t.num_rows or not keys.num_rows:
                return packed_rows(**out)
            wanted = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in keys.column("keys").to_pylist()]))
            ids = doc_ids(t)
            # Numbers stand in flat arrays beside the dictionary: a group has hundreds of thousands of contexts.
            seen: dict[bytes, int] = {}
            keys_, least, most, times = array("Q"), array("q"), array("q"), array("q")
            for units, key, at, n, doc in contexts_of(self.units_of(t), self.size, self.k):
                own = np.flatnonzero(is_in(key, wanted))
                width = units.itemsize
                raw = memoryview(units).cast("B") if len(units) else b""
                for x, s, m, d in zip(key[own].tolist(), at[own].tolist(), n[own].tolist(), ids[doc[own]].tolist(), strict=True):
                    c = bytes(raw[s * width : (s + m + self.size - 1) * width])
                    i = seen.setdefault(c, len(times))
                    if i == len(times):
                        keys_.append(x)
                        least.append(d)
                        most.append(d)
                        times.append(1)
                    else:
                        least[i], most[i], times[i] = min(least[i], d), max(most[i], d), times[i] + 1
            if not seen:
                return packed_rows(**out)
            data = list(seen)
            del seen
            key, low, high = np.frombuffer(keys_, np.uint64), np.frombuffer(least if self.weigh == "id" else times, np.int64), np.frombuffer(most, np.int64)
            digest = np.array([xxhash.xxh64_intdigest(c) for c in data], np.uint64)
            if splitters is None:
                bucket = (key % np.uint64(buckets)).astype(np.int64)
            else:
                bucket = np.searchsorted(splitters, leading(data, key, self.size, self.k), "right")
            p, pack = t.column("_p")[0].as_py(), zstandard.ZstdCompressor(level=3)
            for b, own in cut_by(np.arange(len(data)), bucket):
                out["bucket"].append(b)
                out["p"].append(p)
                out["key"].append(key[own].tobytes())
                out["hash"].append(digest[own].tobytes())
                out["data"].append(pack.compress(b"".join([data[i] for i in own.tolist()])))
                out["ends"].append(np.cumsum([len(data[i]) for i in own.tolist()], dtype=np.int64).tobytes())
                out["low"].append(low[own].tobytes())
                out["high"].append(high[own].tobytes())
            return packed_rows(**out)

        return run

    def solved(self) -> Callable[[pa.Table], pa.Table]:
        """Pass 4: solve() gives, for each distinct context, runs of its strings with what was found."""

        def run(t: pa.Table) -> pa.Table:
            cols = {c: t.column(c).to_pylist() for c in ("p", "key", "hash", "data", "ends", "low", "high")}
            number: dict[bytes, int] = {}
            of, low, high, group, key, digest = [], [], [], [], [], []
            unpack = zstandard.ZstdDecompressor()
            for g in range(t.num_rows):
                at = 0
                ends = np.frombuffer(cols["ends"][g], np.int64).tolist()
                data = unpack.decompress(cols["data"][g])
                for e in ends:
                    of.append(number.setdefault(data[at:e], len(number)))
                    at = e
                group += [g] * len(ends)
                for into, c, kind in ((low, "low", np.int64), (high, "high", np.int64), (key, "key", np.uint64), (digest, "hash", np.uint64)):
                    into.append(np.frombuffer(cols[c][g], kind))
            of_, group_ = np.array(of), np.array(group)
            low_, high_, key_, digest_ = map(np.concatenate, (low, high, key, digest))
            weight = np.full(len(number), NO_ID, np.int64) if self.weigh == "id" else np.zeros(len(number), np.int64)
            (np.minimum if self.weigh == "id" else np.add).at(weight, of_, low_)
            first_key = np.zeros(len(number), np.uint64)
            first_key[of_] = key_
            ctx, start, length, value = self.solve(list(number), first_key, weight)
            # A row for each entry of each group and each run of its context that concerns it.
            order = np.argsort(of_, kind="stable")
            edges = np.searchsorted(of_[order], np.arange(len(number) + 1))
            copies = (edges[1:] - edges[:-1])[ctx]
            run_of = np.repeat(np.arange(len(ctx)), copies)
            entry = order[np.repeat(edges[ctx] - np.concatenate([[0], np.cumsum(copies)[:-1]]), copies) + np.arange(len(run_of))] if len(ctx) else np.empty(0, np.int64)
            if self.weigh == "id":
                told = value[run_of] < high_[entry]
                run_of, entry = run_of[told], entry[told]
            out: dict[str, list] = {c: [] for c in ("p", "key", "hash", "start", "length", "value")}
            for g, own in cut_by(np.arange(len(entry)), group_[entry]):
                out["p"].append(cols["p"][g])
                out["key"].append(key_[entry[own]].tobytes())
                out["hash"].append(digest_[entry[own]].tobytes())
                out["start"].append(start[run_of[own]].astype(np.int32).tobytes())
                out["length"].append(length[run_of[own]].astype(np.int32).tobytes())
                out["value"].append(value[run_of[own]].tobytes())
            return packed_rows(**out)

        return run

    def covered(self, t: pa.Table, told: pa.Table, docs: list[np.ndarray]) -> list[np.ndarray]:
        """Pass 5: for each row a mask of the units that a recurring string covers."""
        sizes = np.array([len(d) + 1 for d in docs], np.int64)
        base = np.cumsum(sizes) - sizes
        edges = np.zeros(int(sizes.sum()), np.int32)
        if told.num_rows:
            kinds = {"key": np.uint64, "hash": np.uint64, "start": np.int32, "length": np.int32, "value": np.int64}
            got = {c: np.concatenate([np.frombuffer(x, k) for x in told.column(c).to_pylist()]) for c, k in kinds.items()}
            order = np.argsort(got["hash"], kind="stable")
            got = {c: x[order] for c, x in got.items()}
            wanted, ids = np.unique(got["key"]), doc_ids(t)
            for (units, key, at, n, doc), starts in zip(contexts_of(docs, self.size, self.k), long_offsets(docs, self.size), strict=True):
                own = np.flatnonzero(is_in(key, wanted))
                width, raw = units.itemsize, memoryview(units).cast("B")
                digest = np.fromiter((xxhash.xxh64_intdigest(raw[s * width : (s + m + self.size - 1) * width]) for s, m in zip(at[own].tolist(), n[own].tolist(), strict=True)), np.uint64, len(own))
                first, past = (np.searchsorted(got["hash"], digest, side) for side in ("left", "right"))
                runs = past - first
                own, run = np.repeat(own, runs), np.arange(runs.sum()) + np.repeat(first - np.cumsum(runs) + runs, runs)
                ok = got["key"][run] == key[own]
                if self.weigh == "id":
                    ok &= got["value"][run] < ids[doc[own]]
                own, run = own[ok], run[ok]
                place = base[doc[own]] + at[own] + got["start"][run] - starts[doc[own]]
                np.add.at(edges, place, 1)
                np.add.at(edges, place + got["length"][run] - 1 + self.size, -1)
        return [np.cumsum(edges[b : b + n - 1], dtype=np.int32) > 0 for b, n in zip(base.tolist(), sizes.tolist(), strict=True)]

    def run(self, docs: DataFrame, finish: Callable, schema: str, splitters: np.ndarray | None = None, rest: list[str] | None = None) -> DataFrame:
        """finish(table, masks, units) -> the result's table for a text group."""
        common.ship(docs.sparkSession)
        groups = common.groups_for(common.text_bytes(docs))
        keep = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest))) if rest else F.lit(None).cast("string")
        doc_id = F.col("doc_id").cast("long")
        base = docs.select(F.pmod(F.xxhash64(doc_id, F.col("text").cast("string")), F.lit(groups)).cast("int").alias("_p"), doc_id.alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"), keep.alias("rest")).repartition(groups, "_p")
        keys = base.groupBy("_p").applyInArrow(lean(self.keys(groups)), "bucket int, p int, once binary, more binary")
        again = keys.groupBy("bucket").applyInArrow(lean(self.repeated), "p int, keys binary").repartition(groups, "p")
        found = base.groupBy("_p").cogroup(again.groupBy("p")).applyInArrow(lean2(self.contexts(SPLIT * groups, splitters)), "bucket int, p int, key binary, hash binary, data binary, ends binary, low binary, high binary")
        told = found.groupBy("bucket").applyInArrow(lean(self.solved()), "p int, key binary, hash binary, start binary, length binary, value binary").repartition(groups, "p")

        def last(t: pa.Table, runs: pa.Table) -> pa.Table:
            units = self.units_of(t)
            return finish(t, self.covered(t, runs, units), units)

        return base.groupBy("_p").cogroup(told.groupBy("p")).applyInArrow(lean2(last), schema)


def is_in(key: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(wanted, key)
    at[at == len(wanted)] = 0
    return wanted[at] == key


def doc_ids(t: pa.Table) -> np.ndarray:
    """Ids, a null one above all others."""
    return t.column("doc_id").combine_chunks().fill_null(int(NO_ID)).to_numpy()


def leading(data: list[bytes], key: np.ndarray, size: int, k: int) -> np.ndarray:
    """The key's own bytes (leading bytes of the suffix that starts there) of each context of bytes. Hashes take many
    times the bytes, so they are made for BLOCK contexts at a time."""
    out = np.empty(len(data), f"S{k}")
    for b in range(0, len(data), BLOCK):
        own = data[b : b + BLOCK]
        sizes = np.array([len(d) for d in own])
        buffer = np.frombuffer(b"".join(own), np.uint8)
        h = kgram_hashes(buffer, k)
        owner = np.repeat(np.arange(len(own)), sizes)[: len(h)]
        hit = np.flatnonzero(h == key[b : b + BLOCK][owner])
        found, first = np.unique(owner[hit], return_index=True)
        assert len(found) == len(own)
        out[b : b + BLOCK] = [buffer[i : i + k].tobytes() for i in hit[first].tolist()]
    return out
