"""Near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash bits can't find them all: pairs at 0.8 lie 5 to 17 of 64 bits apart. So operator 10's index over the
shingles' fingerprints is joined by bands of least hashes: 20 bands of 5 meet at 0.8 with probability 0.9996. Every
link is verified on the shingles themselves. Equal texts are one node.

First each node is compared with the first of each of its lists. Lists whose nodes that leaves unconnected are then
compared whole, within one task a list and on the shingles themselves; what leaves the task is a forest of verified
links, never all pairs. In a list longer than WHOLE those members are compared that share one of their rarest shingles,
which no two near copies lack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectrum.llm import common, simhash
from prospectrum.llm.components import components

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 20, 5
#: Nodes of a list that are compared each with each; in longer lists, those that share a rare shingle.
WHOLE = 4096
#: Bytes of shingles that a bucket of lists gets on average.
BUCKET_BYTES = 4_000_000
#: Bits that tell most texts without candidates, as a power of two (2 MB).
MOST_BITS = 24
_RNG = np.random.default_rng(5)
FACTORS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def node() -> Column:
    """64 bits of a text; null and empty texts differ here and meet by their shingles."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def bands(digests: np.ndarray) -> np.ndarray:
    """A 64-bit number for each band of a text's least hashes; texts without words have equal ones."""
    h = np.unique(np.ascontiguousarray(digests).view(np.uint64).ravel())
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 1024):
        least = np.minimum(least, (h[at : at + 1024] * FACTORS + OFFSETS).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(node, fp, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sized(common.slices(batches), "raw"):
            fp, rows = np.empty(b.num_rows, np.uint64), np.empty((b.num_rows, BANDS), np.int64)
            for i, raw in enumerate(b.column("raw").to_pylist()):
                digests = simhash.shingles(raw, SHINGLE)
                fp[i], rows[i] = simhash.majority(digests), bands(digests)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BANDS), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(fp.view(np.int64)), lists], names=["node", "fp", "bands"])

    return common.map_arrow(docs.select(node().alias("node"), F.col("text").cast("string").cast("binary").alias("raw")), run, "node long, fp long, bands array<long>")


def lists(signed: DataFrame, n: int) -> DataFrame:
    """(key, node, first) of all lists of two nodes or more; first is a list's least node. n: nodes."""
    buckets = max(16, -(-n * BANDS // simhash.BUCKET_ROWS))

    def run(t: pa.Table) -> pa.Table:
        key, nodes = (t.column(c).combine_chunks().to_numpy() for c in ("key", "node"))
        order = np.lexsort((nodes, key))
        key, nodes = key[order], nodes[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        sizes = np.diff(np.append(np.flatnonzero(new), len(key)))
        shared, first = np.repeat(sizes > 1, sizes), np.repeat(nodes[new], sizes)
        return pa.table({"key": key[shared], "node": nodes[shared], "first": first[shared]})

    entries = signed.select("node", F.explode("bands").alias("key"))
    return entries.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(run, "key long, node long, first long")


def parts_of(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Members of a list, whole or, if it is long, by the shingles they share: of each member the rarest, as many as leave
    fewer than LEAST of it out. Two near copies have one of those in common, so none is lost; members without words are a part."""
    if len(sets) <= WHOLE:
        yield np.arange(len(sets))
        return
    sizes = np.array([len(x) for x in sets])
    yield np.flatnonzero(sizes == 0)
    member = np.repeat(np.arange(len(sets)), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((code, times[code], member))
    nth = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = sizes - (4 * sizes + 4) // 5 + 1
    kept = order[nth < np.repeat(prefix, sizes)]
    kept = kept[times[code[kept]] > 1]
    kept = kept[np.lexsort((member[kept], code[kept]))]
    edges = np.flatnonzero(np.diff(code[kept])) + 1
    if (np.diff([0, *edges, len(kept)]).astype(float) ** 2).sum() >= float(len(sets)) ** 2:  # whole is less work
        yield np.arange(len(sets))
        return
    yield from (own for own in np.split(member[kept], edges) if len(own) > 1)


def verified_forest(sets: list[np.ndarray], root: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of members, near copies all, that connect what root leaves apart among them. A member is compared with
    all that follow it and have another root in one pass over their shingles."""
    sizes = np.array([len(x) for x in sets])
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(sizes) - sizes
    mark = np.zeros(len(known), bool)
    root, out = np.unique(root, return_inverse=True)[1], []
    for i in range(len(sets) - 1):
        if not (root[i + 1 :] != root[i]).any():
            continue
        if not sizes[i]:
            hit = sizes[i + 1 :] == 0
        else:
            own = flat[start[i] : start[i] + sizes[i]]
            mark[own] = True
            counts = np.concatenate([[0], np.cumsum(mark[flat[start[i + 1] :]])])
            at = start[i + 1 :] - start[i + 1]
            both = counts[at + sizes[i + 1 :]] - counts[at]
            mark[own] = False
            hit = 5 * both >= 4 * (sizes[i] + sizes[i + 1 :] - both)
        for j in (i + 1 + np.flatnonzero(hit & (root[i + 1 :] != root[i]))).tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out


def open_links(held: DataFrame, sets: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """(a, b): verified links that connect the roots of lists; held: see lists(); sets: shingles of all that is in it."""
    rooted = common.written(held.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), rows=BANDS * n)
    apart = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    live = common.written(rooted.join(apart, "key", "left_semi"), rows=BANDS * n)
    size = sets.agg(F.avg(F.octet_length("own"))).first()[0] or 0
    buckets = max(64, int(live.count() * size / BUCKET_BYTES))

    def run(t: pa.Table) -> pa.Table:
        key, nodes, root = (t.column(c).combine_chunks().to_numpy() for c in ("key", "node", "root"))
        own = t.column("own")
        order = np.lexsort((nodes, key))
        a, b = [], []
        for one in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            members = [np.frombuffer(own[i].as_py(), np.uint64) for i in one.tolist()]
            held = np.unique(root[one], return_inverse=True)[1]
            for part in parts_of(members):
                if len(part) < 2 or (held[part] == held[part[0]]).all():
                    continue
                for i, j in verified_forest([members[k] for k in part.tolist()], held[part]):
                    x, y = int(part[i]), int(part[j])
                    a.append(int(nodes[one[x]]))
                    b.append(int(nodes[one[y]]))
                    held[held == held[y]] = held[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    common.ship(held.sparkSession)
    rows = live.hint("merge").join(sets, "node").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    return rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, "a long, b long")


def fingerprint_pairs(signed: DataFrame, n: int) -> DataFrame:
    """(a, b), a below b: what operator 10's index links, and nodes of one fingerprint with their least."""
    distinct = common.written(signed.groupBy("fp").agg(F.min("node").alias("rep")), rows=n)
    same = signed.join(distinct, "fp").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    both = simhash.links(distinct).unionByName(same).where("a != b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def bit_words(numbers: DataFrame, column: str, n: int) -> tuple[DataFrame, int]:
    """((word, bits), number of bits): the words of a row of bits of which each number has one set; others share them.
    There are 2 ** MOST_BITS bits at most, so the words may be broadcast whatever the corpus."""
    size = 1 << min(MOST_BITS, max(16, (8 * n).bit_length()))
    word = F.shiftright(F.col(column).bitwiseAND(F.lit(size - 1)), 6).alias("word")
    return numbers.groupBy(word).agg(F.expr(f"bit_or(shiftleft(1L, cast(`{column}` & 63 as int)))").alias("bits")), size


def told(df: DataFrame, column: str, words: DataFrame, size: int) -> DataFrame:
    """df with told: whether a number's bit is set."""
    word = F.shiftright(F.col(column).bitwiseAND(F.lit(size - 1)), 6)
    hit = F.expr(f"shiftright(bits, cast(`{column}` & 63 as int)) & 1 = 1")
    return df.withColumn("word", word).join(F.broadcast(words), "word", "left").withColumn("told", F.coalesce(hit, F.lit(False))).drop("word", "bits")


def shingle_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, own): the sorted distinct shingles of the texts in pairs. Most other texts are told by their bits where
    they are read, so that shingles are shuffled and no texts."""
    nodes = common.written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    words, size = bit_words(nodes, "node", nodes.count())
    texts = told(docs.select(node().alias("node"), F.col("text").cast("string").cast("binary").alias("raw")), "node", words, size).where("told").select("node", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sized(common.slices(batches), "raw"):
            own = [np.unique(simhash.shingles(raw, SHINGLE).view(np.uint64).ravel()).tobytes() for raw in b.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(own, pa.binary())], names=["node", "own"])

    # Equal texts have equal sets: any of a node's will do.
    return common.written(common.map_arrow(texts, run, "node long, own binary").join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"]))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose texts are near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column("own").to_pylist(), b.column("other").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # Pairs grow with the corpus, so these are shuffle joins at every size.
    joined = pairs.hint("merge").join(sets.withColumnRenamed("node", "a"), "a").hint("merge").join(sets.select(F.col("node").alias("b"), F.col("own").alias("other")), "b")
    return common.written(common.map_arrow(joined.select("a", "b", "own", "other"), run, "a long, b long"))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """x, y: sorted distinct shingles."""
    if min(len(x), len(y)) < LEAST * max(len(x), len(y)):
        return False
    if not len(x):
        return True
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 5 * both >= 4 * (len(x) + len(y) - both)


def groups(docs: DataFrame) -> DataFrame:
    """(node, root) for the nodes of docs (text) that have near copies of other texts."""
    common.ship(docs.sparkSession)
    signed = common.written(signatures(docs).dropDuplicates(["node"]))
    n = signed.count()
    held = common.written(lists(signed, n), rows=BANDS * n)
    stars = held.where("node <> first").select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b"))
    pairs = common.written(stars.unionByName(fingerprint_pairs(signed, n)).distinct(), rows=BANDS * n)
    sets = shingle_sets(docs, pairs.unionByName(held.select(F.col("node").alias("a"), F.col("first").alias("b"))))
    roots = common.written(components(verified(pairs, sets), n), rows=n)
    more = common.written(open_links(held, sets, roots, n).distinct(), rows=n)
    return roots if more.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), n)
