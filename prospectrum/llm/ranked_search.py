"""Ranked lexical search in inverted treaps (operator 12).

A shard is a run of documents in the order of their ids. In it each query term has a treap: a search tree by
document whose parents have no less impact (what the term adds to a document's score) than their children, kept as
flat arrays. A search walks the treaps of a query's terms together. A node of the walk is an interval of documents with
the highest treap node of each term in it; the sum of their impacts bounds every score inside. An interval whose bound
can't enter the query's best is dropped with all that is below; any other is split at the document of its greatest
impact, which is scored. The nodes of a level are worked on at once. Shard results are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospectrum.llm import common
from prospectrum.llm.decontaminate import Words

BEST = 10
#: Bytes of query texts that are searched for at a time; more queries are more blocks, each over all documents.
BLOCK_BYTES = 8 << 20
#: Postings of a shard; a task makes as many shards as it needs.
SHARD_POSTINGS = 4_000_000
#: Bits below a priority's impact, which order equal impacts at random.
_TIE = 16
_NO_ID = np.iinfo(np.int64).max


def tokens(words: Words) -> pa.Array:
    size = words.end - words.start
    ends = np.append(0, np.cumsum(size)).astype(np.int64)
    inside = np.zeros(len(words.raw) + 1, np.int8)
    inside[words.start] += 1
    np.subtract.at(inside, words.end, 1)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(words.raw[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)])])


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


class Shard:
    """Treaps of the postings (term, place of the document, impact), in the order of term and place."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, ids: np.ndarray) -> None:
        self.doc, self.impact, self.ids = doc, impact, ids
        n = len(doc)
        tie = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _TIE)).astype(np.int64)
        rank = impact << _TIE | tie
        at = np.arange(n)
        new = np.flatnonzero(np.diff(term, prepend=-1))
        before, after = at - 1, at + 1  # the nearest on either side with a higher rank, among equals the former
        before[new] = -1
        after[np.append(new[1:] - 1, n - 1)[: len(new)]] = -1
        for near, lower in ((before, np.less), (after, np.less_equal)):
            live = np.flatnonzero(near >= 0)
            while len(live):
                live = live[lower(rank[near[live]], rank[live])]
                near[live] = near[near[live]]
                live = live[near[live] >= 0]
        over_before = (before >= 0) & ((after < 0) | (rank[before] < rank[after]))
        over_after = (after >= 0) & ~over_before
        self.child = np.full(2 * n, -1, np.int64)  # left, right
        self.child[2 * before[over_before] + 1] = at[over_before]
        self.child[2 * after[over_after]] = at[over_after]
        tops = np.flatnonzero(~over_before & ~over_after)
        self.terms, self.roots = term[tops], tops

    def fit(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The highest nodes of the trees below at whose documents are from lo to hi - 1; -1 where there is none."""
        at = at.copy()
        live = np.arange(len(at))
        while len(live):
            own = at[live]
            d = self.doc[own]
            low = d < lo[live]
            off = low | (d >= hi[live])
            live = live[off]
            at[live] = self.child[2 * own[off] + low[off]]
            live = live[at[live] >= 0]
        return at

    def walk(self, terms: np.ndarray, best: Best) -> int:
        """Take the documents with the highest sums over the terms into best; how many documents were scored."""
        k = np.searchsorted(self.terms, terms)
        at = self.roots[k[(k < len(self.terms)) & (self.terms[np.minimum(k, len(self.terms) - 1)] == terms)]] if len(self.terms) else terms[:0]
        if not len(at):
            return 0
        first, lo, hi, scored = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, len(self.ids), np.int64), 0
        while len(lo):
            held = self.impact[at]
            bound = np.add.reduceat(held, first)
            size = np.diff(np.append(first, len(at)))
            keep = (bound > best.least) | ((bound == best.least) & (self.ids[lo] < best.last))
            if not keep.all():
                pairs = np.repeat(keep, size)
                at, held, lo, hi, size = at[pairs], held[pairs], lo[keep], hi[keep], size[keep]
                if not len(lo):
                    break
                first = np.cumsum(size) - size
            node = np.repeat(np.arange(len(lo)), size)
            # The document of the greatest impact of each interval.
            top = np.flatnonzero(held == np.repeat(np.maximum.reduceat(held, first), size))
            top = top[np.diff(node[top], prepend=-1) > 0]
            d = self.doc[at[top]]
            cut = d[node]
            there = self.fit(at, cut, cut + 1)
            hit = there >= 0
            best.take(np.bincount(node[hit], self.impact[there[hit]], len(lo)).astype(np.int64), self.ids[d])
            scored += len(d)
            left, right = self.fit(at, lo[node], cut), self.fit(at, cut + 1, hi[node])
            both, owner = np.concatenate([left, right]), np.concatenate([node, node + len(lo)])
            full = both >= 0
            at, owner = both[full], owner[full]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            kept = owner[first]
            lo, hi = np.concatenate([lo, d + 1])[kept], np.concatenate([d, hi])[kept]
        return scored


class Best:
    """A query's best so far: scores falling, equal ones by id. least, last: the worst kept, once there are enough."""

    def __init__(self, most: int) -> None:
        self.most, self.least, self.last = most, 0, np.iinfo(np.int64).min
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        own = (scores > self.least) | ((scores == self.least) & (ids < self.last))
        if not own.any():
            return
        scores, ids = np.append(self.scores, scores[own]), np.append(self.ids, ids[own])
        order = np.lexsort((ids, -scores))[: self.most]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.most:
            self.least, self.last = int(self.scores[-1]), int(self.ids[-1])


def postings(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """(doc_id, n, term, tf): a document's words, and the places in terms of those it has with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sized(batches, "text"):
            words = Words(b.column("text"))
            n = np.diff(words.first)
            found = pc.fill_null(pc.index_in(tokens(words), value_set=terms), -1).to_numpy().astype(np.int64)
            text = np.repeat(np.arange(b.num_rows), n)[found >= 0]
            pair, tf = np.unique(text * max(1, len(terms)) + found[found >= 0], return_counts=True)
            ends = np.searchsorted(pair, np.arange(b.num_rows + 1) * max(1, len(terms))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % max(1, len(terms)), tf)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "term", "tf"])

    return common.map_arrow(docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")), run, "doc_id long, n long, term array<int>, tf array<int>")


def query_terms(queries: DataFrame) -> tuple[list[int | None], list[np.ndarray], pa.Array]:
    """Ids, places of the distinct terms of each, and the sorted terms of all queries of a block."""
    rows = queries.collect()  # a block is bounded by BLOCK_BYTES
    words = Words(pa.array([None if r["text"] is None else r["text"].encode() for r in rows], pa.large_binary()))
    coded = tokens(words).dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy()
    return [r["item_id"] for r in rows], [np.unique(code[a:b]).astype(np.int64) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)], terms


def search_block(docs: DataFrame, queries: DataFrame, best: int) -> DataFrame:
    """(query, item_id, doc_id, score): the best of each shard, or of all shards of a task."""
    items, wanted, terms = query_terms(queries)
    held = common.written(postings(docs, terms))
    n_docs, n_words = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for r in held.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # one row a term of the block
        df[r["term"]] = r["count"]
    weights = weight(n_docs, df)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        own, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                own.append(b.slice(at, 4096))
                size += len(own[-1].column("term").flatten())
                if size >= SHARD_POSTINGS:
                    yield shard(own)
                    own, size = [], 0
        if own:
            yield shard(own)

    def shard(own: list[pa.RecordBatch]) -> Shard:
        t = pa.Table.from_batches(own)
        ids = t.column("doc_id").fill_null(_NO_ID).to_numpy()
        lengths = np.concatenate([np.diff(c.offsets.to_numpy()) for c in t.column("term").chunks])
        term, tf = (np.concatenate([c.flatten().to_numpy() for c in t.column(k).chunks]).astype(np.int64) for k in ("term", "tf"))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        m = 10 + 90 * t.column("n").to_numpy() * n_docs // max(1, n_words)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, lengths)))
        doc = np.repeat(place, lengths)
        keep = np.flatnonzero(impact > 0)
        keep = keep[np.lexsort((doc[keep], term[keep]))]
        return Shard(term[keep], doc[keep], impact[keep], ids[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [Best(best) for _ in wanted]
        for one in shards(batches):
            for own, b in zip(wanted, kept, strict=True):
                one.walk(own, b)
        for q, b in enumerate(kept):
            n = len(b.ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, q, np.int32)), pa.array([items[q]] * n, pa.int64()), pa.array(b.ids, mask=b.ids == _NO_ID), pa.array(b.scores)], names=["query", "item_id", "doc_id", "score"])

    return common.map_arrow(held.where(F.size("term") > 0), run, "query int, item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, queries: DataFrame, best: int = BEST) -> DataFrame:
    """Per row of queries (item_id, text): item_id, rank from 1, doc_id and score of the best rows of docs (doc_id, text)
    with a score above 0.

    Null and empty texts have no terms: they are found by nothing and find nothing. Repeated rows of docs are documents
    each, and rows of queries are queries each. Equal scores are ranked by doc_id, rows without one last. A text of any
    length is counted whole. Empty tables give no rows; extra columns are ignored. Queries are searched in blocks of BLOCK_BYTES, the
    merge of shards keeps the best of each partition before it shuffles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    queries = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-common.text_bytes(queries) // BLOCK_BYTES))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    out = None
    for k in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        found = search_block(docs, own, best).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(32)))
        for keys in (["query", "salt"], ["query"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= best)
        found = found.select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable] = {"op12_ranked_search": op12_ranked_search}

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES = {
    "op12_ranked_search": f"""
with docs as (select row_number() over () as r, doc_id, {_TERMS} as t from documents where text is not null),
lengths as (select r, doc_id, cast(len(t) as bigint) as n from docs where len(t) > 0),
totals as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from lengths),
wanted as (select distinct q, item_id, term from (select row_number() over () as q, item_id, unnest({_TERMS}) as term from benchmark where text is not null)),
counts as (select r, term, count(*) as tf from (select r, unnest(t) as term from docs) where term in (select term from wanted) group by r, term),
weights as (select term, cast(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) as bigint) as w from (select term, cast(count(*) as double) as df from counts group by term), totals),
impacts as (
  select c.r, l.doc_id, c.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l)))) as impact
  from counts c join lengths l using (r) join weights using (term), totals),
scores as (select q, item_id, r, doc_id, cast(sum(impact) as bigint) as score from wanted join impacts using (term) group by q, item_id, r, doc_id having sum(impact) > 0),
ranked as (select *, row_number() over (partition by q order by score desc, doc_id) as rank from scores)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= {BEST}"""
}
