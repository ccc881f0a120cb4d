"""Spelling variants by a self-join of the vocabulary's trie (operator 11).

Two words one edit apart share the first half of the shorter, or else the last half. So a word goes to the parts of
the trie below its first half, and to those of the trie of reversed words below its last half (an even length to one
that is a letter shorter, too, where it meets words with a letter less). In a part, each node has the set of active
nodes at distance one: its siblings (a replaced letter), its parent or its children (a letter more or less), and what
follows from its parent's set by an equal letter. Two ends of words that are active for each other are a pair. A part that
is too large is split below the first letter that its words don't share; pairs that differ in it meet by what follows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.llm import common

LETTERS, TIMES, RATIO = 6, 5, 5
#: Of the runs of a document's letters, those whose crc32 this divides lose a letter (the contract's planted slips).
SLIPS = 199
#: Words of a part of the trie; larger parts are split. Rows of a bucket of parts. Words that a task counts at a time.
MOST_WORDS, BUCKET_ROWS, COUNTED = 20_000, 150_000, 300_000
#: Texts from here on are searched match by match.
LONG = 1 << 20


def _runs(letters: int) -> re.Pattern:
    return re.compile(rf"[a-zÀ-ÿ]{{{letters},}}")


def slipped(counts: dict[str, int], doc_id: int | None, slips: int, letters: int) -> Iterator[tuple[str, int]]:
    """Runs of one document with their counts, without the letter that a slip takes; of letters at least."""
    before = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), before)
        if slips and h % slips == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < letters:
                continue
        yield run, n


def word_counts(docs: DataFrame, slips: int = 0, letters: int = LETTERS) -> DataFrame:
    """(word, n) over all documents, as docs (doc_id, text) are."""
    pattern = _runs(letters)

    def emit(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for b in common.sized(batches, "text"):
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = (raw.as_py() or b"").lower().decode()  # bytes: A-Z only
                counts = Counter(pattern.findall(text) if len(text) < LONG else (m.group() for m in pattern.finditer(text)))
                for word, n in slipped(counts, doc_id, slips, letters):
                    held[word] = held.get(word, 0) + n
                if len(held) >= COUNTED:
                    yield emit(held)
                    held = {}
        if held:
            yield emit(held)

    rows = common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")), run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """Of words in the order of (part, code points). Nodes are numbers, level by level; the children of a node follow each
    other in the order of their letters."""

    def __init__(self, part: np.ndarray, words: list[str]) -> None:
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        live, node = np.arange(len(words)), np.cumsum(np.diff(part, prepend=part[:1]) != 0) if len(part) else np.empty(0, np.int64)
        n = int(node[-1]) + 1 if len(node) else 0
        self.levels = [0, n]
        ends, edges = [], []
        for level in range(int(size.max()) + 1 if len(size) else 0):
            done = size[live] == level
            ends.append((node[done], live[done]))
            live, node = live[~done], node[~done]
            edge = node << 21 | letters[start[live] + level]
            new = np.diff(edge, prepend=-1) != 0
            edges.append(edge[new])
            node = n + np.cumsum(new) - 1
            n += int(new.sum())
            self.levels.append(n)
        self.word = np.full(n, -1, np.int64)
        for at, row in ends:
            self.word[at] = row
        #: parent << 21 | letter of each node below the roots, ascending; child k has the number first + k.
        self.edge, self.first = np.concatenate([np.empty(0, np.int64), *edges]), self.levels[1]
        self.child = self.first + np.searchsorted(self.edge, np.arange(n + 1) << 21)

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in nodes, child) of all children."""
        count = self.child[nodes + 1] - self.child[nodes]
        own = np.repeat(np.arange(len(nodes)), count)
        return own, np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.child[nodes], count)

    def letter(self, nodes: np.ndarray) -> np.ndarray:
        return self.edge[nodes - self.first] & ((1 << 21) - 1)

    def follow(self, x: np.ndarray, y: np.ndarray, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Children of x and y by equal letters (other than but)."""
        own, cx = self.children(x)
        letter = self.letter(cx)
        edge = y[own] << 21 | letter
        at = np.minimum(np.searchsorted(self.edge, edge), max(0, len(self.edge) - 1))
        ok = self.edge[at] == edge if len(self.edge) else np.empty(0, bool)
        if but is not None:
            ok &= letter != but[own]
        return cx[ok], at[ok] + self.first

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are one edit apart within their part, each pair once."""
        none = np.empty(0, np.int64)
        same, longer = (none, none), (none, none)  # active pairs of a level: as deep as each other, or y one deeper
        out = []
        for top, end in zip(self.levels[:-1], self.levels[1:], strict=True):
            nodes = np.arange(top, end)
            _, c = self.children(nodes)
            # A letter more: y goes on from x. That letter is the last of a stretch of equal ones, so that a pair comes once.
            up = (self.edge[c - self.first] >> 21) if len(c) else none
            self._emit(out, up, c)
            fresh = self.follow(up, c, self.letter(c) if len(c) else none)
            old = self.follow(*longer)
            longer = tuple(np.concatenate(z) for z in zip(fresh, old, strict=True))
            self._emit(out, *longer)
            # A replaced letter: each child with the siblings after it.
            rest = self.child[up + 1] - c - 1 if len(c) else none
            a = np.repeat(c, rest)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(rest) - rest, rest)
            old = self.follow(*same)
            same = tuple(np.concatenate(z) for z in zip((a, b), old, strict=True))
            self._emit(out, *same)
        return tuple(np.concatenate([none, *z]) for z in zip(*out, strict=True)) if out else (none, none)

    def _emit(self, out: list, x: np.ndarray, y: np.ndarray) -> None:
        a, b = self.word[x], self.word[y]
        ok = (a >= 0) & (b >= 0)
        if ok.any():
            out.append((a[ok], b[ok]))


def placed(words: DataFrame) -> DataFrame:
    """(side, h, key, rest, n): each word's places; on side 1 the word is reversed. key has h letters at first."""
    half = "length(word) div 2"
    spots = f"array(named_struct('side', 0, 'h', {half}), named_struct('side', 1, 'h', {half}))"
    spots = f"explode(if(length(word) % 2 = 0, concat({spots}, array(named_struct('side', 0, 'h', {half} - 1), named_struct('side', 1, 'h', {half} - 1))), {spots}))"
    rows = words.select("word", "n", F.expr(spots).alias("at")).selectExpr("at.side", "at.h", "if(at.side = 0, word, reverse(word)) as w", "n")
    return rows.selectExpr("side", "cast(h as int) as h", "left(w, h) as key", "substring(w, cast(h as int) + 1) as rest", "n")


def near_pairs(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(a, n_a, b, n_b) of words (word, n; each word once) that are one edit apart, each pair once."""
    common.ship(words.sparkSession)
    rows = common.written(placed(words))
    crossed, on = None, ["side", "h", "key"]
    while True:
        same = "if(least(length(lo), length(hi)) = 0, 0, size(filter(sequence(1, least(length(lo), length(hi))), i -> left(lo, i) = left(hi, i))))"
        sizes = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n_words"), F.min("rest").alias("lo"), F.max("rest").alias("hi")).where(F.col("n_words") > most)
        crowds = common.written(sizes.selectExpr(*on, f"{same} as shared"))
        if crowds.isEmpty():
            break
        # Below the letters that all words of a part share: those that differ in the next letter. What follows it in one
        # is what follows it, or all that is left, in the other.
        crowded = rows.join(crowds, on).selectExpr(*on, "concat(key, left(rest, shared)) as stem", "substring(rest, shared + 1) as tail", "n")
        less = crowded.where("tail <> ''").selectExpr(*on, "stem", "left(tail, 1) as lost", "substring(tail, 2) as tail", "n")
        x, y, z, meet = less.alias("x"), crowded.alias("y"), less.alias("z"), [*on, "stem", "tail"]
        swapped = x.join(z, meet).where("x.lost < z.lost").selectExpr("side", "h", "concat(stem, x.lost, tail) as a", "x.n as n_a", "concat(stem, z.lost, tail) as b", "z.n as n_b")
        added = x.join(y, meet).where("left(tail, 1) <> x.lost").selectExpr("side", "h", "concat(stem, x.lost, tail) as a", "x.n as n_a", "concat(stem, tail) as b", "y.n as n_b")
        found = swapped.unionByName(added)
        crossed = found if crossed is None else crossed.unionByName(found)
        deeper = less.selectExpr("side", "h", "concat(stem, lost) as key", "tail as rest", "n")
        rows = common.written(rows.join(crowds, on, "left_anti").unionByName(deeper))
    buckets = max(16, -(-rows.count() // BUCKET_ROWS))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("h", "ascending"), ("key", "ascending"), ("rest", "ascending")])
        side, h, n = (t.column(c).to_numpy() for c in ("side", "h", "n"))
        key, rest = t.column("key").to_pylist(), t.column("rest").to_pylist()
        new = (np.diff(side, prepend=-1) != 0) | (np.diff(h, prepend=-1) != 0) | np.array([True, *(p != q for p, q in zip(key[1:], key[:-1], strict=True))])[: len(key)]
        a, b = Trie(np.cumsum(new), rest).pairs()
        whole = lambda at: pa.array([key[i] + rest[i] for i in at.tolist()], pa.string())
        return pa.table({"side": side[a], "h": h[a], "a": whole(a), "n_a": n[a], "b": whole(b), "n_b": n[b]})

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("side", "h", "key"), F.lit(buckets)).cast("int"))
    pairs = dealt.groupBy("bucket").applyInArrow(run, "side int, h int, a string, n_a long, b string, n_b long")
    if crossed is not None:
        pairs = pairs.unionByName(crossed)
    # A pair belongs to the half of its shorter word, and to side 1 only where it doesn't share the first.
    pairs = pairs.where("least(length(a), length(b)) div 2 = h and (side = 0 or right(a, h) <> right(b, h))")
    return pairs.selectExpr("if(side = 0, a, reverse(a)) as a", "n_a", "if(side = 0, b, reverse(b)) as b", "n_b")


def variants(words: DataFrame, ratio: int = RATIO, most: int = MOST_WORDS) -> DataFrame:
    """Per row of words (word, n; each word once): word, n, n_near (the number of near words), form (the near word of
    largest n, the first in code-point order among equals, if its n is ratio times the word's at least), form_n, and
    root (where forms lead from the word; itself without one). Null words and null counts are left out."""
    words = common.written(words.where("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n")))
    pairs = common.written(near_pairs(words, most))
    both = pairs.selectExpr("a as word", "b as near", "n_b as near_n").unionByName(pairs.selectExpr("b as word", "a as near", "n_a as near_n"))
    told = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.expr("min_by(struct(near, near_n), struct(-near_n, near))").alias("best"))
    rows = words.join(told, "word", "left")
    fits = F.col("best.near_n") >= ratio * F.col("n")
    rows = common.written(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, F.col("best.near_n")).alias("form_n")))
    # A form is more frequent than its word, so chains end, and a round makes the way that is known twice as long.
    ways = common.written(rows.where("form is not null").selectExpr("word", "form as root"))
    while True:
        further = ways.selectExpr("word as root", "root as next")
        if ways.join(further, "root", "left_semi").isEmpty():
            break
        old, ways = ways, common.written(ways.join(further, "root", "left").selectExpr("word", "coalesce(next, root) as root"))
        common.forget(old)
    return rows.join(ways, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, slips: int = 0, letters: int = LETTERS, times: int = TIMES, ratio: int = RATIO) -> DataFrame:
    """variants() of the words of docs (doc_id, text): runs of letters (a-z and U+00C0 to U+00FF, A-Z made small) of at
    least so many letters, found at least so many times in all.

    Null and empty texts have no words; a word counts as often as it is found, repeated rows included; a null doc_id counts as
    an empty one where slips is set (see SLIPS). Texts and words of any length are taken whole; empty tables give
    no rows; extra columns are ignored."""
    return variants(word_counts(docs.select("doc_id", "text"), slips, letters).where(F.col("n") >= times), ratio)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(common.documents(spark, sf_dir), SLIPS).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable] = {"op11_spelling_variants": op11_spelling_variants}

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op11_spelling_variants": rf"""
with recursive steps as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
found as (
  select coalesce(cast(doc_id as varchar), '') as id, run, count(*) as k
  from (select doc_id, unnest(regexp_extract_all({_LOW}, '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents where text is not null)
  where length(run) >= {LETTERS} group by all),
hashed as (
  select run, k, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(strlen(id || ':' || run)), lambda i: cast('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2) as bigint))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h
  from found, steps),
words as (
  select word, cast(sum(k) as bigint) as n
  from (select case when h % {SLIPS} = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, k from hashed)
  where length(word) >= {LETTERS} group by word having sum(k) >= {TIMES}),
cut as (select word, n, spot, substr(word, 1, spot - 1) || substr(word, spot + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as spot from words)),
near as (
  select distinct a.word, b.word as other, b.n as other_n from cut a join cut b on a.rest = b.rest and a.spot = b.spot and a.word <> b.word
  union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
  union select b.word, a.word, a.n from cut a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, encode(other))) as other, max(other_n) as other_n from near group by word),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= {RATIO} * w.n then other end as form, case when other_n >= {RATIO} * w.n then other_n end as form_n from words w left join best using (word)),
ways as (
  select word, word as there from forms
  union all select w.word, f.form from ways w join forms f on w.there = f.word where f.form is not null)
select f.word, f.form, w.there as root, f.n, f.n_near, f.form_n
from forms f join ways w using (word) join forms g on w.there = g.word and g.form is null"""
}
