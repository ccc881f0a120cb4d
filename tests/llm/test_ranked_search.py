import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from prospectrum.llm import ranked_search
from prospectrum.llm.ranked_search import Best, Shard

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, best=10):
    counted = [(d, Counter(terms_of(t))) for d, t in docs]
    n_docs, n_words = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for i, q in queries:
        scores = []
        for d, c in counted:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // max(1, n_words)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(q)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:best])]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frames(spark, docs, queries):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")


def test_against_brute_force(spark):
    """Common and rare words, ties at the end of the ranking, repeated rows and rows without id."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "b2"]
    weights = [1 / (k + 1) for k in range(62)]
    line = lambda n: ", ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, line(rng.choice([0, 1, 3, 20, 60]))) for i in range(400)] + [(500 + i, "W7 w8 w9 same") for i in range(30)] + [(7, "w7"), (None, "w7 w8"), (None, None), (600, None), (601, "")]
    queries = [(i, line(rng.choice([0, 1, 2, 8, 30]))) for i in range(30)] + [(30, "w7 w8 w9 same"), (31, None), (None, "w1 w2"), (3, "nothing holds this"), (32, "w7 " * 50)]
    got = found(ranked_search.ranked_search(*frames(spark, docs, queries)))
    assert got == brute(docs, queries)
    assert found(ranked_search.ranked_search(*frames(spark, docs, queries), best=3)) == brute(docs, queries, 3)


def test_blocks_and_shards_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(n))
    docs, queries = [(i, line(25)) for i in range(300)], [(i, line(6)) for i in range(20)]
    want = brute(docs, queries)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 100)
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", 1)
    assert found(ranked_search.ranked_search(*frames(spark, docs, queries))) == want


@pytest.mark.parametrize("kind", ["random", "equal", "rising", "falling"])
def test_treap_is_a_search_tree_and_a_heap(kind):
    rng = np.random.default_rng(2)
    term = np.repeat(np.arange(5), [1, 2, 50, 300, 7])
    doc = np.concatenate([np.sort(rng.choice(400, n, replace=False)) for n in (1, 2, 50, 300, 7)])
    impact = {"random": rng.integers(1, 50, 360), "equal": np.full(360, 9), "rising": doc + 1, "falling": 500 - doc}[kind]
    s = Shard(term, doc, impact, np.arange(400))
    assert s.terms.tolist() == [0, 1, 2, 3, 4]
    seen = []

    def below(at, lo, hi):
        assert lo <= doc[at] < hi
        seen.append(at)
        for child, a, b in ((s.child[2 * at], lo, doc[at]), (s.child[2 * at + 1], doc[at] + 1, hi)):
            if child >= 0:
                assert impact[child] <= impact[at] and term[child] == term[at]
                below(int(child), a, b)

    for root in s.roots.tolist():
        below(root, 0, 400)
    assert sorted(seen) == list(range(360))


def test_walk_prunes_and_finds_the_best():
    """Most documents are never scored, and the ranking is that of all sums."""
    rng = np.random.default_rng(3)
    n = 20_000
    lists = [np.sort(rng.choice(n, k, replace=False)) for k in (20, 200, 3000, 15_000)]
    term, doc = np.repeat(np.arange(4), [len(x) for x in lists]), np.concatenate(lists)
    impact = np.concatenate([rng.integers(1, top, len(x)) for x, top in zip(lists, (9000, 4000, 900, 50), strict=True)])
    best = Best(10)
    scored = Shard(term, doc, impact, np.arange(n) * 3).walk(np.arange(4), best)
    sums = np.bincount(doc, impact, n).astype(np.int64)
    order = np.lexsort((np.arange(n), -sums))[:10]
    assert best.ids.tolist() == (order * 3).tolist() and best.scores.tolist() == sums[order].tolist()
    assert scored < n // 10


def test_long_text_and_edges(spark, edge_docs, empty_docs):
    queries = spark.createDataFrame([(1, "word The END"), (2, None), (3, "é中文")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert found(ranked_search.ranked_search(edge_docs, queries)) == brute(rows, [(1, "word The END"), (2, None), (3, "é中文")])
    assert ranked_search.ranked_search(empty_docs, queries).collect() == []
    assert ranked_search.ranked_search(edge_docs, queries.limit(0)).collect() == []
    docs = [(1, "some words " * 100_000 + "needle"), (2, "needle in short"), (3, "x" * 1_000_000)]
    assert found(ranked_search.ranked_search(*frames(spark, docs, [(1, "needle words")]))) == brute(docs, [(1, "needle words")])


def test_op12_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = ranked_search.op12_ranked_search(spark, sf_dir)
    want = con.sql(ranked_search.ORACLES["op12_ranked_search"])
    assert want.columns == df.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())
