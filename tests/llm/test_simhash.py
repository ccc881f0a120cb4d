import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from prospectrum.llm import simhash
from prospectrum.llm.components import components


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """rows: (doc_id, fingerprint) -> least id of each row's component."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    fps = sorted({f for _, f in rows})
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 62)
    for d, f in rows:
        least[find(f)] = min(least[find(f)], d)
    return sorted((d, f"{f:016x}", least[find(f)]) for d, f in rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op10_against_brute_force(spark, sf):
    docs = duckdb.sql(f"select doc_id, text from '/root/testdata/{sf}/documents.parquet'").fetchall()
    want = brute([(d, slow_fingerprint(t)) for d, t in docs])
    assert sorted(tuple(r) for r in simhash.op10_simhash_near_dedup(spark, f"/root/testdata/{sf}").collect()) == want


def test_chains_and_dense_groups(spark):
    """Neighbours one to three bits apart in long chains and balls, in the signed range too."""
    rng = random.Random(4)
    fps = []
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(30):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << b
            fps.append(f)
    ball = rng.getrandbits(64)
    fps += [ball ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a, 12)]
    rows = [(i, f) for i, f in enumerate(fps)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for f, i in {f: i for i, f in reversed(rows)}.items()], "fp long, rep long")
    root = {r.node: r.root for r in components(simhash.links(df)).collect()}
    first = {f: i for i, f in reversed(rows)}
    assert sorted((i, f"{f:016x}", root.get(first[f], first[f])) for i, f in rows) == brute(rows)


def test_forest_links_only_what_is_near():
    key = np.zeros(60, np.int64)
    fp = np.array([1 << i for i in range(60)], np.uint64)
    a, b = simhash.forest(key, fp)
    assert len(a) == 59 and all(int(fp[i] ^ fp[j]).bit_count() <= 3 for i, j in zip(a, b, strict=True))


def test_edges(spark, edge_docs, empty_docs):
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(edge_docs).collect()}
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    assert all(f == f"{slow_fingerprint(texts[d]):016x}" for d, f in rows)
    assert rows[(1, "0" * 16)] == 0 and rows[(2, "0" * 16)] == 0
    assert rows[(5, f"{slow_fingerprint('a'):016x}")] == 4
    assert rows[(None, f"{slow_fingerprint('no id'):016x}")] is None
    assert simhash.near_duplicates(edge_docs).count() == edge_docs.count()
    assert simhash.near_duplicates(empty_docs).collect() == []


def test_components_of_odd_links(spark):
    links = spark.createDataFrame([(5, 5), (1, 2), (2, 1), (9, 3), (3, 2), (7, 8)], "a long, b long")
    assert sorted(tuple(r) for r in components(links).collect()) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 1)]
