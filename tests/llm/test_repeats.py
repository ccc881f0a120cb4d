import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from prospectrum.llm import anchors, fm_dedup, suffix_dedup


def brute_bytes(docs, size=50):
    """docs: (doc_id, text)."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    least = {}
    for i, r in raw:
        for s in range(len(r) - size + 1):
            w = r[s : s + size]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, r in raw:
        mask = np.zeros(len(r) + 1, int)
        for s in range(len(r) - size + 1):
            if least[r[s : s + size]] < i:
                mask[s] += 1
                mask[s + size] -= 1
        mask = np.cumsum(mask[:-1]) > 0
        kept = bytes(b for b, m in zip(r, mask, strict=True) if not m)
        out.append((i, len(r), int(mask.sum()), suffix_dedup.spans_of(mask), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(docs, size=35):
    words = [(i, (t or "").encode().split()) for i, t in docs]
    seen = defaultdict(int)
    for _, w in words:
        for s in range(len(w) - size + 1):
            seen[tuple(w[s : s + size])] += 1
    out = []
    for i, w in words:
        mask = [False] * len(w)
        for s in range(len(w) - size + 1):
            if seen[tuple(w[s : s + size])] > 1:
                mask[s : s + size] = [True] * size
        kept = b" ".join(x for x, m in zip(w, mask, strict=True) if not m)
        out.append((i, len(w), sum(mask), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def planted(seed):
    """Few letters, so that keys recur by chance; passages of just under, at and above the sizes; stutters."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abé", k=rng.randint(1, 3)))
    passages = [" ".join(word() for _ in range(n)) for n in (20, 34, 35, 36, 60, 120)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice([*passages, " ".join(word() for _ in range(rng.randint(0, 40))), "a " * rng.randint(0, 90), "x" * rng.randint(0, 130)]))
        docs.append((i * 7 % 61, rng.choice([" ", "\n", "\x0b"]).join(parts)))
    return [*docs, (100, None), (101, ""), (102, passages[4]), (103, passages[4]), (104, passages[4][3:])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = planted(seed)
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, raw string").repartition(3)
    assert sorted(tuple(r) for r in suffix_dedup.suffix_dedup_digest(df).collect()) == brute_bytes(docs)
    assert sorted(tuple(r) for r in fm_dedup.substring_dedup_digest(df).collect()) == brute_words(docs)


def in_process(search, finish, docs):
    """The five passes over one text group, without Spark."""
    t = pa.table({"_p": pa.array([0] * len(docs), pa.int32()), "doc_id": pa.array([i for i, _ in docs], pa.int64()), "raw": pa.array([None if x is None else x.encode() for _, x in docs], pa.binary())})
    again = search.repeated(search.keys(1)(t))
    told = search.solved()(search.contexts(1, None)(t, again))
    units = search.units_of(t)
    return sorted(tuple(r.values()) for r in finish(t, search.covered(t, told, units), units).to_pylist())


def test_long_documents_cut_in_chunks(monkeypatch):
    docs = planted(3)
    text = " ".join(t or "" for _, t in docs)
    docs = [*docs, (200, text), (201, text[::-1] + text), (202, text)]
    want = brute_bytes(docs), brute_words(docs)
    for chunk in (400, 1000, 1 << 19):
        monkeypatch.setattr(anchors, "CHUNK", chunk)
        monkeypatch.setattr(anchors, "LONG", 2 * chunk)
        assert in_process(suffix_dedup.SEARCH, suffix_dedup.digest, docs) == want[0]
        assert in_process(fm_dedup.SEARCH, fm_dedup.digest, docs) == want[1]


def test_on_a_table(spark, sf_dir):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    assert sorted(tuple(r) for r in suffix_dedup.op3_suffix_dedup(spark, sf_dir).collect()) == brute_bytes(docs)
    assert sorted(tuple(r) for r in fm_dedup.op5_substring_dedup(spark, sf_dir).collect()) == brute_words(docs)


def test_edges(spark, edge_docs, empty_docs):
    for job in (suffix_dedup.suffix_dedup_digest, fm_dedup.substring_dedup_digest, suffix_dedup.suffix_array_dedup, fm_dedup.substring_dedup):
        assert job(empty_docs).collect() == []
    n = edge_docs.count()
    assert suffix_dedup.suffix_dedup_digest(edge_docs).count() == n
    out = suffix_dedup.suffix_array_dedup(edge_docs)
    assert out.columns == [*edge_docs.columns, "removed"]
    texts = {r.doc_id: r.text for r in out.collect()}
    assert all(texts[r.doc_id] == r.text for r in edge_docs.where("doc_id = 9 or doc_id < 8").collect())
    docs = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in edge_docs.collect()]
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in fm_dedup.substring_dedup_digest(edge_docs).collect()]
    assert sorted(got) == brute_words(docs)


def test_index_against_counting():
    rng = np.random.default_rng(0)
    contexts = [rng.integers(1, 3, n).astype(np.uint64).tobytes() for n in rng.integers(35, 62, 80)]
    contexts = list(dict.fromkeys([*contexts, contexts[0][8:], contexts[1][:-8]]))
    contexts = [c for c in contexts if len(c) >= 35 * 8]
    weight = rng.integers(1, 3, len(contexts))
    count = defaultdict(int)
    for c, w in zip(contexts, weight, strict=True):
        for s in range(0, len(c) - 35 * 8 + 1, 8):
            count[c[s : s + 280]] += int(w)
    want = {(i, s // 8) for i, c in enumerate(contexts) for s in range(0, len(c) - 279, 8) if count[c[s : s + 280]] > 1}
    ctx, start, length, value = fm_dedup.recurring(contexts, np.zeros(len(contexts), np.uint64), weight)
    got = {(int(i), int(s) + k) for i, s, n in zip(ctx, start, length, strict=True) for k in range(n)}
    assert got == want
    assert all(count[contexts[i][8 * s : 8 * s + 280]] == v for i, s, v in zip(ctx.tolist(), start.tolist(), value.tolist(), strict=True))
