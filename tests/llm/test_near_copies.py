import random

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline as cp
from prospectrum.llm import near_copies


def sets(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def first_of_groups(docs):
    """docs: (doc_id, text). Least ids of the groups that Jaccard >= 0.8 connects, by an index of shingles."""
    own, holders, up = [sets(t) for _, t in docs], {}, list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(own):
        shared = {}
        for w in s or {b""}:
            for j in holders.setdefault(w, []):
                shared[j] = shared.get(j, 0) + 1
            holders[w].append(i)
        for j, n in shared.items():
            if not s or 5 * n >= 4 * (len(s) + len(own[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [docs[i][0] for i in range(len(docs)) if find(i) == i]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_near_copies_at_a_jaccard_of_four_fifths(spark, sf):
    docs = duckdb.sql(f"select doc_id, text from '/root/testdata/{sf}/documents.parquet' order by 1").fetchall()
    got = [r.doc_id for r in cp.near_duplicate_stage(spark, spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), "").collect()]
    assert sorted(got) == first_of_groups(docs)


def test_a_large_group_of_near_copies(spark):
    """Copies of one text with one to five of 200 words changed, among texts that share a third with it."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(400):
        w = list(base)
        for at in rng.sample(range(200), rng.randint(1, 5)):
            w[at] = word()
        texts.append(" ".join(w))
    texts += [" ".join(base[:70] + [word() for _ in range(130)]) for _ in range(100)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.near_duplicate_stage(spark, df, "").collect()) == first_of_groups(docs)


def test_one_row_of_a_group_stays(spark):
    """Repeated rows, a second text under an id, and copies without an id."""
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (1, long), (1, other), (2, other + " end"), (None, long), (None, "alone without an id"), (None, "alone without an id"), (3, long + " end")]
    df = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in cp.near_duplicate_stage(spark, df, "").collect()), key=str)
    assert got == sorted([(1, long), (1, other), (None, "alone without an id")], key=str)


def linked(sets):
    """Class of each set by the comparisons within one list."""
    held = np.arange(len(sets))
    for part in near_copies.parts_of(sets):
        if len(part) > 1 and not (held[part] == held[part[0]]).all():
            for i, j in near_copies.verified_forest([sets[k] for k in part.tolist()], held[part]):
                held[held == held[part[j]]] = held[part[i]]
    return [int(np.flatnonzero(held == h)[0]) for h in held]


@pytest.mark.parametrize("seed", range(4))
def test_long_lists_lose_no_link(monkeypatch, seed):
    """Lists longer than WHOLE: near copies of short and long sets, empty ones, and pairs just below 0.8."""
    rng, sets = np.random.default_rng(seed), []
    base = [rng.choice(3000, rng.integers(1, 60), replace=False) for _ in range(25)]
    for _ in range(300):
        s = base[rng.integers(25)].copy()
        k = rng.integers(0, max(1, len(s) // 4) + 1)
        s[:k] = rng.integers(0, 6000, k)
        sets.append(np.unique(s).astype(np.uint64))
    sets += [np.empty(0, np.uint64)] * 3
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if near_copies.similar(sets[i], sets[j]) and up[i] != up[j]:
                a, b = up[i], up[j]
                up = [b if u == a else u for u in up]
    want = [up.index(u) for u in up]
    assert linked(sets) == want
    monkeypatch.setattr(near_copies, "WHOLE", 10)
    assert linked(sets) == want


def test_a_list_of_5000_texts():
    """Longer than WHOLE: pairs of near copies among texts that share their last words."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    heads = [[word() for _ in range(12)] for _ in range(2500)]
    tail = [word() for _ in range(8)]
    docs = []
    for i in range(5000):
        w = heads[i % 2500] + tail
        docs.append((i, " ".join([*w[:19], word()] if i >= 2500 else w)))
    own = [np.unique(np.frombuffer(b"".join(xxhash.xxh64_digest(s, 42) for s in sets(t)), np.uint64)) for _, t in docs]
    held = linked(own)
    first = {}
    for (i, _), h in zip(docs, held, strict=True):
        first.setdefault(h, i)
    assert len(own) > near_copies.WHOLE and sorted(first.values()) == first_of_groups(docs)
