import math

import duckdb
import numpy as np
import pytest

from prospectrum.llm import hnsw


def exact(ids, x, top=20, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        s[i] = -np.inf
        order = np.lexsort((ids, -s))[:top]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order if s[j] > -np.inf]
    return out


def read(path):
    got = duckdb.sql(f"select vec_id, embedding from '{path}' order by 1").fetchall()
    return np.array([r[0] for r in got]), np.array([r[1] for r in got], np.float64)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_op9_recall_and_scores(spark, sf):
    ids, x = read(f"/root/testdata/{sf}/embeddings.parquet")
    want, hits, total = exact(ids, x), 0, 0
    place = {int(i): k for k, i in enumerate(ids)}
    got = {}
    for r in hnsw.op9_nearest_neighbours(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(want[q]) + 1))
        assert all(math.isclose(r.score, float(x[place[q]] @ x[place[r.vec_id]]), rel_tol=1e-12, abs_tol=1e-12) for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits += len({r.vec_id for r in rows} & {i for i, _ in want[q]})
        total += len(want[q])
    assert hits / total >= 0.95


def vectors(kind, n):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 64))
    if kind == "uneven":
        return x * rng.uniform(0.2, 3, (n, 1))
    if kind == "clustered":
        return x * 0.3 + (rng.normal(size=(50, 64)) * rng.uniform(0.5, 2, (50, 1)))[rng.integers(0, 50, n)]
    if kind == "apart":  # clusters at right angles, of very different lengths
        c = rng.integers(0, 16, n)
        x *= 0.02
        x[np.arange(n), 4 * c] += 2.0 ** -(c // 2)
    return x


@pytest.mark.parametrize("kind, share", [("normal", 0.5), ("uneven", 0.4), ("clustered", 0.1), ("apart", 0.15)])
def test_recall_of_one_graph(kind, share):
    """Queries that are no nodes; share: of the points that a search looks at, at most."""
    x = vectors(kind, 12_200)
    x, q = x[:12_000], x[12_000:]
    graph = hnsw.build(hnsw.augmented(x))
    assert len(graph.sizes) == 3
    graph.seen_points = 0
    got = graph.search(np.pad(q, ((0, 0), (0, 1))).astype(np.float32), hnsw.EF_SEARCH)
    assert graph.seen_points <= share * len(q) * len(x)
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:20].tolist()) & set(b.tolist())) / 20 for a, b in zip(got, want, strict=True)]) >= 0.9


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [9.0, 0.0]), (-7, [2.0, 0.0]), (0, [1.0, 0.0])]
    got = sorted(tuple(r) for r in hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    own = [(0, 1, 1, 9.0), (0, 2, -7, 2.0), (0, 3, 0, 1.0), (0, 4, 1, 1.0)]
    assert got == sorted(own + own)


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 5.0]), (100, [1.0, 2.0, 3.0]), (101, [1.0, 0.0, 0.0]), (120, []), (140, [float("inf"), 0.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, rank string, block int")
    got = sorted(tuple(r) for r in hnsw.nearest(df).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 2, 2.0), (0, 4, 3, -1.0), (100, 1, 101, 1.0)]
    assert hnsw.nearest(df.limit(0)).collect() == []


def test_a_third_of_the_rows_are_one_vector(spark):
    """Which copies come back, by vec_id, and what is found beside them."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 12)).astype(np.float32).astype(np.float64)
    x[rng.permutation(6000)[:2000]] = x[0]
    want = exact(np.arange(6000), x)
    got = {}
    for r in hnsw.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    found = {q: [i for _, i in sorted(rows)] for q, rows in got.items()}
    copies = [q for q in want if (x[q] == x[0]).all()]
    assert len(copies) > 50 and all(found[q] == [i for i, _ in want[q]] for q in copies if {i for i, _ in want[q]} <= set(np.flatnonzero((x == x[0]).all(1))))
    assert np.mean([len(set(found[q]) & {i for i, _ in want[q]}) / 20 for q in copies]) >= 0.95
    assert np.mean([len(set(found[q]) & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95
