import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from prospectrum.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, window=10):
    """docs: (doc_id, text), bench: (item_id, text) -> sorted (doc_id, n_words, merged spans, items)."""
    windows = {}
    for i, t in bench:
        w = words_of(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    sizes, out = {len(k) for k in windows}, []
    for d, t in docs:
        w, hit, items = words_of(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    items |= own - {None}
        spans = []
        for at in sorted(hit):
            if spans and spans[-1][1] == at:
                spans[-1][1] = at + 1
            else:
                spans.append([at, at + 1])
        # two spans that touch stay one: they are merged as numbers
        out.append((d, len(w), [tuple(s) for s in spans], sorted(items)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, [(s["start"], s["end"]) for s in r.spans], list(r["items"])) for r in df.collect()), key=repr)


def frames(spark, docs, bench):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")


def test_against_brute_force(spark):
    """Few different words, so that windows repeat, overlap, end at texts' ends and hold equal runs of words."""
    rng = random.Random(3)
    vocabulary = ["a", "b", "é", "c1", "Zz"]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    bench = [(i, line(rng.choice([0, 1, 2, 5, 9, 10, 11, 14, 30]))) for i in range(25)]
    bench = [(i, t) for i, t in bench if len(t.split()) not in (1, 2)] + [(25, "q " * 12), (26, "only, FOUR words! here"), (27, None), (None, "an item with no id at all but with words enough"), (3, line(12))]
    docs = [(i, line(rng.randint(0, 60)) + rng.choice(["", ". " + (bench[rng.randrange(10)][1] or "").upper()]) + line(8)) for i in range(120)]
    docs += [(200, "q " * 40), (201, "only four\twords\x1chere"), (202, "x an item with no id at all but with words enough y"), (203, None), (204, ""), (None, docs[0][1]), (5, docs[5][1])]
    assert found(decontaminate.decontaminated(*frames(spark, docs, bench))) == brute(docs, bench)


@pytest.mark.parametrize(("window", "gram"), [(10, 10), (10, 1), (3, 2), (1, 5)])
def test_other_windows(spark, window, gram):
    rng = random.Random(window + gram)
    line = lambda n: " ".join(rng.choices("abc", k=n))
    docs, bench = [(i, line(30)) for i in range(30)], [(i, line(12)) for i in range(6)]
    assert found(decontaminate.decontaminated(*frames(spark, docs, bench), window, gram)) == brute(docs, bench, window)


def test_winnowing_keeps_few_runs_and_one_of_each_window():
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(5000)) for _ in range(20_000))
    words = decontaminate.Words(pa.array([text.encode()], pa.large_binary()))
    at, _ = decontaminate.fingerprints(words, words.hashes(), 10, 4)
    assert len(at) < 0.3 * 20_000
    assert np.diff(np.concatenate([[-1], at, [20_000 - 4]])).max() <= 7


def test_words_of_neighbouring_texts_stay_apart():
    texts = ["ab", "cd ", "", None, " ef", "gh\U0001f600", "x" * 300_000]
    words = decontaminate.Words(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
    assert np.diff(words.first).tolist() == [1, 1, 0, 0, 1, 1, 1]
    one = [decontaminate.Words(pa.array([t.encode()], pa.binary())).hashes().tolist() for t in texts if t]
    assert words.hashes().tolist() == [h for own in one for h in own]


def test_a_common_passage_and_long_texts(spark):
    """A third of the documents hold one passage; one text of 2 MB holds it at its end."""
    rng = random.Random(7)
    line = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    passage = line(25)
    bench = [(1, passage), (2, passage + " and more"), (3, line(40))]
    docs = [(i, line(20) + " " + (passage if i % 3 == 0 else line(9))) for i in range(600)] + [(1000, "filler words of no use here " * 75_000 + passage)]
    assert found(decontaminate.decontaminated(*frames(spark, docs, bench))) == brute(docs, bench)


def test_edges(spark, edge_docs, empty_docs):
    bench = spark.createDataFrame([(1, "word " * 3), (2, None), (3, ""), (4, "don't we'll")], "item_id long, text string")
    want = brute([(r.doc_id, r.text) for r in edge_docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert found(decontaminate.decontaminated(edge_docs, bench)) == want
    assert found(decontaminate.decontaminated(edge_docs, bench.where("item_id = 2"))) == brute([(r.doc_id, r.text) for r in edge_docs.collect()], [])
    assert decontaminate.decontaminated(empty_docs, bench).collect() == []
    assert all(not r.spans for r in decontaminate.decontaminated(edge_docs, bench.limit(0)).collect())


def test_op13_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = decontaminate.op13_decontamination(spark, sf_dir)
    want = con.sql(decontaminate.ORACLES["op13_decontamination"])
    assert want.columns == df.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())
