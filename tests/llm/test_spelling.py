import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from prospectrum.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=5):
    """{word: n} -> sorted (word, n, n_near, form, form_n, root)."""
    form, rows = {}, []
    for w, n in words.items():
        own = [x for x in words if near(w, x)]
        best = min(own, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best
        rows.append((w, n, len(own)))
    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, n, k, form.get(w), words.get(form.get(w)), root(w)) for w, n, k in rows)


def found(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def counted(docs, slips, letters=6, times=5):
    c = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            c[run[: h % len(run)] + run[h % len(run) + 1 :] if slips and h % slips == 0 else run] += 1
    return {w: n for w, n in c.items() if len(w) >= letters and n >= times}


def random_words(rng, n, letters="abé", least=6, most=9):
    return {"".join(rng.choices(letters, k=rng.randint(least, most))): rng.choice([5, 6, 30, 31, 200, 5000]) for _ in range(n)}


@pytest.mark.parametrize("most", [20_000, 4])
def test_against_brute_force(spark, most):
    """Dense words, so that stretches of equal letters and many ties occur; small parts are split down to single letters."""
    words = random_words(random.Random(most), 200) | {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "x" * 3000: 5, "x" * 2999 + "y": 50, "x" * 3001: 7, "zzéßzzz": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(spelling.variants(df, most=most)) == brute(words)


def test_pairs_come_once(spark):
    words = random_words(random.Random(9), 300)
    for most in (20_000, 5):
        got = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long"), most).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_trie_join_within_parts():
    rng = random.Random(2)
    parts = [sorted({"".join(rng.choices("ab\U0001f600", k=rng.randint(0, 5))) for _ in range(60)}) for _ in range(5)]
    part = np.repeat(np.arange(5), list(map(len, parts)))
    words = [w for p in parts for w in p]
    a, b = spelling.Trie(part, words).pairs()
    got = sorted(tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True))
    assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if part[i] == part[j] and near(words[i], words[j])]
    assert spelling.Trie(part[:0], []).pairs()[0].tolist() == []


def test_chains_lead_to_the_last_form(spark):
    words = {"aaaaaa" + "b" * k: 5 ** (k + 1) for k in range(9)}
    rows = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r.root for r in rows} == {"aaaaaabbbbbbbb"} and {r.word: r.form for r in rows}["aaaaaa"] == "aaaaaab"


def test_one_prefix_holds_most_words(spark):
    """A part far above its bound, whose words share their first half."""
    rng = random.Random(4)
    words = {"prefix" + "".join(rng.choices("abcdefgh", k=6)): rng.randint(5, 90) for _ in range(700)}
    assert found(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), most=100)) == brute(words)


def test_words_of_documents(spark, edge_docs, empty_docs):
    rng = random.Random(8)
    base = ["colour", "ColorÉs", "naïveté", "straßen", "ABCDEFG", "x×y÷zzz", "short", "İstanbul", "letter's"]
    docs = [(i, " ".join(rng.choices(base, k=rng.randint(0, 40)))) for i in range(150)] + [(None, "colour colour colour"), (7, None), (8, ""), (9, "longest " * 200_000), (9, "longest " * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for slips in (199, 3, 0):
        assert found(spelling.spelling_variants(df, slips)) == brute(counted(docs, slips))
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert found(spelling.spelling_variants(edge_docs, 199, letters=4, times=1)) == brute(counted(rows, 199, 4, 1))
    assert spelling.spelling_variants(empty_docs).collect() == []
    nulls = spark.createDataFrame([(None, 5), ("abcdef", None), ("abcdeg", 6)], "word string, n long")
    assert found(spelling.variants(nulls)) == [("abcdeg", 6, 0, None, None, "abcdeg")]


def test_op11_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    df = spelling.op11_spelling_variants(spark, sf_dir)
    want = con.sql(spelling.ORACLES["op11_spelling_variants"])
    assert want.columns == df.columns and sorted(map(tuple, df.collect()), key=repr) == sorted(want.fetchall(), key=repr)
