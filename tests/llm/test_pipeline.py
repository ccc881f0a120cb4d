import duckdb
import public_tokenizers
from test_near_copies import first_of_groups
from test_packing_and_files import check_packing, library

import corpus_pipeline as cp
from prospectrum.llm.common import documents, written


def by_hand(docs):
    """docs: rows after the classifiers. What the last three stages do, written plainly."""
    first = set(first_of_groups(sorted((r.doc_id, r.text) for r in docs)))
    left = [(r.doc_id, r.text) for r in docs if r.doc_id in first]
    least = {}
    raws = {d: t.encode() for d, t in left}
    for d, r in raws.items():
        for s in range(len(r) - 49):
            w = r[s : s + 50]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, r in raws.items():
        drop = [False] * len(r)
        for s in range(len(r) - 49):
            if least[r[s : s + 50]] < d:
                drop[s : s + 50] = [True] * 50
        text = bytes(b for b, x in zip(r, drop, strict=True) if not x).decode("utf-8", "ignore")
        if text or not any(drop):
            out.append((d, text))
    return left, sorted(out)


def test_stages_against_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = []
    for _, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf_dir))
        got.append(docs)
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf_dir}/labels.parquet'").fetchall())
    kept = {r.doc_id for r in got[0].collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    judged = got[1].collect()
    assert len(judged) >= 0.99 * len(kept) and all(d.columns == cp.COLUMNS for d in got[:-1])
    near, cut = by_hand(judged)
    assert sorted((r.doc_id, r.text) for r in got[2].collect()) == sorted(near)
    rows = got[3].collect()
    assert sorted((r.doc_id, r.text) for r in rows) == cut
    assert all(r.n_chars == len(r.text) for r in rows)
    word = public_tokenizers.path("word_bpe_49k.json")
    check_packing([tuple(r) for r in got[4].collect()], zip([d for d, _ in cut], library(word, [t for _, t in cut]), strict=True))


def test_edges(spark, sf_dir, edge_docs, empty_docs):
    """Rows with nulls, empty texts, repeats and ids that clash: each stage alone, on the same rows."""
    docs = edge_docs.select(*cp.COLUMNS)
    rows = docs.collect()
    out = [written(stage(spark, docs, sf_dir)).collect() for _, stage in cp.STAGES]
    quality, language, near, cut, packed = out
    assert {tuple(r) for r in quality} <= {tuple(r) for r in rows}
    assert sorted((r.doc_id, r.text) for r in language if r.doc_id is not None) == sorted((r.doc_id, r.text) for r in rows if r.doc_id is not None and r.text is not None and any(map(str.isalpha, r.text)) and r.doc_id in {x.doc_id for x in language})
    assert not {None, "", " "} & {r.text for r in language}
    assert sorted(r.doc_id for r in near if r.doc_id is not None) == sorted(first_of_groups(sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None})))
    assert sorted(map(str, cut)) == sorted(str(r) for r in rows)  # nothing is shared but what one doc_id has
    word = public_tokenizers.path("word_bpe_49k.json")
    check_packing([tuple(r) for r in packed], zip([r.doc_id for r in rows], library(word, [r.text for r in rows]), strict=True))
    docs = empty_docs.select(*cp.COLUMNS)
    for _, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf_dir))
    assert docs.collect() == []


def test_copies_that_share_an_id(spark, sf_dir):
    """Copies under one id and under none: one row stays, and the next stages see no other."""
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long)] * 3 + [(None, long)] * 3 + [(2, long + " more")]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [(r.doc_id, r.text) for r in cp.near_duplicate_stage(spark, docs, sf_dir).collect()] == [(1, long)]
