import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from prospectrum.llm import language, quality
from prospectrum.llm.common import documents, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def predicted(spark):
    return language.op2_language_id(spark, "/root/testdata/sf0.01").toPandas()


def test_op2_held_out_accuracy(predicted):
    truth = duckdb.sql("select doc_id, lang, text from '/root/testdata/sf0.01/documents.parquet'").df()
    both = predicted.merge(truth, on="doc_id")
    assert len(both) == len(truth) == len(predicted)
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert both.score.between(0, 1).all()


def test_op2_does_not_see_lang_or_source(spark):
    """A prediction depends on the text alone: other labels of held-out rows change nothing."""
    docs = documents(spark, SF).select("doc_id", "text", "lang")
    blind = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 3 = 1 then 'xx' else lang end as lang")
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language.identify(x).collect()} for x in (docs, blind))
    assert a == b


def test_op2_edges(spark, edge_docs, empty_docs):
    extra = edge_docs.withColumnsRenamed({"ids": "lang_pred", "length": "score"})
    rows = language.identify(extra).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.lang_pred in ("en", "und") and 0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if not language.has_letter(r.text)} == {"und"}
    assert language.identify(empty_docs).collect() == []
    only_null = edge_docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language.identify(only_null).collect()} == {"und"}


def test_op6_agrees_with_labels_it_did_not_see(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.01"), table(spark, "/root/testdata/sf0.01", "labels")
    scored = {r.doc_id: r for r in quality.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    rest = [r for r in labels.where("doc_id % 2 = 1").collect()]
    good = [scored[r.doc_id].accepted for r in rest if r.quality == 1]
    bad = [scored[r.doc_id].accepted for r in rest if r.quality == 0]
    assert sum(good) / len(good) >= 0.99
    assert sum(bad) / len(bad) <= 0.1


def test_op6_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(10)] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.quality_score <= 1 for r in rows)
    assert all(r.accepted for r in quality.classify(edge_docs, labels.where("quality = 1")).collect())
    assert quality.classify(empty_docs, labels).collect() == []
    assert all(r.accepted for r in quality.classify(edge_docs, labels.limit(0)).collect())


def test_op2_against_plain_votes(spark):
    """Trigrams by a dictionary, families and votes by loops, with the weights that were learned."""
    docs = documents(spark, SF)
    model = language.train(docs.select("doc_id", "text", "lang"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.op2_language_id(spark, SF).collect()}
    for r in docs.limit(60).collect():
        if not language.has_letter(r.text):
            continue
        raw = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in r.text.lower().encode()) + b" "
        counts = Counter(raw[i : i + 3] for i in range(len(raw) - 2))
        x = np.zeros(language.DIM)
        for g, n in counts.items():
            x[(int.from_bytes(g, "big") * 2654435761 % 2**32) >> 20] += n
        x = np.sqrt(x)
        x /= np.linalg.norm(x)
        by_family = {f: float(model.top[f][:-1] @ x + model.top[f][-1]) for f in model.families} if model.top else {model.families[0]: 1.0}
        family = max(by_family, key=by_family.get)
        names = model.members[family]
        votes, total = Counter(), Counter()
        for (a, b), w in model.pairs.items():
            if a in names:
                z = float(w[:-1] @ x + w[-1])
                votes[a if z > 0 else b] += 1
                total[a] += z
                total[b] -= z
        assert got[r.doc_id][0] == max(names, key=lambda n: (votes[n], total[n], n))


def test_op2_learns_every_language(spark):
    """More languages than the sample has rows for each; none is left out."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 30, f"l{i % 300}") for i in range(300 * 12)]
    model = language.train(spark.createDataFrame([(i, t, v) for i, t, v in rows], "doc_id long, text string, lang string"))
    assert sum(map(len, model.members.values())) == 300


def test_op6_against_co_training_in_one_process(spark):
    """The same rounds over all rows at once, with each row's gradient and curvature added up plainly."""
    docs, labels = documents(spark, SF), table(spark, SF, "labels")
    model = quality.fit(docs, labels)
    rows = sorted(quality.own_columns(docs).collect(), key=lambda r: r.doc_id)
    views = [quality.text_view([r.text for r in rows]).astype(np.float32).astype(float), quality.meta_view([r.source for r in rows], [r.lang for r in rows], [r.n_chars for r in rows])]
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    place = [i for i, r in enumerate(rows) if r.doc_id in known]
    free = [i for i, r in enumerate(rows) if r.doc_id not in known]

    def passes(models):
        out = []
        for k in (0, 1):
            sums = []
            for label in (0, 1):
                n, g, h = 0, 0.0, 0.0
                for i in free:
                    p = 1 / (1 + np.exp(-(views[1 - k][i] @ models[1 - k][:-1] + models[1 - k][-1])))
                    if (p if label else 1 - p) >= quality.CONFIDENT:
                        z = np.append(views[k][i], 1)
                        q = 1 / (1 + np.exp(-(z @ models[k])))
                        n, g, h = n + 1, g + z * (q - label), h + np.outer(z, z) * q * (1 - q)
                width = views[k].shape[1] + 1
                sums.append(np.concatenate([[n], np.zeros(width) + g, (np.zeros((width, width)) + h).ravel()]))
            out.append(sums)
        return out

    plain = quality.CoTraining([v[place] for v in views], np.array([known[rows[i].doc_id] for i in place]), passes)
    assert all(np.allclose(a, b, atol=1e-2) for a, b in zip(model.models, plain.models, strict=True))
    got = {r.doc_id: (r.text_score, r.meta_score, r.quality_score) for r in quality.classify(docs, labels).collect()}
    want = np.stack(plain.score(views), axis=1)
    assert np.abs(np.array([got[r.doc_id] for r in rows]) - want).max() < 1e-2


def test_texts_beyond_a_megabyte():
    """Chunks change nothing: features of a long text equal those of its counts."""
    text = "ab cd! " * 400_000 + "é" * 100
    raw = b" " + text.lower().encode().translate(language._BLANK) + b" "
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    code = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * 2654435761 % 2**32) >> 20
    want = np.sqrt(np.bincount(code.astype(np.int64), minlength=language.DIM))
    assert np.allclose(language.features([text])[0], want / np.linalg.norm(want), atol=1e-5)
    view = quality.text_view([text])[0]
    classes = quality._CLASS[np.frombuffer(text.encode(), np.uint8)]
    pairs = np.bincount(classes[:-1].astype(int) * 8 + classes[1:], minlength=64)
    assert np.allclose(view[:64], np.sqrt(pairs / pairs.sum()))
    words = Counter(zlib.crc32(w) % quality.WORDS for w in text.encode().split())
    assert np.allclose(view[72:] ** 2, [words[k] / words.total() for k in range(quality.WORDS)])


@pytest.mark.parametrize("base", [0, 1, 5_000_000])
def test_language_of_many_copies_is_learned(spark, base):
    """20,000 copies of one text are one example: its language is learned, and the driver gets a bounded sample."""
    rng = random.Random(base)
    english = [" ".join(rng.choices("the of and that with which have from this would there their about".split(), k=20)) for _ in range(1500)]
    rows = [(base + i, t, "en") for i, t in enumerate(english)] + [(base + 2000 + i, "les enfants jouent dans la forêt avec leurs amis pendant l'été", "fr") for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.families == ["germanic", "romance"]
    assert model.examples == {"en": language.TRAIN_ROWS, "fr": 1}
    pred = language.identify(df.where(f"doc_id < {base + 2100}")).where("lang = 'fr'").select("lang_pred").collect()
    assert {r.lang_pred for r in pred} == {"fr"} and len(pred) == 100


def test_very_long_texts_get_a_language(spark):
    rows = [(i, t * 9 + str(i), v) for i in range(60) for t, v in (("this is the house that they have built ", "en"), ("das ist ein haus und die katze ist nicht da ", "de"))]
    rows.append((1000, "das ist nicht die katze und ein haus " * 60_000, None))
    out = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id = 1000").first()
    assert out.lang_pred == "de" and 0 <= out.score <= 1
