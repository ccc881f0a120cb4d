"""Quality classifier by co-training (operator 6).

Two views of a page: its text (character classes and their bigrams, line and word repetition, words by hash) and its
metadata (source, language, size). A logistic regression for each view learns from labelled rows. In each round a
view labels all unlabelled documents of which it is sure, and the other view learns from all of those: one pass over
the whole corpus gives the sums of their gradients and curvatures, which stand for them in the next fit. The views'
log-odds are then calibrated each on labelled rows that no fit saw, weighed together on others, and score all
documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.llm import common
from prospectrum.llm.linear import logistic, sigmoid

#: Bound of the sample of labelled rows that the models are fitted on; which rows is decided by a hash of doc_id.
LABELLED_ROWS = 4000
#: Rounds; from which probability on a view is sure; the weight of all pseudo-labels of a class against all labelled rows.
ROUNDS, CONFIDENT, SHARE = 3, 0.97, 0.5
THRESHOLD = 0.5
CLASSES, MEASURES, WORDS = 64, 8, 24
TEXT = CLASSES + MEASURES + WORDS
SOURCES, LANGS, SIZES = 64, 16, 16
META = SOURCES + LANGS + SIZES
#: Sums are rounded to this, so that the order in which tasks' sums are added changes nothing.
GRAIN = 2.0**-20

_CLASS = np.array([4 if b == 10 else 3 if b in b" \t\r\x0b\x0c" else 0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit() else 5 if b in b".,;:?!'\"()-" else 6 if b < 128 else 7 for b in range(256)], np.uint8)


def text_view(texts: list[str | None]) -> np.ndarray:
    """Of each text the shares of class bigrams (64), 8 measures of size, repetition and mixture, and the shares of
    words by hash (24); null is the empty text."""
    out = np.zeros((len(texts), TEXT))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        c = _CLASS[np.frombuffer(raw, np.uint8)]
        if len(c) > 1:
            for at in range(0, len(c) - 1, 1 << 20):
                x = c[at : at + (1 << 20) + 1]
                out[i, :CLASSES] += np.bincount(x[:-1] * 8 + x[1:], minlength=CLASSES)
            out[i, :CLASSES] /= len(c) - 1
        words, lines = raw.lower().split(), [x for x in raw.split(b"\n") if x.strip()]
        n, m, kinds = max(1, len(words)), max(1, len(lines)), Counter(words)
        for w, k in kinds.items():
            out[i, CLASSES + MEASURES + zlib.crc32(w) % WORDS] += k / n
        out[i, CLASSES : CLASSES + MEASURES] = (np.log1p(len(raw)) / 10, len(kinds) / n, len(set(lines)) / m, np.log1p(len(raw) / n) / 3, np.log1p(n / m) / 5, np.log1p(len(zlib.compress(raw, 1))) / np.log1p(len(raw) + 1), (len(words) < 20), max((kinds[w] for w in words[:3]), default=0) / n)
    out[:, :CLASSES] = np.sqrt(out[:, :CLASSES])
    out[:, CLASSES + MEASURES :] = np.sqrt(out[:, CLASSES + MEASURES :])
    return out


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """One place each for the source, the language and the logarithm of the size (hashed; null has its own)."""
    out = np.zeros((len(source), SOURCES + LANGS + SIZES))
    for i, (s, v, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, 0 if s is None else 1 + zlib.crc32(str(s).encode()) % (SOURCES - 1)] = 1
        out[i, SOURCES + (0 if v is None else 1 + zlib.crc32(str(v).encode()) % (LANGS - 1))] = 1
        out[i, SOURCES + LANGS + (0 if n is None else 1 + min(SIZES - 2, int(np.log2(max(1, n)))))] = 1
    return out


def odds(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def extended(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def pseudo_sums(judge: np.ndarray, seen: np.ndarray, learner: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """For either class (bad, good) of rows of which the judging view is sure: their number, and the sums of the
    learning view's gradients and curvatures at its present weights, in one row each."""
    p, x = sigmoid(odds(judge, seen)), extended(own)
    out = []
    for label, sure in ((0, p <= 1 - CONFIDENT), (1, p >= CONFIDENT)):
        z = x[sure]
        q = sigmoid(z @ learner)
        out.append(np.concatenate([[sure.sum()], z.T @ (q - label), ((z * (q * (1 - q))[:, None]).T @ z).ravel()]))
    return out


def refit(x: np.ndarray, y: np.ndarray, w: np.ndarray, sums: list[np.ndarray], ridge: float = 0.3) -> np.ndarray:
    """A fit to labelled rows and to the quadratic form that stands for pseudo-labelled ones around w. Each class of
    these weighs SHARE of all labelled rows, however many there are."""
    x, d = extended(x), len(w)
    g0, h0 = np.zeros(d), np.zeros((d, d))
    for s in sums:
        if s[0] > 0:
            scale = SHARE * len(y) / 2 / s[0]
            g0 += scale * s[1 : d + 1]
            h0 += scale * s[d + 1 :].reshape(d, d)
    penalty = np.full(d, ridge)
    penalty[-1] = 1e-6
    v = w.copy()
    for _ in range(60):
        p = sigmoid(x @ v)
        g = x.T @ (p - y) + penalty * v + g0 + h0 @ (v - w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty) + h0, g)
        v -= step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))  # far steps overshoot where classes separate
        if np.abs(step).max() < 1e-6:
            break
    return v


class CoTraining:
    """views: for each view the labelled rows; y: their labels (0 or 1); passes: a function of the models that gives,
    for each view, pseudo_sums of all unlabelled documents."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, passes: Callable[[list[np.ndarray]], list[list[np.ndarray]]]) -> None:
        turn = np.arange(len(y)) % 5
        parts = [turn < 3, turn == 3, turn == 4]  # to fit, to calibrate, to weigh
        if any(len(set(y[p].tolist())) < 2 for p in parts):
            parts = [np.ones(len(y), bool)] * 3  # too few rows to keep some apart
        fit, own, last = parts
        self.models = [logistic(v[fit], y[fit]) for v in views]
        for _ in range(ROUNDS):
            self.models = [refit(v[fit], y[fit], w, s) for v, w, s in zip(views, self.models, passes(self.models), strict=True)]
        self.scales = [logistic(odds(m, v[own])[:, None], y[own], ridge=0.1) for m, v in zip(self.models, views, strict=True)]
        self.join = logistic(self.calibrated([v[last] for v in views]), y[last], ridge=0.1)

    def calibrated(self, views: list[np.ndarray]) -> np.ndarray:
        """Log-odds of each view, a column each."""
        return np.stack([odds(s, odds(m, v)[:, None]) for m, s, v in zip(self.models, self.scales, views, strict=True)], axis=1)

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: the text's, the metadata's and the joint probability of good quality."""
        z = self.calibrated(views)
        return sigmoid(z[:, 0]), sigmoid(z[:, 1]), sigmoid(odds(self.join, z))


COLUMNS = (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "long"))


def _views(b: pa.RecordBatch) -> list[np.ndarray]:
    text, source, lang, n = (b.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars"))
    return [text_view(text), meta_view(source, lang, n)]


def own_columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast(k).alias(c) for c, k in COLUMNS))


def view_table(docs: DataFrame) -> DataFrame:
    """(doc_id, a, m): both views of each document, in single precision, written once for all rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            views = [v.astype(np.float32) for v in _views(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r.tobytes() for r in v], pa.binary()) for v in views)], names=["doc_id", "a", "m"])

    return common.written(common.map_arrow(own_columns(docs), run, "doc_id long, a binary, m binary"), compression="zstd")


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width).astype(np.float64)


def labelled_rows(views: DataFrame, labels: DataFrame) -> list:
    """Rows (doc_id, quality, a, m) of a bounded sample of the labelled documents; one for a repeated id."""
    draw = F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1_000_000))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    n = known.select("doc_id").distinct().count()
    # Bounded by LABELLED_ROWS, so it may be broadcast whatever the corpus.
    picked = known.where(draw < int(1_000_000 * LABELLED_ROWS / max(1, n)) + 1).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = views.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(F.struct("a", "m")).alias("v"))
    return sorted(own.select("doc_id", "quality", "v.a", "v.m").collect(), key=lambda r: r["doc_id"])


def unlabelled_sums(views: DataFrame, known: np.ndarray, models: list[np.ndarray]) -> list[list[np.ndarray]]:
    """For each learning view the pseudo_sums of all documents that aren't in the sample. A task sends its sums as
    whole numbers of GRAIN, place by place, and these are added before the shuffle."""
    widths = [1 + (TEXT + 1) * (TEXT + 2), 1 + (META + 1) * (META + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(2 * w) for w in widths]
        for b in common.slices(batches, 4096):
            ids = b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, ids), max(0, len(known) - 1))
            free = known[at] != ids if len(known) else np.ones(len(ids), bool)
            x = [unpacked(b.column(c), w)[free] for c, w in (("a", TEXT), ("m", META))]
            for k in (0, 1):
                total[k] += np.concatenate(pseudo_sums(models[1 - k], x[1 - k], models[k], x[k]))
        flat = np.rint(np.concatenate(total) / GRAIN).astype(np.int64)
        place = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(flat[place])], names=["place", "value"])

    common.ship(views.sparkSession)
    sums = np.zeros(2 * sum(widths))
    # As many rows as there are places, whatever the corpus.
    for r in common.map_arrow(views, run, "place long, value long").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        sums[r["place"]] = float(r["value"]) * GRAIN
    first, second = np.split(sums, [2 * widths[0]])
    return [np.split(first, 2), np.split(second, 2)]


def fit(docs: DataFrame, labels: DataFrame) -> CoTraining | None:
    """None where the labels don't hold both classes."""
    views = view_table(docs)
    rows = labelled_rows(views, labels)
    y = np.array([r["quality"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    own = [np.stack([np.frombuffer(r[c], np.float32) for r in rows]).astype(np.float64) for c in ("a", "m")]
    known = np.array([r["doc_id"] for r in rows], np.int64)
    return CoTraining(own, y, lambda models: unlabelled_sums(views, known, models))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of docs with text_score, meta_score, quality_score (0 to 1) and accepted added; columns of
    those names are replaced.

    Nulls in any column have their own features; null text is the empty text. A text of any length is looked at
    whole. Repeated rows get equal scores; of labels that differ for one doc_id the lower counts, and a doc_id that
    several rows share stands for one of them in the labelled sample. A score equal to the threshold is accepted.
    Where the labels don't hold both classes, scores are 1 and all rows are accepted. An empty table gives an empty
    result. Other columns may have any names."""
    model = fit(docs, labels)
    added = ["text_score", "meta_score", "quality_score", "accepted"]
    rest = [c for c in docs.columns if c not in added]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            s = model.score(_views(b)) if model else [np.ones(b.num_rows)] * 3
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *map(pa.array, s), pa.array(s[2] >= THRESHOLD)], names=[*rest, *added])

    own = docs.select(*[F.col(f"`{c}`").cast(dict(COLUMNS)[c]).alias(c) if c in dict(COLUMNS) else F.col(f"`{c}`") for c in rest])
    schema = ", ".join(f"`{c}` {dict(COLUMNS).get(c, kinds[c])}" for c in rest)
    return common.map_arrow(own, run, f"{schema}, text_score double, meta_score double, quality_score double, accepted boolean")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "text_score", "meta_score", "quality_score", "accepted")


QUERIES: dict[str, Callable] = {"op6_quality_classifier": op6_quality_classifier}
