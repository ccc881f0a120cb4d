"""Hierarchical language identification (operator 2).

Character trigrams of the whole text are hashed into one normalised vector. A first layer of linear SVMs, one
against the rest, picks the language family; inside it, one-versus-one linear SVMs vote for the language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospectrum.llm import common
from prospectrum.llm.linear import linear_svm, margin, sigmoid

DIM = 4096
#: Bounds of the training sample: different texts of each language, and of all where there are many languages, of which
#: each keeps LEAST_ROWS. They are those of least hash.
TRAIN_ROWS, ALL_ROWS, LEAST_ROWS = 700, 20_000, 5
#: Examples up to which their keys are broadcast (a code and 64 digits each). Parts of a language while its first are sought.
BROADCAST_ROWS, SALTS = 25_000, 64

#: Families of common language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indic": "hi ur bn mr ne gu pa si",
    "cjk": "zh ja ko",
    "semitic": "ar he am mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(texts: list[str | None]) -> np.ndarray:
    """Rows of hashed trigrams of each whole text: roots of the counts, of length one."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        b = np.frombuffer(b" " + (t or "").lower().encode().translate(_BLANK) + b" ", np.uint8)
        for at in range(0, len(b) - 2, 1 << 20):
            x = b[at : at + (1 << 20) + 2].astype(np.uint32)
            code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761) >> np.uint32(20)
            out[i] += np.bincount(code, minlength=DIM)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        lang = np.array(langs)
        self.examples = {str(v): int((lang == v).sum()) for v in sorted(set(langs))}
        family = np.array([FAMILY_OF.get(v.lower().split("-")[0], v) for v in langs])
        self.families = sorted(set(family.tolist()))
        self.members = {f: sorted(set(lang[family == f].tolist())) for f in self.families}
        self.top = {f: linear_svm(x, np.where(family == f, 1, -1)) for f in self.families} if len(self.families) > 1 else {}
        self.pairs = {}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                own = (lang == a) | (lang == b)
                self.pairs[a, b] = linear_svm(x[own], np.where(lang[own] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score from 0 to 1 of each row."""
        n = len(x)
        by_family = np.stack([margin(self.top[f], x) for f in self.families], axis=1) if self.top else np.ones((n, 1))
        best = by_family.argmax(axis=1)
        score = sigmoid(4 * by_family.max(axis=1))
        out = np.empty(n, object)
        for k, f in enumerate(self.families):
            own = np.flatnonzero(best == k)
            names = self.members[f]
            votes, total, least = (np.zeros((len(own), len(names))) for _ in range(3))
            least += np.inf
            for i, j in combinations(range(len(names)), 2):
                m = margin(self.pairs[names[i], names[j]], x[own])
                for at, z in ((i, m), (j, -m)):
                    votes[:, at] += z > 0
                    total[:, at] += z
                    least[:, at] = np.minimum(least[:, at], z)
            won = np.lexsort((total, votes), axis=1)[:, -1] if len(own) else np.empty(0, np.int64)
            out[own] = np.array(names, object)[won]
            if len(names) > 1:
                score[own] *= sigmoid(4 * least[np.arange(len(own)), won])
        return out.tolist(), score


def held_out(doc_id: F.Column) -> F.Column:
    """Kept from training: crc32 of the id's text leaves 1 modulo 3. Rows without id are kept from it, too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def train(docs: DataFrame) -> Model | None:
    """From a bounded sample of different texts with a language; None where there is none. The driver gets 8 kB for each:
    TRAIN_ROWS of a language, ALL_ROWS in all, or LEAST_ROWS of each where there are more than 4,000 languages."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # Equal texts of a language are one example, so that copies neither crowd out others nor multiply.
    known = known.select("text", "lang", F.xxhash64(F.lit(11), "text").alias("draw"), F.sha2("text", 256).alias("same"))
    least = common.written(known.select("lang", "draw", "same").distinct())
    languages = least.select("lang").distinct().count()
    if not languages:
        return None
    rows_each = max(LEAST_ROWS, min(TRAIN_ROWS, ALL_ROWS // languages))
    # The least hashes of each language, exactly so many, or all where it has fewer. Each salt keeps its own first, so that
    # no task holds a large language.
    least = least.withColumn("salt", F.pmod("draw", F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("draw", "same"))
        least = least.withColumn("nth", nth).where(F.col("nth") <= rows_each)
    least = common.written(least.select("lang", "same"), rows=languages * rows_each)
    chosen = known.join(F.broadcast(least) if languages * rows_each <= BROADCAST_ROWS else least.hint("merge"), ["lang", "same"])
    picked = chosen.groupBy("lang", "same").agg(F.min("text").alias("text")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sized(common.slices(batches, 256), "text"):
            x = features(b.column("text").to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    common.ship(docs.sparkSession)
    rows = sorted(picked.mapInArrow(run, "lang string, x binary").collect(), key=lambda r: (r["lang"], bytes(r["x"])))
    return Model(np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32), [r["lang"] for r in rows]) if rows else None


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame) -> DataFrame:
    """All columns of docs with lang_pred and score added (columns of those names are replaced).

    The model learns from text and lang of a bounded sample of the rows that aren't held out; equal texts of a language are one
    example, and every language among these rows can be predicted. ``und`` with score 0 where the text is null or has no letter, or nothing could be learned.
    A text of any length is looked at whole, a megabyte at a time. Ties of votes go to the larger sum of margins,
    then to the later code. Repeated rows get equal predictions; an empty table gives an empty result."""
    model = train(docs)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sized(common.slices(batches, 256), "text"):
            texts = b.column("text").to_pylist()
            own = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if own:
                names, got = model.predict(features([texts[i] for i in own]))
                score[own] = got
                for i, v in zip(own, names, strict=True):
                    pred[i] = v
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(pred, pa.string()), pa.array(score)], names=[*rest, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rest)
    return common.map_arrow(docs.select(*[F.col(f"`{c}`") for c in rest]), run, f"{schema}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable] = {"op2_language_id": op2_language_id}
