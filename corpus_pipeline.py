"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last give the columns of documents; other columns, whatever their names, end at the first.
No stage looks at a part of its rows or texts, and an empty table goes through all of them as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.llm import common, language, near_copies, packing, quality, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Below this score a language is no finding; clean prose scores far above.
LANGUAGE_SCORE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with their values as they were. Nulls in any column are features
    of their own, a null or empty text is judged as the empty text, a long one whole; repeated rows are judged
    alike, so all of them stay or go; a score at the threshold is accepted. Without labels of both classes all stay."""
    return quality.classify(docs.select(*COLUMNS), common.table(spark, sf_dir, "labels")).where("accepted").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; lang stays as it was, right or wrong or null. A text that is null
    or empty, or has no letter, has no language and goes. Repeated rows are judged alike. Where no row has a language
    to learn from, none is found, and all rows go."""
    return language.identify(docs.select(*COLUMNS)).where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, Jaccard 0.8 or more, in chains too): that with the
    least doc_id, rows without one last; among equal ids that with the least hash of its columns. Repeated rows are
    copies like any other, so one stays; texts of fewer than five words are one shingle; null texts and those without
    words are copies of each other. A text of any length is compared whole."""
    docs = docs.select(*COLUMNS)
    row = F.xxhash64(*COLUMNS)
    rows = docs.select("doc_id", row.alias("row"), near_copies.node().alias("node")).join(near_copies.groups(docs), "node", "left")
    rows = common.written(rows, rows=docs.count())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    group = F.coalesce("root", "node").alias("group")
    crowds = rows.groupBy(group).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("group", F.col("first.row").alias("stays"))
    judged = rows.select("row", group).join(crowds, "group").groupBy("row").agg(F.bool_or(F.col("row") == F.col("stays")).alias("stays"), F.count(F.lit(1)).alias("copies"))
    judged = common.written(judged, rows=docs.count())
    # Most rows are alone in their group, and are told by their bits where they are read; only the others are dealt.
    words, size = near_copies.bit_words(judged, "row", judged.count())
    seen = near_copies.told(docs.withColumn("row", row), "row", words, size)
    alone, others = seen.where("not told"), seen.where("told").join(judged.hint("merge"), "row", "left")
    out = alone.select(*COLUMNS).unionByName(others.where("stays is null or (stays and copies = 1)").select(*COLUMNS))
    if judged.where("stays and copies > 1").isEmpty():
        return out
    repeated = others.where("stays and copies > 1").dropDuplicates(["row"])  # equal in all columns
    return out.unionByName(repeated.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that start in an earlier document; texts of which nothing is left go. Null, empty and
    short texts stay as they are; rows of one doc_id don't remove from each other, and rows without one come last.
    n_chars is counted anew where something was removed."""
    cut = suffix_dedup.suffix_array_dedup(docs.select(*COLUMNS))
    gone = (F.size("removed") > 0) & (F.length("text") == 0)
    return cut.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left; a null or empty text is a piece of its end id alone, a long one is cut, and
    rows that repeat or share a doc_id are packed each."""
    return packing.best_fit_pack(docs, common.tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language id", language_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: Classifiers and tokenizers can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
    return docs
