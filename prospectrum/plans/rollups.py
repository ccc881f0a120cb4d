"""Daily figures of the stored table that are merged when a dashboard asks: counts that add up, and sketches that merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectrum.functions.text import present

#: Registers of a distinct count, as a power of two (about 1.6 %), and the size of a quantile sketch (about 1.3 % of ranks).
HLL_BITS, KLL_SIZE = 12, 200
COUNTS = ("n", "with_email", "with_phone", "with_linkedin", "scored", "score_sum")


def daily(df: DataFrame, day: Column, *by: str) -> DataFrame:
    """(day, by..., counts, domains, scores): the counts of COUNTS, a sketch of the websites' distinct keys (dedupe_key) and one of
    the scores. One row a day and group, whatever the table's size; a day can be made anew alone."""
    test = lambda c: F.count_if(present(F.col(c)))
    return df.groupBy(day.alias("day"), *by).agg(
        F.count(F.lit(1)).alias("n"), test("email").alias("with_email"), test("phone").alias("with_phone"), test("linkedin").alias("with_linkedin"), F.count("score").alias("scored"), F.coalesce(F.sum("score"), F.lit(0)).cast("long").alias("score_sum"),
        F.hll_sketch_agg("dedupe_key", F.lit(HLL_BITS)).alias("keys"), F.kll_sketch_agg_bigint(F.col("score").cast("long"), F.lit(KLL_SIZE)).alias("scores"),
    )


def merged(rollup: DataFrame, *by: str, ranks: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Figures of any set of days: exact totals and percentages, the average score, about how many different keys, and
    about the score at each rank. Groups without a score have no average and no ranks."""
    sums = [F.sum(c).cast("long").alias(c) for c in COUNTS]
    out = rollup.groupBy(*by).agg(*sums, F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("distinct_keys"), F.kll_merge_agg_bigint("scores").alias("_scores"))
    share = lambda c: F.round(100 * F.col(c) / F.col("n")).cast("int").alias(f"{c}_percent")
    some = F.col("scored") > 0
    at = [F.when(some, F.kll_sketch_get_quantile_bigint("_scores", F.lit(r))).alias(f"score_{round(100 * r)}") for r in ranks]
    return out.select(*by, *COUNTS, *map(share, COUNTS[1:4]), F.when(some, F.col("score_sum") / F.col("scored")).alias("average"), "distinct_keys", *at)
