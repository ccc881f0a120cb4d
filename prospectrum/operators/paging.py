"""Pages of a stored order: the table is kept in ranges that follow each other, so a page is found by counts, and only the
ranges that hold it are read and sorted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.operators.service import LARGEST_PAGE, LeadsQuery, matches, ordered, visible


def order_of(sort_col: str, sort_dir: str, tiebreak: str) -> list[Column]:
    c = F.col("scraped_at" if sort_col == "scraped_at" else "score")
    return [c.asc_nulls_last() if sort_dir == "asc" else c.desc_nulls_last(), F.col(tiebreak).asc()]


@dataclass(frozen=True)
class Ordered:
    """A table in the order of a query's sort column and direction, ties by the tiebreak, which is unique."""

    path: str
    sort_col: str = "score"
    sort_dir: str = "desc"
    tiebreak: str = "id"

    def write(self, df: DataFrame, ranges: int) -> None:
        """One shuffle by ranges, at the time of the write; a range is a folder."""
        by = order_of(self.sort_col, self.sort_dir, self.tiebreak)
        df.repartitionByRange(ranges, *by).withColumn("range", F.spark_partition_id()).sortWithinPartitions(*by).write.mode("overwrite").partitionBy("range").parquet(self.path)

    def page(self, spark: SparkSession, q: LeadsQuery, schema: str | None = None) -> tuple[DataFrame, int]:
        """(the page, the exact total) of visible rows that match. Counting is one aggregation without a sort, a number for each
        range; the page then reads the ranges that it lies in (usually one). A page beyond the end is empty."""
        if (q.sort_col == "scraped_at") != (self.sort_col == "scraped_at") or (q.sort_dir == "asc") != (self.sort_dir == "asc"):
            raise ValueError("the table is kept in another order")
        table = (spark.read if schema is None else spark.read.schema(schema)).parquet(self.path)
        own = table.where(visible(table) & matches(q))
        counts = sorted((r["range"], r["n"]) for r in own.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())
        size = min(LARGEST_PAGE, max(1, q.page_size))
        first, before, within = (max(1, q.page) - 1) * size, 0, []
        skip = None
        for k, n in counts:
            if before < first + size and before + n > first:
                within.append(k)
                skip = first - before if skip is None else skip
            before += n
        page = ordered(own.where(F.col("range").isin(within)), q, self.tiebreak).offset(skip or 0).limit(size) if within else own.limit(0)
        return page.drop("range"), before
