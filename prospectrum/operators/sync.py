"""Sync of scored leads to the stored table, in batches that fail or succeed whole.

Leads are dealt to batches by a hash of their key and staged once. Each batch is handed to a writer, tried again
after a pause, and where it still fails its leads are kept in a recovery table: synced + failed = leads with a key.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.operators import leads
from prospectrum.operators.service import ATTEMPTS, PAUSES, with_retry
from prospectrum.streaming.incremental import master_versions

BATCHES = 64


@dataclass(frozen=True)
class Synced:
    """Counts of rows: synced, failed and without a key; recovery: where the failed ones are, None if none are;
    keys: (dedupe_key) of the synced ones."""

    synced: int
    failed: int
    keyless: int
    recovery: str | None
    keys: DataFrame

    def ids(self, stored: DataFrame) -> DataFrame:
        """(dedupe_key, id) of what was synced."""
        return self.keys.join(stored.select("dedupe_key", "id"), "dedupe_key")


def batch_of(key: Column, batches: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")


def sync(rows: DataFrame, write: Callable[[int, DataFrame], None], folder: str, batches: int = BATCHES, batch: Column | None = None, attempts: int = ATTEMPTS, pauses: tuple[float, ...] = PAUSES, sleep: Callable[[float], None] = time.sleep) -> Synced:
    """rows: leads with dedupe_key, in any order; write(number, rows of the stored table) raises where it fails. The
    driver walks over batches, of which there is a fixed number, never over rows."""
    spark = rows.sparkSession
    own = rows.withColumn("_batch", F.when(F.col("dedupe_key").isNull(), -1).otherwise(batch_of(F.col("dedupe_key"), batches) if batch is None else batch))
    own.write.partitionBy("_batch").parquet(f"{folder}/staged")
    staged = spark.read.schema(own.schema).parquet(f"{folder}/staged")
    counts = {r["_batch"]: r["n"] for r in staged.groupBy("_batch").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a batch
    failed = []
    for i in sorted(b for b in counts if b >= 0):
        part = leads.to_row(staged.where(F.col("_batch") == i).drop("_batch"))
        try:
            with_retry(lambda: write(i, part), attempts, pauses, sleep)  # noqa: B023
        except Exception:  # the store's own
            failed.append(i)
    lost = staged.where(F.col("_batch").isin(failed)).drop("_batch")
    if failed:
        lost.write.parquet(f"{folder}/recovery")
    done = staged.where((F.col("_batch") >= 0) & ~F.col("_batch").isin(failed)).select("dedupe_key").distinct()
    n_failed, keyless = sum(counts[i] for i in failed), counts.get(-1, 0)
    return Synced(sum(counts.values()) - keyless - n_failed, n_failed, keyless, f"{folder}/recovery" if failed else None, done)


class Store:
    """A stored table in as many folders as there are batches, each with versions: a batch that is written again, or
    breaks off, leaves the others as they were."""

    def __init__(self, spark: SparkSession, path: str, empty: DataFrame, now: Column) -> None:
        self.spark, self.path, self.empty, self.now = spark, path, empty, now

    def folder(self, number: int) -> DataFrame:
        root = f"{self.path}/batch={number}"
        done = master_versions(self.spark, root)
        return self.spark.read.schema(self.empty.schema).parquet(f"{root}/v={done[-1]}") if done else self.empty

    def write(self, number: int, rows: DataFrame) -> None:
        root = f"{self.path}/batch={number}"
        done = master_versions(self.spark, root)
        new = leads.upsert(self.folder(number), rows, self.now)
        new.write.mode("overwrite").parquet(f"{root}/v={(done[-1] if done else 0) + 1}")

    def read(self, batches: int = BATCHES) -> DataFrame:
        out = self.empty
        for i in range(batches):
            if master_versions(self.spark, f"{self.path}/batch={i}"):
                out = out.unionByName(self.folder(i))
        return out
