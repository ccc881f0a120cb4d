"""Keyed state with time-to-live, and deliveries that a replay doesn't repeat."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from prospectrum.operators.service import new_deliveries
from prospectrum.runtime import ship
from prospectrum.streaming.incremental import dropped

DAY = 86_400_000_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Values that the keys of a living master share: four million keys are about a thousand, some 80 kB, a slot.
SLOTS = 4096


class Lives(StatefulProcessor):
    """Lives of the keys of a slot: when each was first and last seen, how often, and the first filled value of each column. A
    key that is not seen for longer than the time-to-live is over: the slot's timer, set for its first key to end, ends it
    when the watermark passes, or the key's next row does, which begins a new life. All lives of a slot are one value,
    as each call to the state store waits for an answer: a batch has a few calls for each slot, not for each key."""

    def __init__(self, columns: list[str], ttl: int) -> None:
        self.columns, self.ttl = columns, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("lives", "keys array<string>, first array<bigint>, last array<bigint>, n array<bigint>, filled array<array<string>>")

    def told(self, updates: list[tuple]) -> pd.DataFrame:
        """Updates as rows: key, life, whether it is over."""
        return pd.DataFrame([(key, *life[:3], *life[3], over) for key, life, over in updates], columns=["dedupe_key", "first_seen", "last_seen", "n_seen", *self.columns, "over"])

    def due(self, last: int) -> int:
        return (last + self.ttl) // 1000 + 1

    def alarm(self, lives: dict[str, tuple]) -> int | None:
        return self.due(min(life[1] for life in lives.values())) if lives else None

    def held(self) -> dict[str, tuple]:
        if not self.value.exists():
            return {}
        keys, *parts = self.value.get()
        return dict(zip(keys, zip(*parts, strict=True), strict=True))

    def keep(self, lives: dict[str, tuple]) -> None:
        if lives:
            self.value.update((list(lives), *map(list, zip(*lives.values(), strict=True))))
        else:
            self.value.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        lives, touched, over = self.held(), {}, []
        before = self.alarm(lives)
        own = [r for part in rows for r in zip(*(part.iloc[:, i].tolist() for i in range(2 + len(self.columns))), strict=True)]
        for name, seen, *values in sorted(own, key=lambda r: r[1]):
            life = lives.get(name)
            if life and seen - life[1] > self.ttl:
                over.append((name, life, True))
                life = None
            if life is None:
                life = (seen, seen, 0, [v if isinstance(v, str) else None for v in values])
            first, last, n, filled = life
            filled = [a or (b if isinstance(b, str) and b else a) for a, b in zip(filled, values, strict=True)]
            lives[name] = touched[name] = (min(first, seen), max(last, seen), n + 1, filled)
        self.keep(lives)
        after = self.alarm(lives)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        yield self.told(over + [(name, life, False) for name, life in touched.items()])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        lives, now = self.held(), timerValues.getCurrentWatermarkInMs()
        over = [(name, life, True) for name, life in lives.items() if self.due(life[1]) <= now]
        for name, *_ in over:
            del lives[name]
        self.keep(lives)
        if lives:
            self.handle.registerTimer(self.alarm(lives))
        if over:
            yield self.told(over)

    def close(self) -> None:
        pass


def living_master(stream: DataFrame, columns: list[str], late: str = "0 seconds", days: float = 30, slots: int = SLOTS) -> DataFrame:
    """Updates of the lives of a stream's keys (dedupe_key, seen_us: microseconds, and string columns): dedupe_key, first_seen,
    last_seen, n_seen, columns, over. Updates are those of a micro-batch's own keys and of those whose time is over. Keys are
    dealt over slots by hash, and a micro-batch reads and writes the slots that such keys are in, and nothing else; more slots suit
    small batches over very many keys, and a checkpoint keeps the number it began with. Rows without key or time are left out,
    as are rows later than the watermark."""
    ship(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own = stream.where("dedupe_key is not null and seen_us is not null").select("dedupe_key", "seen_us", *columns, F.timestamp_micros("seen_us").alias("_at"), F.expr(f"cast(pmod(xxhash64(dedupe_key), {slots}) as int)").alias("_slot")).withWatermark("_at", late)
    kinds = ", ".join(["dedupe_key string, first_seen bigint, last_seen bigint, n_seen bigint", *(f"`{c}` string" for c in columns), "over boolean"])
    return own.groupBy("_slot").transformWithStateInPandas(Lives(columns, int(days * DAY)), kinds, "Update", "EventTime")


def latest_lives(updates: DataFrame) -> DataFrame:
    """The last update of each life: the master with its past, from what living_master has written."""
    rest = [c for c in updates.columns if c not in ("dedupe_key", "first_seen")]
    last = updates.groupBy("dedupe_key", "first_seen").agg(F.max_by(F.struct(*rest), F.struct("n_seen", "over")).alias("x"))
    return last.select("dedupe_key", "first_seen", *(f"x.{c}" for c in rest))


# Deliveries.


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that were written to their end."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch-") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def deliveries(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """What was delivered, in all batches or those before one; files of a batch that broke off don't count."""
    own = [f"{path}/batch-{n}" for n in batches(spark, path) if before is None or n < before]
    return spark.read.schema(schema).parquet(*own) if own else spark.createDataFrame([], schema)


def deliver_into(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for rows with user_id and lead_id: adds those that no earlier batch has delivered, as the
    batch's own folder. A batch that is run again, whole or after a write that broke off, replaces its folder with the
    same rows, so each (user, lead) is there once."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = ", ".join(f"`{c}` {k}" for c, k in batch.dtypes)
        new_deliveries(deliveries(spark, path, schema, number), batch).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    return run


def once_within(stream: DataFrame, at: str, late: str) -> DataFrame:
    """A stream of deliveries without repeats that come within the delay: most are met in state, before the look at what
    was delivered earlier."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["user_id", "lead_id"])


def compacted(spark: SparkSession, path: str, schema: str) -> int:
    """Earlier batches as one, so that the number of folders stays small; how many went into it. The last batch stays, as it may be
    run again; the new folder counts when it is complete, and rows that are in both are dropped by the next look."""
    done = batches(spark, path)[:-1]
    if len(done) < 2:
        return 0
    whole = spark.read.schema(schema).parquet(*(f"{path}/batch-{n}" for n in done)).dropDuplicates(["user_id", "lead_id"])
    staged = f"{path}-compact"
    whole.write.mode("overwrite").parquet(staged)
    spark.read.schema(schema).parquet(staged).write.mode("overwrite").parquet(f"{path}/batch-{done[-1]}")
    for n in done[:-1]:
        dropped(spark, f"{path}/batch-{n}")
    dropped(spark, staged)
    return len(done)
