"""Token ids in ORC files (operator 8).

Documents are encoded where they are read; their ids are dealt by range of doc_id and written in ascending order:
one file a range, ids as an integer list column (ORC's integer run-length encoding), with a row index every
``STRIDE`` rows and a Bloom filter on doc_id. Readers get stripes in parallel and skip stripes and row groups by
the indexes. Each row carries its range's number and its place there, so order doesn't hang on file names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prospectrum.llm import common

STRIDE = 1000
STRIPE_BYTES = 16 << 20
#: Bytes of text that a range holds on average.
RANGE_BYTES = 12_000_000
#: Ranges at most: their bounds are numbers on the driver. Beyond, ranges grow.
MOST_RANGES = 1_000_000
LEAST = -(1 << 63)

OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(STRIDE), "orc.create.index": "true", "orc.stripe.size": str(STRIPE_BYTES), "orc.dictionary.key.threshold": "0", "compression": "zstd"}
STORED = "doc_id long, part int, nth long, ids array<int>"


def order_key() -> Column:
    """doc_id, null as the least."""
    return F.coalesce(F.col("doc_id"), F.lit(LEAST))


def bounds(docs: DataFrame) -> list[int]:
    """Keys that cut the rows into ranges of as many rows each. A key may repeat: its rows are dealt to all its ranges."""
    n = min(MOST_RANGES, max(8, -(-common.text_bytes(docs) // RANGE_BYTES)))
    got = docs.agg(F.percentile_approx(order_key(), [k / n for k in range(1, n)], 20 * n)).first()[0]
    return sorted(got or [])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write (doc_id, part, nth, ids) as ORC; by (part, nth) doc_ids ascend, null ones first. Rows of one doc_id are in
    any order among themselves, but in one that the files fix.

    A null or empty text is the end id alone; a text of any length is one row; repeated rows are written each; an
    empty table gives a folder without rows. Extra columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = np.array(bounds(docs), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from prospectrum.llm.fast_encode import encoder

        enc, end, turn = encoder("byte", tokenizer), np.asarray([end_id], "<u4"), 0
        for b in common.sized(batches, "text"):
            ends, flat = enc.column(b.column("text"))
            ids = pa.Array.from_buffers(pa.int32(), len(flat) + b.num_rows, [None, pa.py_buffer(np.insert(flat, ends[1:], end))])
            lists = pa.ListArray.from_arrays(pa.array(ends + np.arange(len(ends)), pa.int32()), ids)
            key = pc.fill_null(b.column("doc_id"), LEAST).to_numpy(zero_copy_only=False)
            low, high = (np.searchsorted(cuts, key, side) for side in ("left", "right"))
            part = low + (turn + np.arange(b.num_rows)) % (high - low + 1)  # a bound's own rows may be on either side
            turn += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(part, pa.int32()), lists], names=["doc_id", "part", "ids"])
        common.give_back()

    coded = common.map_arrow(docs, encode, "doc_id long, part int, ids array<int>")
    dealt = coded.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", order_key())
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's place in its task
    dealt.select("doc_id", "part", nth.alias("nth"), "ids").write.format("orc").options(**OPTIONS).save(path)


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            ids = b.column("ids")
            ends, flat = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().view(np.uint8))
            crc = [zlib.crc32(flat[4 * i : 4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("nth"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "nth", "n_tokens", "ids_crc32"])

    stored = spark.read.schema(STORED).orc(path)
    rows = common.written(common.map_arrow(stored, digest, "doc_id long, part int, nth long, n_tokens long, ids_crc32 long"))
    # A row for each range, of which there are MOST_RANGES at most.
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    own = rows.withColumn("_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return own.join(parts, "part").select("doc_id", (F.col("_start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; stripes and row groups without them are skipped by statistics and Bloom filter."""
    return spark.read.schema(STORED).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_folder(spark)
    write_tokens(common.documents(spark, sf_dir), path, common.tokenizer_file("byte_bpe_50k.json"))
    return read_digest(spark, path)


QUERIES: dict[str, Callable] = {"op8_token_orc": op8_token_orc}
