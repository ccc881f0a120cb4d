"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.runtime import ship, table

__all__ = ["documents", "shared_folder", "written", "slices", "sized", "text_bytes", "tokenizer_file", "table", "ship"]

#: Bytes of text that one group of a two-sided pass holds in a Python worker.
GROUP_BYTES = 12_000_000
#: Bytes of text that are worked on at a time where whole columns are.
SLICE_BYTES = 4 << 20
#: Files of a small table: so many at least, and one more for so many rows.
LEAST_FILES, FILE_ROWS = 3, 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see. Only where the session names
    none (tests on one machine) a temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark.sparkContext, "_prospectrum_dir", None)
        if base is None:
            base = spark.sparkContext._prospectrum_dir = tempfile.mkdtemp(prefix="prospectrum")
    return f"{base.rstrip('/')}/prospectrum-{uuid.uuid4().hex}"


def written(df: DataFrame, form: str = "parquet", rows: int | None = None, **options: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again. Where the number of its (small)
    rows is known, the tasks after the last shuffle are as many as these need, so that no crowd of files arises."""
    spark = df.sparkSession
    path = shared_folder(spark)
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    df.write.options(**options).format(form).save(path)
    out = spark.read.schema(df.schema).format(form).load(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a table that written() made and that nothing will read again."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller record batches, so that Python objects of few rows exist at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def sized(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches of up to so many bytes in a string or binary column; a longer value stands alone."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, before = 0, 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield b.slice(at, stop - at)
            at, before = stop, int(ends[stop - 1])


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)


def groups_for(n_bytes: int) -> int:
    """Number of text groups: grows with the input, so that a group's size does not."""
    return max(8, -(-n_bytes // GROUP_BYTES))


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def give_back() -> None:
    """Return freed memory of this process to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
