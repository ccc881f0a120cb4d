"""Media columns (operator 7): texts stored as progressive JPEG files and read back as RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.llm import common
from prospectrum.llm import progressive_jpeg as jpeg

UNIT = 64


def padded(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a JPEG file) of each whole text. Null is the empty text; repeated rows, and rows that
    share a doc_id or have none, are encoded each; an empty table gives an empty one; extra columns are ignored. A
    text is one file whatever its length, as long as a side of at most 65,535 pixels can hold it (over 4 GB); it is
    held in memory whole, with about forty bytes for each of its own while it is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 256):
            raw = [x or b"" for x in b.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([jpeg.encode(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw")), run, "doc_id long, n_bytes long, media binary")


def feature(rgb: np.ndarray) -> str:
    """Size, the channels' sums and the number of saturated samples: integers, so equal for equal files."""
    r, g, b = (int(rgb[:, :, k].sum(dtype=np.int64)) for k in range(3))
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{r}:{g}:{b}:{np.count_nonzero(rgb == 255)}"


def decode_media(stored: DataFrame) -> DataFrame:
    """doc_id, width, height and the RGB tensor (row by row, three bytes a pixel) of each file; null media gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 64):
            rgb = [None if m is None else jpeg.tensor(jpeg.decode(m)) for m in b.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([None if x is None else x.shape[k] for x in rgb], pa.int32()) for k in (1, 0)), pa.array([None if x is None else x.tobytes() for x in rgb], pa.binary())], names=["doc_id", "width", "height", "rgb"])

    return common.map_arrow(stored.select("doc_id", "media"), run, "doc_id long, width int, height int, rgb binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, rgb binary"


def digest_media(stored: DataFrame) -> DataFrame:
    """What the stored files hold, from their bytes, with the full-resolution RGB tensor of each (row by row, three
    bytes a pixel). The feature is computed from the tensor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 64):
            out = []
            for d, n, m in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                frame = jpeg.decode(m)
                p, rgb = jpeg.payload_of(frame), jpeg.tensor(frame)
                out.append((d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(rgb), rgb.shape[1], rgb.shape[0], rgb.tobytes()))
            long, text = pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (long, long, long, text, long, long, text, text, pa.int32(), pa.int32(), pa.binary()), strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])

    return common.map_arrow(stored.select("doc_id", "n_bytes", "media"), run, DIGEST)


def op7_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_media(common.written(encode_media(common.documents(spark, sf_dir)), compression="zstd"))


QUERIES: dict[str, Callable] = {"op7_media_jpeg": op7_media_jpeg}
