"""Captures as a data source of Spark: spark.read.format("captures").option("path", ...), and as a stream.

A capture folder has files of JSON lines (ord, url, body) below source=<key>/day=<yyyy-mm-dd>, as Spark writes them with
partitionBy("source", "day"). Each file is a partition; equality, lists and ranges over source and day are pushed into the
listing, so that files of other sources and days are never opened. A stream's offset is the last file seen, by day and name.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from prospectrum.runtime import ship

SCHEMA = "source string, day string, ord long, url string, body string"
_PLACE = re.compile(r"/source=([^/]+)/day=([^/]+)/([^/]+\.json(?:\.gz)?)$")
_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda own, values: own in values}
_LINES = pa.schema([("ord", pa.int64()), ("url", pa.string()), ("body", pa.string())])


@dataclass
class CaptureFile(InputPartition):
    source: str
    day: str
    name: str
    path: str

    def place(self) -> str:
        return f"{self.day}/{self.source}/{self.name}"


def _files(root: str) -> list[CaptureFile]:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    found = (i.path for i in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if i.is_file)
    return sorted((CaptureFile(m[1], m[2], m[3], m.string) for m in map(_PLACE.search, found) if m and m[3][0] not in "._"), key=CaptureFile.place)


def _read(root: str, part: CaptureFile | None) -> Iterator[pa.RecordBatch]:
    """Record batches of one file, block by block; fields that a line lacks are null, others are ignored."""
    from pyarrow import fs, json

    if part is None:  # no file is left
        return
    store, _ = fs.FileSystem.from_uri(root)
    with store.open_input_stream(part.path) as f:
        if f.read(1) == b"":
            return
    with store.open_input_stream(part.path) as f:
        lines = json.open_json(f, json.ReadOptions(block_size=8 << 20), json.ParseOptions(explicit_schema=_LINES, unexpected_field_behavior="ignore"))
        for b in lines:
            yield pa.RecordBatch.from_arrays([pa.array([part.source] * b.num_rows), pa.array([part.day] * b.num_rows), *(b.column(c) for c in _LINES.names)], names=["source", "day", *_LINES.names])


class CaptureReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root, self.tests = root, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("source",), ("day",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[CaptureFile]:
        return [p for p in _files(self.root) if all(_TESTS[kind](getattr(p, name), value) for name, kind, value in self.tests)]

    def read(self, partition: CaptureFile) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition)


class CaptureStream(DataSourceStreamReader):
    def __init__(self, root: str, most: int) -> None:
        self.root, self.most, self.reached = root, most, ""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        places = [p.place() for p in _files(self.root) if p.place() > self.reached]
        if places:
            self.reached = places[: self.most][-1]
        return {"after": self.reached}

    def partitions(self, start: dict, end: dict) -> list[CaptureFile]:
        self.reached = max(self.reached, end["after"])
        return [p for p in _files(self.root) if start["after"] < p.place() <= end["after"]]

    def read(self, partition: CaptureFile) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition)

    def commit(self, end: dict) -> None:
        self.reached = max(self.reached, end["after"])


class Captures(DataSource):
    """Options: path; filesPerTrigger (of a stream, 1000 where it isn't set)."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> CaptureReader:
        return CaptureReader(self.options["path"])

    def streamReader(self, schema: object) -> CaptureStream:  # noqa: N802
        return CaptureStream(self.options["path"], int(self.options.get("filesPerTrigger", "1000")))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Captures)


def write_captures(rows: DataFrame, path: str) -> None:
    """Adds captures (source, day, ord, url, body) to a folder. Files of a day that were seen by a stream aren't changed; what
    comes for a day that a stream has passed is for batch readers only."""
    rows.select("source", "day", "ord", "url", "body").write.mode("append").partitionBy("source", "day").json(path)


def captures(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("captures").option("path", path).load()
