"""Header lines of a folder of monthly CSV files as a Spark data source: ``path, month, header``.

The file names are listed once. Tests on ``month`` are pushed down and decided by the names, so a file of another month
is never opened. The headers of the others are read inside tasks, each of which takes some files, so that one job does
whatever the number of files.
"""

from __future__ import annotations

import csv
import io
import operator
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date

from pyarrow import ArrowInvalid, fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

FORMAT = "monthly_csv_headers"
SCHEMA = "path string, month date, header array<string>"

# Fixed value: the month inside a file name. Only the digits 0 to 9 count, on the driver as in Spark.
MONTH_IN_NAME = r"(20[0-9]{2})[_-]([0-9]{2})"

NO_MONTH = "No month in the file name: "

# Files may be packed one by one; Spark unpacks them by their names.
NAMES = (".csv", ".csv.gz")

# A task opens at most so many files.
FILES_PER_TASK = 16

TESTS = {
    EqualTo: operator.eq,
    In: lambda month, values: month in values,
    GreaterThan: operator.gt,
    GreaterThanOrEqual: operator.ge,
    LessThan: operator.lt,
    LessThanOrEqual: operator.le,
}


def check_file_name(name: str) -> date:
    """First day of the month in a file name; an error where there is none."""
    found = re.search(MONTH_IN_NAME, name)
    if not found:
        raise ValueError(f"{NO_MONTH}{name}")
    return date(int(found[1]), int(found[2]), 1)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system of a qualified path (``file:/...``, ``hdfs://...``, ``s3://...``) and the path inside it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def can_open(uri: str) -> bool:
    try:
        opened(uri)
    except ArrowInvalid:  # a scheme that only the JVM's file systems know
        return False
    return True


def unique_names(header: Sequence[str]) -> list[str]:
    """Column names as Spark's own reader gives them: an unnamed field is ``_c`` and its position, a name that occurs
    twice (in any case) gets its position appended."""
    lower = [name.lower() for name in header]
    return [f"_c{i}" if not name else f"{name}{i}" if lower.count(name.lower()) > 1 else name for i, name in enumerate(header)]


def read_header(stream: io.BufferedIOBase) -> list[str]:
    """Column names of a CSV stream; none if it has no line with text. No more of it is read than some buffers."""
    text = io.TextIOWrapper(stream, encoding="utf-8-sig", errors="replace", newline="")
    return unique_names(next((row for row in csv.reader(text) if row), []))


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]) -> None:
        super().__init__(paths)
        self.paths = paths


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"].rstrip("/")
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute == ("month",):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[Files]:
        system, folder = opened(self.folder)
        listed = system.get_file_info(fs.FileSelector(folder))
        names = sorted(f.base_name for f in listed if f.is_file and f.base_name.endswith(NAMES) and not f.base_name.startswith(("_", ".")))
        kept = [name for name in names if self.wanted(check_file_name(name))]
        groups = [kept[i : i + FILES_PER_TASK] for i in range(0, len(kept), FILES_PER_TASK)]
        return [Files(tuple(g)) for g in groups] or [Files(())]

    def wanted(self, month: date) -> bool:
        return all(TESTS[type(f)](month, f.value) for f in self.tests)

    def read(self, partition: Files) -> Iterator[tuple[str, date, list[str]]]:
        system, folder = opened(self.folder)
        for name in partition.paths:
            with system.open_input_stream(f"{folder}/{name}", compression="gzip" if name.endswith(".gz") else None) as raw:
                yield f"{self.folder}/{name}", check_file_name(name), read_header(io.BufferedReader(raw, 1 << 16))


class HeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> HeaderReader:
        return HeaderReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HeaderSource)
