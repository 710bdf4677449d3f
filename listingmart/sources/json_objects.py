"""Objects near the root of a large JSON document as a Spark data source: ``level, text``.

A document without line structure is cut into byte ranges. Where a range starts, nobody knows yet whether a string is
open there or how many brackets enclose it, but both follow from sums: a first job counts quotes and brackets of every
range, for both cases of an open string, and the driver adds up these few numbers. With the state at its start, each
task then finds the objects that begin in its range, and reads on beyond its end only to finish the last one.

Level 1 are the objects that are members of the root, level 2 those one step further in, such as the features of a
FeatureCollection.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from listingmart.sources.monthly_headers import opened

RANGE_BYTES = 4 << 20
# Larger documents get larger ranges, so that the driver adds up at most so many rows a file.
MAX_RANGES = 4096
BLOCK_BYTES = 1 << 20
LEVELS = (1, 2)

QUOTE, BACKSLASH = ord('"'), ord("\\")


def marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Places of all brackets, +1 or -1 for each, whether the quotes before it are odd in number, and whether all quotes
    are. The first byte must not be escaped."""
    chars = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(chars == QUOTE)
    slashes = chars == BACKSLASH
    if slashes.any():
        run_starts = np.flatnonzero(slashes & ~np.concatenate(([False], slashes[:-1])))
        after_run = quotes[(quotes > 0) & slashes[quotes - 1]]
        length = after_run - run_starts[np.searchsorted(run_starts, after_run) - 1]
        quotes = np.setdiff1d(quotes, after_run[length % 2 == 1], assume_unique=True)
    kind = chars | 0x20  # folds [ with { and ] with }
    opens = kind == ord("{")
    places = np.flatnonzero(opens | (kind == ord("}")))
    steps = np.where(opens[places], 1, -1)
    odd = np.searchsorted(quotes, places) % 2 == 1
    return places, steps, odd, len(quotes) % 2 == 1


class Document:
    """A file that is read in pieces, none of which starts right after a backslash."""

    def __init__(self, raw: pa.NativeFile) -> None:
        self.raw = raw
        self.size = raw.size()

    def cut(self, place: int) -> int:
        """The first place from the given one on that follows no backslash."""
        while 0 < place < self.size and self.raw.read_at(1, place - 1) == b"\\":
            place += 1
        return min(place, self.size)

    def piece(self, start: int, end: int) -> bytes:
        return self.raw.read_at(end - start, start)

    def objects(self, start: int, end: int, depth: int, in_string: bool) -> Iterator[tuple[int, str]]:
        """Level and text of the objects that begin between two places, given the state at the first."""
        data = self.piece(start, end)
        places, steps, odd, flips = marks(data)
        real = odd == in_string
        places, steps = places[real], steps[real]
        after = depth + np.cumsum(steps)
        curly = np.frombuffer(data, np.uint8)[places] >= ord("{")
        for level in LEVELS:
            begins = places[curly & (steps > 0) & (after == level + 1)]
            ends = places[curly & (steps < 0) & (after == level)] + 1
            ends = ends[np.searchsorted(ends, begins[0], "right") :] if len(begins) else ends[:0]
            for a, b in zip(begins, ends):
                yield level, data[a:b].decode("utf-8", "replace")
            if len(begins) > len(ends):
                last = after[-1] if len(after) else depth
                yield level, (data[begins[-1] :] + self.rest(end, int(last), in_string != flips, level)).decode("utf-8", "replace")

    def rest(self, place: int, depth: int, in_string: bool, level: int) -> bytes:
        """What follows up to the bracket that closes an object of the level."""
        read = []
        while place < self.size:
            end = self.cut(place + BLOCK_BYTES)
            data = self.piece(place, end)
            places, steps, odd, flips = marks(data)
            real = odd == in_string
            after = depth + np.cumsum(steps[real])
            closed = np.flatnonzero(after == level)
            if len(closed):
                return b"".join(read) + data[: places[real][closed[0]] + 1]
            read.append(data)
            place, depth, in_string = end, int(after[-1]) if len(after) else depth, in_string != flips
        raise ValueError("The JSON document ends inside an object.")


@dataclass
class Range(InputPartition):
    """A byte range of a file; depth and open string are known in the second job only."""

    path: str
    start: int
    end: int
    depth: int = 0
    in_string: bool = False

    def __init__(self, path: str, start: int, end: int, depth: int = 0, in_string: bool = False) -> None:
        super().__init__(path)
        self.path, self.start, self.end, self.depth, self.in_string = path, start, end, depth, in_string


class RangeReader(DataSourceReader):
    """First job: sums of each range."""

    def __init__(self, options: dict[str, str]) -> None:
        self.uri = options["path"]
        self.size = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> Sequence[Range]:
        system, place = opened(self.uri)
        info = system.get_file_info(place)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(place))
        found = []
        for f in sorted((f for f in files if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            step = max(self.size, -(-f.size // MAX_RANGES))
            found += [Range(f.path, a, min(a + step, f.size)) for a in range(0, f.size, step)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple[str, int, int, bool, int, int]]:
        if not partition.path:
            return
        system, _ = opened(self.uri)
        with system.open_input_file(partition.path) as raw:
            document = Document(raw)
            start, end = document.cut(partition.start), document.cut(partition.end)
            _, steps, odd, flips = marks(document.piece(start, end))
        yield partition.path, start, end, flips, int(steps[~odd].sum()), int(steps[odd].sum())


class ObjectReader(DataSourceReader):
    """Second job: the objects of each range."""

    def __init__(self, options: dict[str, str]) -> None:
        self.uri = options["path"]
        self.ranges = [Range(*r) for r in json.loads(options["ranges"])]

    def partitions(self) -> Sequence[Range]:
        return self.ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple[int, str]]:
        if not partition.path:
            return
        system, _ = opened(self.uri)
        with system.open_input_file(partition.path) as raw:
            yield from Document(raw).objects(partition.start, partition.end, partition.depth, partition.in_string)


class RangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return "path string, start bigint, end bigint, flips boolean, outside bigint, inside bigint"

    def reader(self, schema: T.StructType) -> RangeReader:
        return RangeReader(self.options)


class ObjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_objects"

    def schema(self) -> str:
        return "level int, text string"

    def reader(self, schema: T.StructType) -> ObjectReader:
        return ObjectReader(self.options)


def read_objects(spark: SparkSession, uri: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``level, text`` of the objects near the root of a JSON document, or of each document of a folder."""
    spark.dataSource.register(RangeSource)
    spark.dataSource.register(ObjectSource)
    sums = spark.read.format("json_ranges").option("range_bytes", range_bytes).load(uri).collect()
    ranges: list[tuple[str, int, int, int, bool]] = []
    depth, in_string, before = 0, False, None
    for r in sorted(sums):
        if before not in (None, r.path) and (depth or in_string):
            break
        before = r.path
        ranges.append((r.path, r.start, r.end, depth, in_string))
        depth, in_string = depth + (r.inside if in_string else r.outside), in_string != r.flips
    if depth or in_string:
        raise ValueError(f"Not a complete JSON document: {before}")
    return spark.read.format("json_objects").option("ranges", json.dumps(ranges)).load(uri)
