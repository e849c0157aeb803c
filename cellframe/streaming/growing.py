"""A stream of the frames of dump files that are still being written: each frame once, as soon as it is whole.

Register with ``spark.dataSource.register(GrowingDumps)`` and read with ``format("growing_dumps")``;
``load`` takes a folder (a path or URI that driver and executors share).  Offsets are bytes by file, so a
query that starts again from its checkpoint goes on behind the last whole frame that it has read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

MARK = b"ITEM: TIMESTEP"
#: Bytes that are looked through at once, and bytes of frames that one task reads at most (and the end of its last frame).
CHUNK, TASK = 1 << 20, 64 << 20
SCHEMA = "file string, byte long, timestep long, text string"


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int  # frames that begin before it belong to the range
    last: int  # no frame reaches beyond it


def opened(uri: str):
    system, path = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))
    return system, path


def marks(source, start: int, end: int) -> Iterator[int]:
    """Places in [start, end) where a frame begins: the mark at the start of a line."""
    at, kept = max(0, start - 1), b""  # the byte before tells whether a mark begins a line
    source.seek(at)
    while at - len(kept) < end:
        data = source.read(CHUNK)
        if not data:
            return
        text, base = kept + data, at - len(kept)
        for found in re.finditer(rb"(?:\A|\n)" + MARK if base == 0 else rb"\n" + MARK, text):
            place = base + found.end() - len(MARK)
            if start <= place < end:
                yield place
        at += len(data)
        kept = text[-len(MARK) :]  # shorter than a line's end with its mark, so none is found twice


def whole_until(source, start: int, size: int) -> int:
    """The byte up to which frames are whole: those before the last mark, and the last if it has all its rows."""
    last, high = None, size
    while last is None and high > start:  # backwards, a chunk at a time
        low = max(start, high - CHUNK)
        last = max(marks(source, low, high), default=None)
        high = low
    if last is None:
        return start
    source.seek(last)
    head = source.read(min(size - last, 1 << 16))
    count = re.search(rb"ITEM: NUMBER OF ATOMS\s*\n\s*(\d+)\s*\n", head)
    rows = re.search(rb"\nITEM: ATOMS[^\n]*\n", head)
    if not count or not rows:
        return last
    wanted, at = int(count[1]), last + rows.end()
    source.seek(at)
    while wanted and at < size:
        data = source.read(min(CHUNK, size - at))
        if not data:
            return last
        if (lines := data.count(b"\n")) >= wanted:
            cut = -1
            for _ in range(wanted):
                cut = data.index(b"\n", cut + 1)
            return at + cut + 1
        wanted, at = wanted - lines, at + len(data)
    return last if wanted else at


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Bytes of whole frames by file; only what came since the last look is looked through."""
        system, path = opened(self.folder)
        for info in system.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if info.type == pafs.FileType.File and not info.base_name.startswith((".", "_")):
                before = self.seen.get(info.base_name, 0)
                if info.size > before:
                    with system.open_input_file(info.path) as source:
                        self.seen[info.base_name] = max(before, whole_until(source, before, info.size))
        return dict(sorted(self.seen.items()))

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        self.seen = {**end, **self.seen}  # after a restart the first look begins where the last batch ended
        return [Range(f, a, min(a + TASK, to), to) for f, to in end.items() for a in range(start.get(f, 0), to, TASK)]

    def read(self, partition: Range) -> Iterator[tuple]:
        system, path = opened(self.folder)
        with system.open_input_file(f"{path.rstrip('/')}/{partition.file}") as source:
            places = list(marks(source, partition.start, partition.end))
            if not places:
                return
            after = next(marks(source, partition.end, partition.last), partition.last)
            for a, b in zip(places, [*places[1:], after], strict=True):
                source.seek(a)
                text = source.read(b - a).decode("utf-8", "replace")
                step = re.match(r"ITEM: TIMESTEP\s*\n\s*(-?\d+)", text)
                yield partition.file, a, int(step[1]) if step else None, text


class GrowingDumps(DataSource):
    """One row a frame: file, byte where it begins, timestep, text."""

    @classmethod
    def name(cls) -> str:
        return "growing_dumps"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"])


def frame_atoms(frames: DataFrame) -> DataFrame:
    """file, byte, frame_index (the timestep), atom_id, sa, sb, sc of a stream or table of scaled dump frames, by columns alone.

    Rows come by the names that the frame gives its columns; a frame without id, xs, ys and zs is an error.
    """
    rows = F.split(F.element_at(F.split("text", r"\nITEM: ATOMS[^\n]*\n"), 2), "\n")
    names = F.split(F.trim(F.regexp_extract("text", r"\nITEM: ATOMS([^\n]*)\n", 1)), r"\s+")
    split = frames.select("file", "byte", F.col("timestep").cast("int").alias("frame_index"), names.alias("names"), F.explode(rows).alias("row")).where(F.trim("row") != "")
    words = split.withColumn("w", F.split(F.trim("row"), r"\s+"))
    at = lambda name: F.element_at("w", F.nullif(F.array_position("names", name), F.lit(0)).cast("int"))
    needed = lambda name: F.coalesce(at(name), F.raise_error(F.lit(f"A frame has no column {name}")))
    return words.select("file", "byte", "frame_index", needed("id").alias("atom_id"), *[needed(n).cast("double").alias(s) for n, s in (("xs", "sa"), ("ys", "sb"), ("zs", "sc"))])
