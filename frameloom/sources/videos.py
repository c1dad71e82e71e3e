"""Frame counts and rates of video files, from the headers of MP4 and QuickTime containers.

Spark lists the files; a task reads the boxes' headers by byte ranges and
skips the media between them, so a file costs a few small reads whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, frame_count long, fps double"


class Boxes:
    """The boxes of an open container."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size

    def inside(self, low: int, high: int) -> Iterator[tuple[bytes, int, int]]:
        """Kind and bounds of the content of each box from low to high; a box that does not fit ends them."""
        while low + 8 <= high:
            head = self.file.read_at(min(16, high - low), low)
            size, kind, begin = int.from_bytes(head[:4], "big"), head[4:8], low + 8
            if size == 1 and len(head) == 16:  # the size stands behind the kind
                size, begin = int.from_bytes(head[8:16], "big"), low + 16
            end = high if size == 0 else low + size
            if end > high or end < begin:
                return
            yield kind, begin, end
            low = end

    def find(self, low: int, high: int, *kinds: bytes) -> tuple[int, int] | None:
        """Bounds of the first box on a path of kinds."""
        for kind in kinds:
            found = next(((a, b) for k, a, b in self.inside(low, high) if k == kind), None)
            if found is None:
                return None
            low, high = found
        return low, high

    def number(self, at: int, width: int = 4) -> int:
        return int.from_bytes(self.file.read_at(width, at), "big")

    def video(self) -> tuple[int, float]:
        """Frames and rate of the first video track; (0, 0.0) without one."""
        movie = self.find(0, self.size, b"moov")
        for kind, low, high in self.inside(*movie) if movie else ():
            media = self.find(low, high, b"mdia") if kind == b"trak" else None
            handler = media and self.find(*media, b"hdlr")
            if not handler or self.file.read_at(4, handler[0] + 8) != b"vide":
                continue
            clock, sizes = self.find(*media, b"mdhd"), self.find(*media, b"minf", b"stbl", b"stsz")
            if not clock or not sizes:
                continue
            frames, wide = self.number(sizes[0] + 8), self.number(clock[0], 1) == 1
            scale, length = self.number(clock[0] + (20 if wide else 12)), self.number(clock[0] + (24 if wide else 16), 8 if wide else 4)
            return frames, frames * scale / length if length and scale else 0.0
        return 0, 0.0


def measured(uri: str) -> tuple[int, float]:
    """Frames and rate of a file; (0, 0.0) for what cannot be read or is no such container."""
    try:
        system, path = FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            return Boxes(file, file.size()).video()
    except (OSError, ValueError, pa.ArrowException):
        return 0, 0.0


def probe(spark: SparkSession, folder: str) -> DataFrame:
    """path, frame_count and fps of the files in a folder, as video.video_map takes them; empty files, which Spark does not list, have no row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measured(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([r for _, r in found], pa.float64())], ["path", "frame_count", "fps"])

    # Without `content`, Spark lists the files and reads none.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path"))
    return listed.repartition("path").mapInArrow(work, FILES)
