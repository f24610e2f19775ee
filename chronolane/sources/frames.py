"""Raw thermal frame containers as a Spark data source.

A container is a run of frames.  Each begins with a 64-byte header (four magic bytes, a block count at
0x1C), then 32-byte block entries from 0x40 (tag at +0, offset at +12, size at +16); the block tagged
0x00020001 has a 32-byte head with width at +2 and height at +4, then little-endian 16-bit pixels.  The
first frame may have its own size, all others share one, so any frame's place can be computed and one
file is read by many tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

MAGIC = b"FFF\0"
RAW_BLOCK = 0x00020001
SCHEMA = "path string, frame long, height int, width int, pixels array<int>"
HEADER = "path string, frames long, height int, width int, r1 double, r2 double, b double, f double, o double, bytes_read long"
#: The block of camera data (low half of its tag), and where it holds the constants R1, B, F, R2 (32-bit floats) and O (a 32-bit integer).
CAMERA_BLOCK = 0x0020
CONSTANTS = {"r1": ("<f", 0x58), "b": ("<f", 0x5C), "f": ("<f", 0x60), "o": ("<i", 0x308), "r2": ("<f", 0x30C)}
HEAD_BYTES = 4096


def _open(path: str):
    system, root = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    return system, root


def blocks(head: bytes) -> list[tuple[int, int, int]]:
    """(tag, offset, size) of the blocks that a frame's head lists."""
    if head[:4] != MAGIC or len(head) < 0x20:
        return []
    count = struct.unpack_from("<I", head, 0x1C)[0]
    return [struct.unpack_from("<I8xII", head, 0x40 + 32 * k) for k in range(count) if 0x40 + 32 * (k + 1) <= len(head)]


def frame_size(head: bytes) -> int:
    return max((o + s for _, o, s in blocks(head)), default=0)


def decode(raw: bytes) -> np.ndarray:
    """The pixels of one frame."""
    if raw[:4] != MAGIC:
        raise ValueError("not a frame")
    _, at, _ = next(b for b in blocks(raw) if b[0] == RAW_BLOCK)
    width, height = struct.unpack_from("<HH", raw, at + 2)
    return np.frombuffer(raw, "<u2", width * height, at + 32).reshape(height, width)


def layout(file, size: int) -> tuple[int, int, int]:
    """(size of the first frame, size of the others, number of frames)."""
    file.seek(0)
    first = frame_size(file.read(HEAD_BYTES))
    if first <= 0 or first > size:
        return 0, 0, 0
    file.seek(first)
    head = file.read(HEAD_BYTES)
    rest = frame_size(head) if head[:4] == MAGIC else 0
    return first, rest, 1 + ((size - first) // rest if rest else 0)


@dataclass
class Frames(InputPartition):
    path: str
    start: int
    stop: int
    first: int
    rest: int


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per_task = options["path"], int(options.get("framesPerPartition", 256))
        self.every = int(options.get("every", 1))
        self.lo, self.hi = 0, None

    def pushFilters(self, filters):
        for f in filters:
            if f.attribute != ("frame",):
                yield f
            elif isinstance(f, EqualTo):
                self.lo, self.hi = max(self.lo, f.value), f.value + 1 if self.hi is None else min(self.hi, f.value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.lo = max(self.lo, f.value)
            elif isinstance(f, LessThan | LessThanOrEqual):
                top = f.value + isinstance(f, LessThanOrEqual)
                self.hi = top if self.hi is None else min(self.hi, top)
            else:
                yield f

    def partitions(self) -> list[Frames]:
        system, root = _open(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.base_name.endswith(".seq")]
        out = []
        for f in sorted(files, key=lambda x: x.path):
            with system.open_input_file(f.path) as file:
                first, rest, n = layout(file, f.size)
            stop = n if self.hi is None else min(n, self.hi)
            out += [Frames(f.path, k, min(k + self.per_task, stop), first, rest) for k in range(self.lo, stop, self.per_task)]
        return out or [Frames("", 0, 0, 0, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as file:
            for k in range(partition.start, partition.stop):
                if k % self.every:
                    continue
                at = 0 if k == 0 else partition.first + (k - 1) * partition.rest
                file.seek(at)
                frame = decode(file.read(partition.first if k == 0 else partition.rest))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path]), pa.array([k], pa.int64()), pa.array([frame.shape[0]], pa.int32()), pa.array([frame.shape[1]], pa.int32()), pa.array([frame.ravel().astype(np.int32)], pa.list_(pa.int32()))], ["path", "frame", "height", "width", "pixels"]
                )


class FrameSource(DataSource):
    """format("frames"): options path, framesPerPartition and every."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)


def header(file, path: str, size: int) -> dict:
    """What a container's heads say: frames, size of a frame, the camera's constants (NULL where there are none); no pixel is read."""
    first, rest, frames = layout(file, size)
    out = dict.fromkeys(["height", "width", *CONSTANTS]) | {"path": path, "frames": frames, "bytes_read": min(size, HEAD_BYTES) + (min(size - first, HEAD_BYTES) if first else 0)}
    file.seek(0)
    head = file.read(HEAD_BYTES)
    for tag, at, long in blocks(head) if frames else []:
        if tag == RAW_BLOCK:
            file.seek(at)
            out["width"], out["height"] = struct.unpack("<2xHH", file.read(6))
            out["bytes_read"] += 6
        elif tag & 0xFFFF == CAMERA_BLOCK:
            file.seek(at)
            own = file.read(long)
            out["bytes_read"] += len(own)
            out |= {name: float(struct.unpack_from(kind, own, place)[0]) for name, (kind, place) in CONSTANTS.items() if place + 4 <= len(own)}
    return out


class HeaderReader(DataSourceReader):
    """Files are dealt to tasks by the listing alone; the tasks open them."""

    def __init__(self, options: dict):
        self.path, self.per_task = options["path"], int(options.get("filesPerPartition", 64))

    def partitions(self) -> list[InputPartition]:
        system, root = _open(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.base_name.endswith(".seq")]
        named = sorted((f.path, f.size) for f in files)
        return [InputPartition(named[k : k + self.per_task]) for k in range(0, len(named), self.per_task)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = _open(self.path)
        for path, size in partition.value:
            with system.open_input_file(path) as file:
                found = header(file, path, size)
            yield tuple(found[c.split()[0]] for c in HEADER.split(", "))


class HeaderSource(DataSource):
    """format("frame_headers"): a row per container; options path and filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "frame_headers"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


def encode(pixels: np.ndarray, pad: int = 0, constants: dict | None = None) -> bytes:
    """One frame in the container's layout, with a block of camera data if there are constants."""
    h, w = pixels.shape
    camera = bytearray(0x310 if constants else 0)
    for name, value in (constants or {}).items():
        struct.pack_into(CONSTANTS[name][0], camera, CONSTANTS[name][1], int(value) if name == "o" else value)
    at, body = 0x80 + pad + len(camera), 32 + pixels.size * 2
    head = bytearray(at)
    head[:4], head[4:14] = MAGIC, b"ResearchIR"
    struct.pack_into("<I", head, 0x1C, 1 + bool(constants))
    struct.pack_into("<I8xII", head, 0x40, RAW_BLOCK, at, body)
    if constants:
        struct.pack_into("<I8xII", head, 0x60, CAMERA_BLOCK, at - len(camera), len(camera))
        head[at - len(camera) :] = camera
    sub = bytearray(32)
    struct.pack_into("<HH", sub, 2, w, h)
    return bytes(head) + bytes(sub) + pixels.astype("<u2").tobytes()


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    spark.dataSource.register(HeaderSource)
