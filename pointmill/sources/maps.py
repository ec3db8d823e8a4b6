"""Density maps in the electron-microscopy format: a fixed header of 1024 bytes, then voxels in the header's axis order."""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Fixed values of the format: voxel type by mode.
MODES = {0: np.int8, 1: np.int16, 2: np.float32, 6: np.uint16, 12: np.float16}
#: Fixed values of reconstruction files: the stamp of those whose flags count, and the flags of signed bytes and half bytes.
REC_STAMP, REC_SIGNED, REC_HALF_BYTES = 1146047817, 1, 16
#: Voxels of a task, and of a batch within it.
VOXELS, BATCH = 1 << 24, 1 << 16
VOXEL = "set_id string, x int, y int, z int, val float, cell double"


def header(raw: bytes, reconstruction: bool = False) -> dict:
    """Sizes, voxel type, axis order, cell lengths; modes of complex or packed numbers are an error. Bytes of a reconstruction
    (.rec) are unsigned, unless its stamp and flags say signed."""
    if len(raw) < 1024:
        raise ValueError("no room for a header")
    words = struct.unpack("<10i", raw[:40])
    mode = words[3]
    if mode not in MODES:
        raise ValueError(f"mode {mode} isn't supported")
    kind = MODES[mode]
    if reconstruction and mode == 0:
        stamp, flags = struct.unpack("<2i", raw[152:160])
        if stamp == REC_STAMP and flags & REC_HALF_BYTES:
            raise ValueError("voxels of half a byte aren't supported")
        kind = np.int8 if stamp == REC_STAMP and flags & REC_SIGNED else np.uint8
    lengths = struct.unpack("<3f", raw[40:52])
    order = struct.unpack("<3i", raw[64:76])
    extended = struct.unpack("<i", raw[92:96])[0]
    return {"size": words[:3], "mode": mode, "kind": kind, "grid": words[7:10], "lengths": lengths, "order": order if sorted(order) == [1, 2, 3] else (1, 2, 3), "extended": max(0, extended)}


def voxels(raw: bytes, reconstruction: bool = False) -> tuple[np.ndarray, float]:
    """The voxels as [x, y, z], and the width of a cell."""
    h = header(raw, reconstruction)
    kind = np.dtype(h["kind"]).newbyteorder("<")
    body = raw[1024 + h["extended"] :]
    count = int(np.prod(h["size"]))
    if len(body) != count * kind.itemsize:
        raise ValueError("more or fewer bytes than the header says")
    data = np.frombuffer(body, kind).reshape(h["size"][::-1])  # section, row, column
    axes = [3 - 1 - h["order"].index(a) for a in (1, 2, 3)]
    cell = h["lengths"][0] / h["grid"][0] if h["grid"][0] else 1.0
    return data.transpose(axes).astype(np.float32), cell


def _file(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system that a path or address names, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return pyarrow.fs.LocalFileSystem(), path


def _bytes(path: str, start: int, count: int) -> bytes:
    system, name = _file(path)
    with system.open_input_file(name) as f:
        f.seek(start)
        return f.read(count)


@dataclass
class MapPart(InputPartition):
    """Voxels first to last (not included), in the file's own order, of one file."""

    path: str
    header: dict
    first: int
    last: int


def part_voxels(part: MapPart) -> pa.RecordBatch:
    """The rows of a part, for which only its bytes are read."""
    h, kind = part.header, np.dtype(part.header["kind"]).newbyteorder("<")
    raw = _bytes(part.path, 1024 + h["extended"] + part.first * kind.itemsize, (part.last - part.first) * kind.itemsize)
    place = np.unravel_index(np.arange(part.first, part.last), h["size"][::-1])  # section, row, column
    x, y, z = (place[2 - h["order"].index(a)].astype(np.int32) for a in (1, 2, 3))
    n = part.last - part.first
    val = np.frombuffer(raw, kind).astype(np.float32)
    cell = h["lengths"][0] / h["grid"][0] if h["grid"][0] else 1.0
    return pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), *map(pa.array, (x, y, z, val)), pa.array(np.full(n, cell))], names=[c.split()[0] for c in VOXEL.split(", ")])


class MapReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths, self.voxels = json.loads(options["paths"]), int(options.get("voxels", VOXELS))

    def parts(self, path: str) -> list[MapPart]:
        h = header(_bytes(path, 0, 1024), path.lower().endswith(".rec"))
        count = math.prod(h["size"])
        system, name = _file(path)
        if system.get_file_info(name).size != 1024 + h["extended"] + count * np.dtype(h["kind"]).itemsize:
            raise ValueError(f"more or fewer bytes than the header says: {path}")
        return [MapPart(path, h, lo, min(lo + self.voxels, count)) for lo in range(0, count, self.voxels)]

    def partitions(self) -> Sequence[InputPartition]:
        with ThreadPoolExecutor(16) as pool:  # 1,024 bytes of each file
            return [part for parts in pool.map(self.parts, self.paths) for part in parts]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        part = partition
        for lo in range(part.first, part.last, BATCH):
            yield part_voxels(MapPart(part.path, part.header, lo, min(lo + BATCH, part.last)))


class MapSource(DataSource):
    """spark.read.format("density_map") with the options paths (a list as JSON) and voxels (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "density_map"

    def schema(self) -> str:
        return VOXEL

    def reader(self, schema: StructType) -> DataSourceReader:
        return MapReader(self.options)


def read_map(spark: SparkSession, path: str | list[str], section: int = VOXELS) -> DataFrame:
    """set_id, x, y, z, val, cell. A file of any size is read by its byte ranges, section voxels a task and BATCH at once. The
    driver lists the files and reads their headers. Python tasks open the files themselves: by a path that all executors share
    or an address that pyarrow's file systems know. An empty map has no rows; files that disagree with their header are errors."""
    names = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # a list of files: no content is read
    spark.dataSource.register(MapSource)
    return spark.read.format("density_map").option("paths", json.dumps(sorted(names))).option("voxels", str(section)).load()
