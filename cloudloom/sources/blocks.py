"""Binary clouds as a partitioned source: a task reads a range of a file's records.

PLY, PCD and LAS have records of one width, so a range of rows is a range of bytes. An
E57 file has scans of packets; a range of a scan's records is the packets that hold them.
Planning reads headers alone, on the driver. What is read are the columns asked for, and
ids are the file's key and the row's place in it, however the file is cut.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import e57, formats

BLOCK_ROWS = 1_000_000  # of a partition
BATCH = 100_000  # rows of a batch
HEAD = 1 << 16  # bytes of a header, at first
_KINDS = {"pid": pa.int64(), "x": pa.float64(), "y": pa.float64(), "z": pa.float64(), "r": pa.int32(), "g": pa.int32(), "b": pa.int32(), "intensity": pa.float32(), "source": pa.string(), "classe": pa.int16()}
_SQL = {pa.int64(): "long", pa.float64(): "double", pa.int32(): "int", pa.float32(): "float", pa.string(): "string", pa.int16(): "smallint"}
COLUMNS = tuple(_KINDS)


def open_file(path: str):
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    return files.open_input_file(at)


@dataclass
class Block(InputPartition):
    """The records ``first`` to ``first + n`` of a file (of one of its scans); ``row`` is the number of the first in the file."""

    path: str
    first: int
    n: int
    row: int
    layout: Any
    colour: bool = True
    intensity: bool = True
    held: e57.Packets | None = None


def key_of(path: str) -> int:
    """23 bits of a path's hash, above the 40 of a row's number."""
    return int.from_bytes(hashlib.blake2b(path.encode(), digest_size=3).digest(), "big") >> 1 << 40


def header(path: str) -> tuple[str, Any, int]:
    """(kind, layout, rows): a :class:`formats.Layout`, a LAS header or a list of scans, from the file's header alone."""
    kind = path.rpartition(".")[2].lower()
    if kind not in ("ply", "pcd", "las", "e57"):
        raise ValueError(f"{path}: no records of a known kind")
    with open_file(path) as f:
        if kind == "e57":
            scans = e57.scans(e57.Pages(f))
            return kind, scans, sum(s.n for s in scans)
        data = f.read(HEAD)
        while kind == "ply" and b"end_header" not in data and data.startswith(b"ply") and (more := f.read(HEAD)):
            data += more
    if kind == "las":
        layout = formats.las_header(data)
        return kind, layout, layout["n"]
    layout = formats.ply_layout(data) if kind == "ply" else formats.pcd_layout(data)
    return kind, layout, layout.n


def blocks_of(path: str, block_rows: int = BLOCK_ROWS) -> list[Block]:
    """The partitions of a file. A scan without cartesian coordinates, or a file without points, is an error; text records are one partition."""
    kind, layout, n = header(path)
    if not n:
        raise ValueError(f"{path} holds no points")
    cuts = lambda rows: [(a, min(block_rows, rows - a)) for a in range(0, rows, block_rows)]
    if kind != "e57":
        return [Block(path, a, m, a, layout) for a, m in (cuts(n) if getattr(layout, "kind", "<") in "<>" else [(0, n)])]
    every, row = [], 0
    colour, intensity = (all(s.has(*c) for s in layout) for c in (("colorRed", "colorGreen", "colorBlue"), ("intensity",)))
    with open_file(path) as f:
        pages = e57.Pages(f)
        for k, scan in enumerate(layout):
            if not scan.has("cartesianX", "cartesianY", "cartesianZ"):
                raise ValueError(f"scan {k} of {path} has no cartesian coordinates: {sorted(f.name for f in scan.fields)}")
            found = e57.packets(pages, scan) if scan.n else None
            every += [Block(path, a, m, row + a, scan, colour, intensity, found.holding(scan, a, m)) for a, m in cuts(scan.n)]
            row += scan.n
    return every


def _e57_columns(block: Block, columns: list[str]) -> dict[str, np.ndarray]:
    scan, want = block.layout, []
    if set(columns) & set("xyz"):  # a turned point needs all three
        want += ["cartesianX", "cartesianY", "cartesianZ"]
    names = {"r": "colorRed", "g": "colorGreen", "b": "colorBlue"}
    want += [names[c] for c in "rgb" if c in columns and block.colour]
    want += ["intensity"] if "intensity" in columns and block.intensity else []
    want += ["cartesianInvalidState"] if scan.has("cartesianInvalidState") else []
    with open_file(block.path) as f:
        got = e57.records(e57.Pages(f), scan, block.held, block.first, block.n, want)
    out = {"row": np.arange(block.row, block.row + block.n)}
    if "cartesianX" in got:
        xyz = np.column_stack([got[f"cartesian{c}"].astype(float) for c in "XYZ"]) @ np.array(scan.rotation).T + np.array(scan.shift)
        out |= {c: xyz[:, k] for k, c in enumerate("xyz")}
    out |= {c: got[name] for c, name in names.items() if name in got} | {c: got[c] for c in ("intensity",) if c in got}
    if "cartesianInvalidState" in got:
        valid = got["cartesianInvalidState"] == 0
        out = {c: v[valid] for c, v in out.items()}
    return out


def columns_of(block: Block, columns: list[str]) -> dict[str, np.ndarray]:
    """``row`` (numbers in the file) and those of ``columns`` that the file has; raw colours, not brought to bytes."""
    if block.path.lower().endswith(".e57"):
        return _e57_columns(block, columns)
    with open_file(block.path) as f:
        if isinstance(block.layout, dict):
            h = block.layout
            f.seek(h["start"] + block.first * h["length"])
            out = formats.las_records(f.read(block.n * h["length"]), h | {"n": block.n})
        else:
            width = block.layout.dtype.itemsize
            f.seek(block.layout.start + (block.first * width if block.layout.kind in "<>" else 0))
            data = f.read(block.n * width) if block.layout.kind in "<>" else f.read()
            out = formats.as_points(formats.records(data, replace(block.layout, n=block.n, start=0)))
    return out | {"row": np.arange(block.row, block.row + block.n)}


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options["paths"])
        self.columns = options.get("columns", ",".join(COLUMNS)).split(",")
        self.block_rows = int(options.get("blockrows", BLOCK_ROWS))

    def partitions(self) -> list[Block]:
        return [b for path in self.paths for b in blocks_of(path, self.block_rows)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        got = columns_of(partition, self.columns)
        n, key = len(got["row"]), key_of(partition.path)
        for at in range(0, n, BATCH):
            size = min(BATCH, n - at)
            arrays = []
            for c in self.columns:
                if c == "pid":
                    arrays.append(pa.array(got["row"][at : at + size] + key))
                elif c == "source":
                    arrays.append(pa.array([partition.path] * size))
                elif c in got:
                    arrays.append(pa.array(got[c][at : at + size].astype(_KINDS[c].to_pandas_dtype())))
                else:
                    arrays.append(pa.nulls(size, _KINDS[c]))
            yield pa.record_batch(arrays, names=self.columns)


class PointBlocks(DataSource):
    """``spark.read.format("pointblocks")`` with the options paths (a JSON list of URIs), columns and blockRows."""

    @classmethod
    def name(cls) -> str:
        return "pointblocks"

    def schema(self) -> str:
        return ", ".join(f"{c} {_SQL[_KINDS[c]]}" for c in self.options.get("columns", ",".join(COLUMNS)).split(","))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
