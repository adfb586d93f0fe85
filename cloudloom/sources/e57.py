"""The E57 format: checked pages, the header's XML, and compressed vectors in packets.

A file is pages of a payload and a CRC-32C; offsets in the XML are physical, what they
lead to is read as if the checksums were not there. A scan's points are a vector: packets
of at most 64 KB, each with a piece of every field's byte stream. Streams of floats are
plain, those of integers are bit-packed from the low bit, and a record may begin in one
packet and end in the next.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np

_NS = "{http://www.astm.org/COMMIT/E57/2010-e57-v1.0}"
_POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(_POLYNOMIAL), out >> 1)
    return out


def crc32c(rows: np.ndarray) -> np.ndarray:
    """The CRC-32C of each row of bytes, all rows a step together."""
    table, crc = _crc_table(), np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = table[(crc ^ column) & 0xFF] ^ crc >> 8
    return ~crc


class Pages:
    """The logical bytes of an open file; a page whose checksum is wrong is an error."""

    def __init__(self, file, check: bool = True) -> None:
        self.file, self.check, self.page = file, check, 1024
        head = self._raw(0, 48)
        if head[:8] != b"ASTM-E57":
            raise ValueError("not an E57 file")
        self.length, self.xml_at, self.xml_length, self.page = struct.unpack_from("<4Q", head, 16)

    def _raw(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def logical(self, physical: int) -> int:
        return physical - 4 * (physical // self.page)

    def read(self, at: int, n: int) -> bytes:
        """``n`` bytes from the logical offset ``at``."""
        if n <= 0:
            return b""
        own = self.page - 4
        first, last = at // own, (at + n - 1) // own
        raw = self._raw(first * self.page, (last - first + 1) * self.page)
        if len(raw) < (last - first + 1) * self.page:
            raise ValueError("an E57 file ends within a page")
        rows = np.frombuffer(raw, np.uint8).reshape(-1, self.page)
        if self.check and (crc32c(rows[:, :own]) != rows[:, own:].copy().view(">u4")[:, 0]).any():
            raise ValueError("the checksum of an E57 page is wrong")
        return rows[:, :own].tobytes()[at - first * own : at - first * own + n]


@dataclass(frozen=True)
class Field:
    """``bits`` of an integer in the stream; a float has the width of its type and ``kind`` f4 or f8."""

    name: str
    kind: str
    bits: int
    low: int = 0
    high: int = 0
    scale: float = 1.0
    offset: float = 0.0

    def values(self, data: bytes, first_bit: int, n: int) -> np.ndarray:
        """``n`` values from bit ``first_bit`` of ``data`` on."""
        if self.kind in ("f4", "f8"):
            return np.frombuffer(data, "<" + self.kind, n, first_bit // 8)
        if not self.bits:
            whole = np.full(n, self.low, np.int64)
        else:
            raw = np.frombuffer(data + bytes(10), np.uint8)
            at = first_bit + np.arange(n, dtype=np.int64) * self.bits
            byte, shift = at >> 3, (at & 7).astype(np.uint64)
            out = np.zeros(n, np.uint64)
            for k in range(min(8, (self.bits + 14) // 8)):
                out |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
            out >>= shift
            if self.bits > 57:  # a value of that many bits may reach into a ninth byte
                ninth = raw[byte + 8].astype(np.uint64)
                out |= np.where(shift > 0, ninth << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
            if self.bits < 64:
                out &= np.uint64((1 << self.bits) - 1)
            whole = out.view(np.int64) + np.int64(self.low)
        return whole * self.scale + self.offset if self.kind == "scaled" else whole


@dataclass(frozen=True)
class Scan:
    fields: tuple[Field, ...]
    n: int
    at: int  # physical offset of the vector's section
    rotation: tuple[tuple[float, ...], ...]
    shift: tuple[float, ...]

    def index(self, name: str) -> int | None:
        return next((i for i, f in enumerate(self.fields) if f.name == name), None)

    def has(self, *names: str) -> bool:
        return all(self.index(c) is not None for c in names)


def _field(node: ET.Element) -> Field:
    name, kind = node.tag.removeprefix(_NS), node.get("type")
    if kind == "Float":
        size = 4 if node.get("precision") == "single" else 8
        return Field(name, f"f{size}", 8 * size)
    if kind not in ("Integer", "ScaledInteger"):
        raise ValueError(f"a point field of type {kind} is not supported")
    low, high = int(node.get("minimum", -(1 << 63))), int(node.get("maximum", (1 << 63) - 1))
    if kind == "Integer":
        return Field(name, "integer", (high - low).bit_length(), low, high)
    return Field(name, "scaled", (high - low).bit_length(), low, high, float(node.get("scale", 1)), float(node.get("offset", 0)))


def _rigid(node: ET.Element) -> tuple[tuple[tuple[float, ...], ...], tuple[float, ...]]:
    part = lambda path, default: float((node.findtext("/".join(_NS + p for p in path.split("/"))) or "").strip() or default)
    w, x, y, z = (part(f"pose/rotation/{c}", c == "w") for c in "wxyz")
    size = (w * w + x * x + y * y + z * z) ** 0.5 or 1.0
    w, x, y, z = w / size, x / size, y / size, z / size
    rotation = (
        (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )
    return rotation, tuple(part(f"pose/translation/{c}", 0) for c in "xyz")


def scans(pages: Pages) -> list[Scan]:
    """The scans of a file, in its order."""
    root = ET.fromstring(pages.read(pages.logical(pages.xml_at), pages.xml_length))
    out = []
    for node in root.iterfind(f"{_NS}data3D/{_NS}vectorChild"):
        points = node.find(_NS + "points")
        fields = tuple(_field(f) for f in points.find(_NS + "prototype"))
        out.append(Scan(fields, int(points.get("recordCount")), int(points.get("fileOffset")), *_rigid(node)))
    return out


@dataclass(frozen=True)
class Packets:
    """Logical offsets of a scan's data packets, and ``begin[k, s]``: the bytes of stream s before packet k (a row more than packets)."""

    at: np.ndarray
    begin: np.ndarray

    def holding(self, scan: Scan, first: int, n: int) -> Packets:
        """The packets that the records ``first`` to ``first + n`` need."""
        bits = np.array([f.bits for f in scan.fields], np.int64)
        low, high = first * bits // 8, -(-(first + n) * bits // 8)
        need = (self.begin[:-1] < high) & (self.begin[1:] > low)
        which = np.flatnonzero(need.any(axis=1))
        if not len(which):
            return Packets(self.at[:0], self.begin[:1])
        a, b = which[0], which[-1] + 1
        return Packets(self.at[a:b], self.begin[a : b + 1])


def packets(pages: Pages, scan: Scan) -> Packets:
    """Found by the packets' headers alone: a few bytes of each 64 KB."""
    start = pages.logical(scan.at)
    kind, length, data = struct.unpack_from("<B7xQQ", pages.read(start, 24))
    if kind != 1:
        raise ValueError("not a compressed vector")
    at, end, where, sizes, streams = pages.logical(data), start + length, [], [], len(scan.fields)
    while at < end:
        head = pages.read(at, 4)
        size = struct.unpack_from("<H", head, 2)[0] + 1
        if head[0] == 1:
            held = pages.read(at, 6 + 2 * streams)
            if struct.unpack_from("<H", held, 4)[0] != streams:
                raise ValueError("a packet's streams do not match the scan's fields")
            where.append(at)
            sizes.append(struct.unpack_from(f"<{streams}H", held, 6))
        at += size
    begin = np.concatenate([np.zeros((1, streams), np.int64), np.cumsum(np.array(sizes, np.int64).reshape(-1, streams), axis=0)])
    for f, held in zip(scan.fields, begin[-1], strict=True):
        if held * 8 < f.bits * scan.n:
            raise ValueError(f"the stream of {f.name} ends before its last record")
    return Packets(np.array(where, np.int64), begin)


def records(pages: Pages, scan: Scan, held: Packets, first: int, n: int, names: list[str]) -> dict[str, np.ndarray]:
    """The fields ``names`` of ``n`` records from ``first`` on; each packet of ``held`` is read once."""
    which, streams = [scan.index(c) for c in names], len(scan.fields)
    pieces: list[list[bytes]] = [[] for _ in names]
    sizes = np.diff(held.begin, axis=0)
    for at, size in zip(held.at.tolist(), sizes, strict=True):
        begin = 6 + 2 * streams + np.concatenate([[0], np.cumsum(size)])
        data = pages.read(at, int(begin[-1]))
        for out, s in zip(pieces, which, strict=True):
            out.append(data[begin[s] : begin[s + 1]])
    out = {}
    for name, s, parts in zip(names, which, pieces, strict=True):
        f = scan.fields[s]
        out[name] = f.values(b"".join(parts), first * f.bits - 8 * int(held.begin[0, s]), n)
    return out
