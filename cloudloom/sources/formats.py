"""Byte layouts of PLY, PCD and LAS 1.4: headers, records, and nothing of Spark."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


@dataclass(frozen=True)
class Layout:
    """Where the records of a file are: ``kind`` is ``<`` or ``>`` for binary, else ascii."""

    kind: str
    fields: tuple[tuple[str, str], ...]
    n: int
    start: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(name, (self.kind if self.kind in "<>" else "<") + t) for name, t in self.fields])


def ply_layout(data: bytes) -> Layout:
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    start = data.index(b"\n", end) + 1
    kind, n, fields, inside = "ascii", 0, [], False
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(w[1], "ascii")
        elif w[:1] == ["element"]:
            inside = w[1] == "vertex"
            n = int(w[2]) if inside else n
        elif w[:1] == ["property"] and inside:
            if w[1] == "list":
                raise ValueError("a vertex with a list is not supported")
            fields.append((w[2], _PLY[w[1]]))
    return Layout(kind, tuple(fields), n, start)


def pcd_layout(data: bytes) -> Layout:
    head: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in head:
        end = data.index(b"\n", at)
        w = data[at:end].decode("ascii", "replace").split()
        if w and not w[0].startswith("#"):
            head[w[0]] = w[1:]
        at = end + 1
    kinds = [{"F": "f", "U": "u", "I": "i"}[t] + s for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
    if any(c != "1" for c in head.get("COUNT", [])):
        raise ValueError("PCD fields of several values are not supported")
    if head["DATA"][0] not in ("ascii", "binary"):
        raise ValueError("compressed PCD is not supported")
    return Layout("<" if head["DATA"][0] == "binary" else "ascii", tuple(zip(head["FIELDS"], kinds, strict=True)), int(head["POINTS"][0]), at)


def records(data: bytes, layout: Layout) -> np.ndarray:
    if layout.kind in "<>":
        return np.frombuffer(data, layout.dtype, layout.n, layout.start)
    rows = np.loadtxt(data[layout.start :].decode("ascii").splitlines()[: layout.n], ndmin=2) if layout.n else np.zeros((0, len(layout.fields)))
    return np.rec.fromarrays(list(rows.T), dtype=layout.dtype) if len(rows) else np.zeros(0, layout.dtype)


def as_points(rec: np.ndarray) -> dict[str, np.ndarray]:
    """x, y, z and, where there are any, r, g, b (bytes), intensity and classe."""
    names = rec.dtype.names or ()
    out = {c: rec[c].astype(float) for c in "xyz"}
    for c, name in zip("rgb", ("red", "green", "blue"), strict=True):
        for known in (name, c):
            if known in names:
                v = rec[known]
                out[c] = np.rint(v * 255).astype(np.int16) if v.dtype.kind == "f" else v.astype(np.int16)
                break
    if "rgb" in names and "r" not in out:
        packed = np.ascontiguousarray(rec["rgb"]).view("<u4").astype(np.int64)
        out |= {"r": (packed >> 16 & 255).astype(np.int16), "g": (packed >> 8 & 255).astype(np.int16), "b": (packed & 255).astype(np.int16)}
    for c in ("intensity", "classe", "label"):
        if c in names:
            out[c] = rec[c]
    return out


# The record of a classified PLY, 16 bytes little-endian.
CLASSIFIED = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1"), ("classe", "u1")])


def classified_ply(x, y, z, r, g, b, classe) -> bytes:
    rec = np.zeros(len(x), CLASSIFIED)
    for name, v in zip(CLASSIFIED.names, (x, y, z, r, g, b, classe), strict=True):
        rec[name] = v
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(rec)}", "property float x", "property float y", "property float z"]
    head += [f"property uchar {c}" for c in ("red", "green", "blue", "classe")] + ["end_header", ""]
    return "\n".join(head).encode() + rec.tobytes()


# LAS 1.4: the parts of the public header that matter here, and the 36-byte record of point format 7.
_LAS7 = np.dtype([("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("gps", "<f8"), ("red", "<u2"), ("green", "<u2"), ("blue", "<u2")])
_BEFORE_COLOUR = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}


def las_header(data: bytes) -> dict:
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = data[24], data[25]
    start, _, fmt, length, old_n = struct.unpack_from("<IIBHI", data, 96)
    n = struct.unpack_from("<Q", data, 247)[0] if (major, minor) >= (1, 4) else old_n
    if fmt & 0x80:
        raise ValueError("compressed LAS (LAZ) needs a codec that is not installed")
    scale, offset = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    return {"start": start, "format": fmt, "length": length, "n": n, "scale": scale, "offset": offset}


def las_records(data: bytes, h: dict) -> dict[str, np.ndarray]:
    """x, y, z in units, intensity, classe and, where the format has it, colour as it stands, of ``h["n"]`` records."""
    raw = np.frombuffer(data, np.uint8, h["n"] * h["length"]).reshape(h["n"], h["length"])
    at = lambda a, b, t: np.ascontiguousarray(raw[:, a:b]).view(t).reshape(h["n"], -1)
    xyz = at(0, 12, "<i4") * np.array(h["scale"]) + np.array(h["offset"])
    out = {c: xyz[:, k] for k, c in enumerate("xyz")} | {"intensity": at(12, 14, "<u2")[:, 0].astype(np.float32)}
    out["classe"] = (raw[:, 16] if h["format"] >= 6 else raw[:, 15] & 31).astype(np.int16)
    if h["format"] in _BEFORE_COLOUR:
        k = _BEFORE_COLOUR[h["format"]]
        out |= {c: at(k + 2 * i, k + 2 * i + 2, "<u2")[:, 0] for i, c in enumerate("rgb")}
    return out


def las_file(x, y, z, r, g, b, classe, scale: float = 0.001) -> bytes:
    """A LAS 1.4 file of point format 7: offsets at the least coordinates, colour times 257."""
    n = len(x)
    xyz = np.stack([np.asarray(v, float) for v in (x, y, z)], axis=1) if n else np.zeros((0, 3))
    low = xyz.min(axis=0) if n else np.zeros(3)
    high = xyz.max(axis=0) if n else np.zeros(3)
    rec = np.zeros(n, _LAS7)
    for k, name in enumerate("XYZ"):
        rec[name] = np.rint((xyz[:, k] - low[k]) / scale)
    rec["returns"], rec["classification"] = 0x11, classe
    for name, v in zip(("red", "green", "blue"), (r, g, b), strict=True):
        rec[name] = np.asarray(v, np.int64) * 257
    head = bytearray(375)
    head[:4] = b"LASF"
    head[24:26] = bytes((1, 4))
    struct.pack_into("<HII", head, 94, 375, 375, 0)
    struct.pack_into("<BH", head, 104, 7, 36)
    struct.pack_into("<6d", head, 131, scale, scale, scale, *low)
    struct.pack_into("<6d", head, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    struct.pack_into("<Q", head, 247, n)
    return bytes(head) + rec.tobytes()
