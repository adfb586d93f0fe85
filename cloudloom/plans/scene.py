"""A synthetic room with known contents: planes, pipes, ducts, lights, columns, equipment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SIZE = (12.0, 8.0, 3.5)


def _plane(draw, origin, u, v, step):
    n = int(np.linalg.norm(u) * np.linalg.norm(v) / step**2)
    return np.asarray(origin) + draw.random((n, 1)) * np.asarray(u) + draw.random((n, 1)) * np.asarray(v)


def _tube(draw, start, along, radius, step):
    along = np.asarray(along, float)
    length = np.linalg.norm(along)
    axis = along / length
    u = np.cross(axis, np.eye(3)[np.abs(axis).argmin()])
    u /= np.linalg.norm(u)
    n = int(2 * np.pi * radius * length / step**2)
    a = draw.random((n, 1)) * 2 * np.pi
    return np.asarray(start) + draw.random((n, 1)) * along + radius * (np.cos(a) * u + np.sin(a) * np.cross(axis, u))


def _box(draw, centre, sides, step):
    c, s = np.asarray(centre), np.asarray(sides)
    out = []
    for k in range(3):
        for sign in (-0.5, 0.5):
            o = c - s / 2
            o[k] = c[k] + sign * s[k]
            u, v = (np.eye(3)[m] * s[m] for m in range(3) if m != k)
            out.append(_plane(draw, o, u, v, step))
    return np.concatenate(out)


def room(seed: int = 42, structure_step: float = 0.05, object_step: float = 0.025, sigma: float = 0.003) -> pd.DataFrame:
    """pid, x, y, z, truth (a class code) of the room."""
    draw = np.random.default_rng(seed)
    w, d, h = SIZE
    s, o = structure_step, object_step
    parts = [
        (11, _plane(draw, (0, 0, 0), (w, 0, 0), (0, d, 0), s)), (12, _plane(draw, (0, 0, h), (w, 0, 0), (0, d, 0), s)),
        *((13, _plane(draw, p, u, (0, 0, h), s)) for p, u in (((0, 0, 0), (w, 0, 0)), ((0, d, 0), (w, 0, 0)), ((0, 0, 0), (0, d, 0)), ((w, 0, 0), (0, d, 0)))),
        (1, _tube(draw, (1, 2, 2.7), (9, 0, 0), 0.30, o)), (2, _box(draw, (6, 6, 2.8), (8, 0.6, 0.4), o)),
        *((3, _tube(draw, (1, y, 2.4), (10, 0, 0), r, o)) for y, r in ((3.4, 0.05), (3.9, 0.04), (4.4, 0.06))),
        *((5, _box(draw, (x, 5.0, h - 0.08), (1.2, 0.3, 0.06), o)) for x in (2, 5, 8, 11)), *((7, _box(draw, (x, 1.0, h - 0.08), (0.6, 0.6, 0.06), o)) for x in (3, 7)),
        *((14, _box(draw, (x, 7.0, h / 2), (0.4, 0.4, h), o)) for x in (3, 9)), (8, _box(draw, (10, 4, 0.6), (1.2, 0.8, 1.2), o)),
    ]
    xyz = np.concatenate([p for _, p in parts]) + draw.normal(0, sigma, (sum(len(p) for _, p in parts), 3))
    truth = np.concatenate([np.full(len(p), c) for c, p in parts])
    return pd.DataFrame({"pid": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "truth": truth.astype(int)})


def room_points(spark: SparkSession, **kw) -> DataFrame:
    return spark.createDataFrame(room(**kw))
