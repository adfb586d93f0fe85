"""What a cluster looks like: sums that merge, then small algebra on one row a cluster.

Covariances are native aggregates; only the 3 x 3 eigenvalue problems run in Arrow
batches, on one row a cluster and never on points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import quantiles

AXES = "xyz"
SIX = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))
EIGEN = T.StructType([*(T.StructField(f"l{k}", T.DoubleType()) for k in (1, 2, 3)), *(T.StructField(f"e{k}", T.ArrayType(T.DoubleType())) for k in (1, 2, 3))])


def scatter_sums(points: DataFrame, by: list[str], columns: tuple[str, str, str] = ("x", "y", "z"), centred: bool = True) -> DataFrame:
    """(by..., n, mean of each column, m_ab): covariances, or with ``centred`` false mean products."""
    name = dict(zip(AXES, columns, strict=True))
    second = [(F.covar_pop(name[a], name[b]) if centred else F.avg(F.col(name[a]) * F.col(name[b]))).alias(f"m_{a}{b}") for a, b in SIX]
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(name[a]).alias(f"mean_{a}") for a in AXES), *second)


@F.pandas_udf(EIGEN)
def _eigen(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    m = np.nan_to_num(np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).astype(float).reshape(-1, 3, 3))
    w, v = np.linalg.eigh(m)
    w, v = np.clip(w[:, ::-1], 0, None), v[:, :, ::-1]
    top = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None, :], axis=1)
    v = v * np.where(top < 0, -1.0, 1.0)  # the largest part of each axis is positive, so an axis has one sign
    return pd.DataFrame({"l1": w[:, 0], "l2": w[:, 1], "l3": w[:, 2], **{f"e{k + 1}": list(np.ascontiguousarray(v[:, :, k])) for k in range(3)}})


def with_eigen(sums: DataFrame, name: str = "eigen") -> DataFrame:
    """``sums`` with eigenvalues (descending, not negative) and axes."""
    return sums.withColumn(name, _eigen(*(F.col(f"m_{a}{b}") for a, b in SIX)))


def shape_descriptors(eigen: DataFrame) -> DataFrame:
    """linearity, planarity, dispersion and the main axis's verticality."""
    l1 = F.greatest(F.col("eigen.l1"), F.lit(1e-12))
    return eigen.withColumns({
        "linearity": (F.col("eigen.l1") - F.col("eigen.l2")) / l1, "planarity": (F.col("eigen.l2") - F.col("eigen.l3")) / l1,
        "dispersion": F.col("eigen.l3") / l1, "verticality": F.abs(F.element_at("eigen.e1", 3)),
    })


def box_sides(points: DataFrame, eigen: DataFrame, by: list[str]) -> DataFrame:
    """(by..., dims): sides of the box along the main axes, longest first."""
    met = points.join(eigen.select(*by, "eigen"), by)
    along = [sum(((F.col(a) * F.element_at(f"eigen.e{k}", i + 1)) for i, a in enumerate(AXES)), F.lit(0.0)) for k in (1, 2, 3)]
    sides = [(F.max(t) - F.min(t)) for t in along]
    return met.groupBy(*by).agg(F.sort_array(F.array(*sides), asc=False).alias("dims"))


def heights(points: DataFrame, by: list[str], band: float = 0.15) -> DataFrame:
    """(by..., top, bottom, robust_z, band_share): robust_z is the 95th less the 5th percentile; band_share the larger share of points in a band at the top or the bottom."""
    ends = points.groupBy(*by).agg(F.max("z").alias("top"), F.min("z").alias("bottom")).join(quantiles(points, by, "z", (0.05, 0.95), "p_"), by)
    share = lambda c: F.avg(c.cast("double"))
    bands = points.join(ends, by).groupBy(*by).agg(F.greatest(share(F.col("z") >= F.col("top") - band), share(F.col("z") <= F.col("bottom") + band)).alias("band_share"))
    return ends.join(bands, by).select(*by, "top", "bottom", (F.element_at("p_", 2) - F.element_at("p_", 1)).alias("robust_z"), "band_share")


def shell_density(n, dims, voxel: float):
    """Points over the voxels that the box's shell would fill; sides are one voxel at least."""
    a, b, c = (F.greatest(F.element_at(dims, k), F.lit(voxel)) for k in (1, 2, 3))
    return n / F.greatest(2 * (a * b + b * c + a * c) / (voxel * voxel), F.lit(1.0))


def dominant_colour(points: DataFrame, by: list[str], distance: float = 40.0) -> DataFrame:
    """(by..., colour, uniformity): the median of each channel, and the share of points within ``distance`` of it. Points without a colour do not count. A channel has 256 values at most, which is all that a median holds."""
    seen = points.where(F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull())
    mid = seen.groupBy(*by).agg(*(F.median(c).alias(f"m_{c}") for c in "rgb"))
    d2 = sum(((F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) for c in "rgb"), F.lit(0.0))
    close = seen.join(mid, by).groupBy(*by).agg(F.avg((d2 <= distance * distance).cast("double")).alias("uniformity"))
    return mid.join(close, by).select(*by, F.array(*(F.bround(f"m_{c}").cast("smallint") for c in "rgb")).alias("colour"), "uniformity")


def local_normals(points: DataFrame, radius: float, most: int = 20, pid: str = "pid") -> DataFrame:
    """(pid, nx, ny, nz): the least axis of the ``most`` nearest points within ``radius``, the point itself with them; null under three points."""
    from .spatial import nearest_few

    pairs = nearest_few(points, points, most, radius, pid, list(AXES), own=True)
    near = pairs.select(F.col(f"a_{pid}").alias(pid), *(F.col(f"b_{c}").alias(c) for c in AXES))
    eigen = with_eigen(scatter_sums(near, [pid]))
    return eigen.select(pid, *(F.when(F.col("n") >= 3, F.element_at("eigen.e3", i + 1)).alias(f"n{c}") for i, c in enumerate(AXES)))


def patch_family(points: DataFrame, by: list[str], irregular: float = 0.10, cylindrical: float = 0.10, flat: float = 0.7, least: int = 5) -> DataFrame:
    """(by..., family): from the mean product of unit normals. none under ``least`` points, irregular, cylindrical, horizontal or vertical."""
    eigen = with_eigen(scatter_sums(points, by, ("nx", "ny", "nz"), centred=False))
    family = (
        F.when(F.col("n") < least, "none").when(F.col("eigen.l3") > irregular, "irregular").when(F.col("eigen.l2") >= cylindrical, "cylindrical")
        .when(F.abs(F.element_at("eigen.e1", 3)) >= flat, "horizontal").otherwise("vertical")
    )
    return eigen.select(*by, "n", family.alias("family"))


def cylinder_axis(points: DataFrame, by: list[str]) -> DataFrame:
    """(by..., axis): the direction that the normals avoid."""
    return with_eigen(scatter_sums(points, by, ("nx", "ny", "nz"), centred=False)).select(*by, F.col("eigen.e3").alias("axis"))


def normal_coherence(points: DataFrame, by: list[str], normal: list[float], least: float = 0.85) -> DataFrame:
    """(by..., coherence): the share of points whose normal is along ``normal``."""
    d = F.abs(sum((F.col(f"n{c}") * F.lit(float(v)) for c, v in zip(AXES, normal, strict=True)), F.lit(0.0)))
    return points.groupBy(*by).agg(F.avg((d > least).cast("double")).alias("coherence"))


def build_features(points: DataFrame, voxel: float, by: str = "cluster_id", ceiling: float | None = None, floor: float | None = None) -> DataFrame:
    """One row a cluster: all of the above, with distances to the ceiling and the floor where they are given, and the cylinder fit."""
    from .fits import fit_cylinders

    key = [by]
    eigen = shape_descriptors(with_eigen(scatter_sums(points, key)))
    out = eigen.join(box_sides(points, eigen, key), key).join(heights(points, key), key)
    if {"nx", "ny", "nz"} <= set(points.columns):
        out = out.join(fit_cylinders(points, by), key, "left")
    if {"r", "g", "b"} <= set(points.columns):
        out = out.join(dominant_colour(points, key), key, "left")
    out = out.withColumns({
        "density": shell_density(F.col("n"), F.col("dims"), voxel), "centre": F.array("mean_x", "mean_y", "mean_z"),
        "to_ceiling": F.lit(ceiling).cast("double") - F.col("top"), "to_floor": F.col("bottom") - F.lit(floor).cast("double"), "under_pipe": F.lit(False),
    })
    return out.drop(*(f"mean_{a}" for a in AXES), *(f"m_{a}{b}" for a, b in SIX))
