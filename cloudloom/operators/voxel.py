"""Voxels and cells: keyed partial sums that merge in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import colour_mean, voxel_index, voxel_key
from .quantiles import quantiles

COLOURS = ("r", "g", "b")


def voxel_sums(points: DataFrame, size: float) -> DataFrame:
    """The mergeable state: key, n, sx, sy, sz and, where there are colours, sr, sg, sb and n_colour.

    A point outside 21 bits an axis raises an error.
    """
    key = F.coalesce(voxel_key(F.col("x"), F.col("y"), F.col("z"), size), F.raise_error(F.lit("a point lies outside the voxel range")).cast("long"))
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{c}") for c in "xyz")]
    if set(COLOURS) <= set(points.columns):
        sums += [*(F.sum(F.col(c).cast("long")).alias(f"s{c}") for c in COLOURS), F.count(F.when(F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_colour")]
    return points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).groupBy(key.alias("key")).agg(*sums)


def merge_sums(states: DataFrame) -> DataFrame:
    """One state out of several: sums add up."""
    return states.groupBy("key").agg(*(F.sum(c).alias(c) for c in states.columns if c != "key"))


def voxel_centroids(sums: DataFrame) -> DataFrame:
    """(rid, x, y, z, n[, r, g, b]) of a state; colours only if every point had one."""
    out = [F.col("key").alias("rid"), *((F.col(f"s{c}") / F.col("n")).alias(c) for c in "xyz"), "n"]
    if "n_colour" in sums.columns:
        out += [F.when(F.col("n_colour") == F.col("n"), colour_mean(F.col(f"s{c}"), F.col("n"))).alias(c) for c in COLOURS]
    return sums.select(*out)


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """A point a voxel: the mean of its points. Size 0 leaves the points as they are, with their pid as rid."""
    if size <= 0:
        return points.withColumnRenamed("pid", "rid").withColumn("n", F.lit(1).cast("long"))
    return voxel_centroids(voxel_sums(points, size))


def voxel_first(points: DataFrame, size: float, order: str = "pid") -> DataFrame:
    """The first point (by ``order``) of each voxel."""
    w = Window.partitionBy(*(voxel_index(F.col(c), size) for c in "xyz")).orderBy(order)
    return points.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def cells(points: DataFrame, size: float, by: list[str] | None = None) -> DataFrame:
    """(by..., i, j, n, mean_z, min_z, max_z) of the xy cells that hold points."""
    return points.groupBy(*(by or []), voxel_index(F.col("x"), size).alias("i"), voxel_index(F.col("y"), size).alias("j")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean_z"), F.min("z").alias("min_z"), F.max("z").alias("max_z")
    )


def covered_area(points: DataFrame, size: float, by: list[str]) -> DataFrame:
    """(by..., n_cells, area): different xy cells, exactly counted."""
    ij = F.struct(voxel_index(F.col("x"), size), voxel_index(F.col("y"), size))
    return points.groupBy(*by).agg(F.count_distinct(ij).alias("n_cells")).withColumn("area", F.col("n_cells") * F.lit(size * size))


def slice_coverage(points: DataFrame, size: float, slice_height: float = 0.25, least_points: int = 10, least_height: float = 1.5) -> DataFrame:
    """(i, j, n, height, coverage): the share of a cell's height whose slices hold points, for cells with enough points and height."""
    cut = points.groupBy(voxel_index(F.col("x"), size).alias("i"), voxel_index(F.col("y"), size).alias("j")).agg(
        F.count(F.lit(1)).alias("n"), (F.max("z") - F.min("z")).alias("height"), F.count_distinct(F.floor(F.col("z") / slice_height)).alias("slices")
    )
    full = F.greatest(F.ceil(F.col("height") / slice_height), F.lit(1))
    return cut.where((F.col("n") >= least_points) & (F.col("height") >= least_height)).select("i", "j", "n", "height", F.least(F.col("slices") / full, F.lit(1.0)).alias("coverage"))


def extent(points: DataFrame, percentiles: tuple[float, ...] = (0.02, 0.98), axis: str = "z") -> DataFrame:
    """One row: n, the bounds of each axis and exact interpolated percentiles of ``axis``."""
    bounds = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    cuts = F.broadcast(quantiles(points, [], axis, percentiles, "q_"))  # one row
    whole = points.agg(F.count(F.lit(1)).alias("n"), *bounds).join(cuts, F.lit(True), "left")
    return whole.select("n", *(f"{n}_{c}" for c in "xyz" for n in ("min", "max")), *(F.get("q_", F.lit(i)).alias(f"p{i}") for i in range(len(percentiles))))


def drop_outliers(points: DataFrame, radius: float, k: int = 16, std: float = 2.5, least: int = 100, pid: str = "pid") -> DataFrame:
    """Points whose mean distance to their ``k`` nearest (within ``radius``) is below the mean of all plus ``std`` deviations.

    Points with no neighbour there go; tables of at most ``least`` points are left as they are.
    """
    from .spatial import knn

    if points.limit(least + 1).count() <= least:
        return points
    mean = knn(points, k, radius, pid).groupBy("src").agg(F.avg(F.sqrt("d2")).alias("mean_d"))
    cut = mean.agg((F.avg("mean_d") + std * F.stddev_samp("mean_d")).alias("cut")).first().cut
    kept = mean.where(F.col("mean_d") < F.lit(cut)).select(F.col("src").alias(pid))
    return points.join(kept, pid, "left_semi")
