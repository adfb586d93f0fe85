"""Operators on an order: gaps, levels, slices, first and last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def gap_islands(rows: DataFrame, by: list[str], value: str, gap: float, name: str = "island") -> DataFrame:
    """``rows`` numbered from 0 within ``by``: a new number where ``value`` is more than ``gap`` above the row before it."""
    order = Window.partitionBy(*by).orderBy(value)
    jump = (F.col(value) - F.lag(value).over(order)) > gap
    return rows.withColumn("jump_", F.coalesce(jump.cast("int"), F.lit(0))).withColumn(name, F.sum("jump_").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("jump_")


def levels(heights: DataFrame, by: list[str], value: str = "z", gap: float = 0.5) -> DataFrame:
    """(by..., level, low, high, n, cut): runs of heights without a gap, with the middle of the gap above (null above the last)."""
    runs = gap_islands(heights, by, value, gap, "level").groupBy(*by, "level").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))
    above = F.lead("low").over(Window.partitionBy(*by).orderBy("level"))
    return runs.withColumn("cut", (F.col("high") + above) / 2)


def kept_levels(heights: DataFrame, by: list[str], value: str, gap: float) -> DataFrame:
    """(by..., kept): ascending heights, each more than ``gap`` above the one kept before it. A group's heights must be few (levels of a building)."""
    fold = F.aggregate(
        F.array_sort(F.collect_set(value)), F.array().cast("array<double>"),
        lambda kept, v: F.when((F.size(kept) == 0) | (v - F.element_at(kept, -1) > gap), F.concat(kept, F.array(v))).otherwise(kept),
    )
    return heights.groupBy(*by).agg(fold.alias("kept"))


def level_of(value, floors: list[float], above: float = 0.15):
    """How many floors, raised by ``above``, lie strictly below ``value``."""
    return F.size(F.filter(F.array(*(F.lit(f + above) for f in floors)).cast("array<double>"), lambda f: f < value))


def end_slices(points: DataFrame, by: list[str], along: str, thickness: float = 0.2) -> DataFrame:
    """Points in the first and the last ``thickness`` of their group, with ``at_start`` and ``at_end``."""
    w = Window.partitionBy(*by)
    out = points.withColumns({"at_start": F.col(along) <= F.min(along).over(w) + thickness, "at_end": F.col(along) >= F.max(along).over(w) - thickness})
    return out.where("at_start or at_end")


def strided(points: DataFrame, by: list[str], order: str, most: int = 25) -> DataFrame:
    """Every (n div most)-th point of each group, the first with them."""
    w = Window.partitionBy(*by)
    step = F.greatest(F.floor(F.count(F.lit(1)).over(w) / most), F.lit(1))
    rank = F.row_number().over(w.orderBy(order)) - 1
    return points.withColumns({"step_": step, "rank_": rank}).where("rank_ % step_ = 0").drop("step_", "rank_")


def segments_by_gaps(points: DataFrame, by: list[str], along: str, bin_size: float = 0.05, empty: int = 3, least_segments: int = 3, least_points: int = 10) -> DataFrame:
    """``points`` with ``segment`` where an axis falls into at least ``least_segments`` runs with enough points; null where a group is not split or a run is too small.

    A run ends after ``empty`` empty bins.
    """
    binned = points.withColumn("bin_", F.floor(F.col(along) / bin_size))
    per_bin = binned.groupBy(*by, "bin_").agg(F.count(F.lit(1)).alias("n_"))
    order = Window.partitionBy(*by).orderBy("bin_")
    new = F.coalesce(((F.col("bin_") - F.lag("bin_").over(order)) > empty).cast("int"), F.lit(0))
    runs = per_bin.withColumn("new_", new).withColumn("run_", F.sum("new_").over(order))
    size = Window.partitionBy(*by, "run_")
    runs = runs.withColumn("points_", F.sum("n_").over(size)).withColumn("good_", F.col("points_") >= least_points)
    # runs that are large enough, each counted where it begins
    order_runs = Window.partitionBy(*by)
    first = F.row_number().over(size.orderBy("bin_")) == 1
    runs = runs.withColumn("first_", first).withColumn("good_runs_", F.sum(F.when(F.col("first_") & F.col("good_"), 1).otherwise(0)).over(order_runs))
    segment = F.when(F.col("good_") & (F.col("good_runs_") >= least_segments), F.col("run_"))
    return binned.join(runs.select(*by, "bin_", segment.alias("segment")), [*by, "bin_"]).drop("bin_")


def split_by_quantile(points: DataFrame, axis: str = "y", held_out: float = 0.3) -> DataFrame:
    """``points`` with ``split``: val above the (1 - held_out) quantile of ``axis``, else train."""
    got = quantiles(points, [], axis, (1 - held_out,)).first()
    cut = got.q[0] if got else None
    return points.withColumn("split", F.when(F.col(axis) > F.lit(cut), "val").otherwise("train"))


def hash_sample(points: DataFrame, n: int, pid: str = "pid", seed: int = 0) -> DataFrame:
    """``n`` rows by the order of a seeded hash: the same rows whatever the partitions."""
    return points.orderBy(F.xxhash64(F.lit(seed), pid), pid).limit(n)


def block_around(points: DataFrame, seed: tuple[float, float, float], n: int, pid: str = "pid") -> DataFrame:
    """The ``n`` points nearest to a seed, with ``d2``."""
    d2 = sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip("xyz", seed, strict=True)), F.lit(0.0))
    return points.withColumn("d2", d2).orderBy("d2", pid).limit(n)
