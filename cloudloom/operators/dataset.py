"""Training sets and scores: confidence, class weights, confusion, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import near


def confirmed(points: DataFrame, confirmed_points: DataFrame, radius: float = 0.05, pid: str = "pid") -> DataFrame:
    """``points`` with confidence 2 where a confirmed point lies within ``radius``."""
    hit = near(points, confirmed_points, radius, pid).withColumn("hit_", F.lit(True))
    return points.join(hit, pid, "left").withColumn("confidence", F.when(F.col("hit_"), 2).otherwise(F.col("confidence")).cast("smallint")).drop("hit_")


def class_weights(rows: DataFrame, classes: DataFrame, label: str = "label", confidence: str = "confidence") -> DataFrame:
    """(code, n, weight): inverse frequency among confident rows, with mean 1 over the classes that occur; others weigh 0."""
    counted = rows.where(F.col(confidence) >= 1).groupBy(F.col(label).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    every = classes.select("code").join(counted, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    inverse = F.when(F.col("n") > 0, 1.0 / F.col("n"))
    all_ = Window.partitionBy(F.lit(0))  # a row a class
    return every.withColumn("inv_", inverse).withColumn("weight", F.coalesce(F.col("inv_") / F.avg("inv_").over(all_), F.lit(0.0))).select("code", "n", "weight")


def confusion(rows: DataFrame, truth: str = "truth", predicted: str = "predicted", confidence: str | None = None) -> DataFrame:
    """(truth, predicted, n); with ``confidence`` only rows where that column is 1 or more."""
    rows = rows if confidence is None else rows.where(F.col(confidence) >= 1)
    return rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def intersection_over_union(matrix: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(code, hit, n_truth, n_predicted, iou) for the classes that occur in the truth."""
    t = matrix.groupBy(F.col(truth).alias("code")).agg(F.sum("n").alias("n_truth"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    p = matrix.groupBy(F.col(predicted).alias("code")).agg(F.sum("n").alias("n_predicted"))
    met = t.join(p, "code", "left").withColumn("n_predicted", F.coalesce("n_predicted", F.lit(0)))
    return met.select("code", "hit", "n_truth", "n_predicted", (F.col("hit") / (F.col("n_truth") + F.col("n_predicted") - F.col("hit"))).alias("iou"))


def mean_iou(matrix: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row, ``mean_iou``: over the classes that occur in the truth; null without any."""
    return intersection_over_union(matrix, truth, predicted).agg(F.avg("iou").alias("mean_iou"))


def split_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == 2).alias("n_confirmed"))


def class_counts(points: DataFrame, classes: DataFrame) -> DataFrame:
    """(code, key, n): a row for every class, those without points too."""
    counted = points.groupBy(F.col("label").cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return classes.select("code", "key").join(counted, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def augment(points: DataFrame, seed: int = 0, scale: float = 0.05, jitter: float = 0.005, block: str = "block") -> DataFrame:
    """``points`` turned about z, mirrored, scaled and jittered: one draw a block from its hash, one a point from its own."""
    unit = lambda salt, *c: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *c), F.lit(1 << 30)) / F.lit(float(1 << 30))
    a, s = unit(1, block) * 6.283185307179586, 1 - scale + 2 * scale * unit(2, block)
    m = F.when(unit(3, block) < 0.5, -1.0).otherwise(1.0)
    near = lambda salt: (unit(salt, "pid") - 0.5) * 2 * jitter
    x, y = F.col("x") * m, F.col("y")
    return points.withColumns({"x": (x * F.cos(a) - y * F.sin(a)) * s + near(4), "y": (x * F.sin(a) + y * F.cos(a)) * s + near(5), "z": F.col("z") * s + near(6)})
