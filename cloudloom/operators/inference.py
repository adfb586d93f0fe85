"""A point model over blocks: points are dealt to blocks of one size by a seeded permutation.

The permutation is the order of a hash, made by ranges: a task numbers its own range, and
what stands before a range is a count a task. So blocks are exactly full (but the last),
the same whatever the partitions, and no task sees more than a range or a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import boxes_overlap
from .tables import stored

# Points of a block, and what its size is brought to a multiple of.
BLOCK_POINTS, MULTIPLE = 65_536, 256


def permuted_blocks(points: DataFrame, block_points: int = BLOCK_POINTS, seed: int = 0, pid: str = "pid") -> DataFrame:
    """``points`` with ``block`` and ``place`` (in the block, from 0), by the order of a seeded hash of ``pid``, ties by ``pid``."""
    order = (F.xxhash64(F.lit(seed), pid), F.col(pid))
    ranged = points.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranged.withColumn("at_", F.monotonically_increasing_id()), "ranges")  # the task above, the row in it below
    part = rows.withColumn("task_", F.shiftright("at_", 33))
    counts = part.groupBy("task_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    rank = F.col("before_") + F.col("at_").bitwiseAND((1 << 33) - 1)
    out = part.join(F.broadcast(counts.select("task_", before.alias("before_"))), "task_")
    return out.withColumns({"block": F.floor(rank / block_points), "place": rank % block_points}).drop("task_", "at_", "before_")


def infer(points: DataFrame, model: Callable[[np.ndarray], np.ndarray], block_points: int = BLOCK_POINTS, multiple: int = MULTIPLE, seed: int = 0) -> DataFrame:
    """(pid, dl_label): what ``model`` says of each point, a block a call.

    ``model`` takes the coordinates of a block about their mean, a multiple of ``multiple``
    in number (points drawn again fill up), and gives a class code each. It is sent to the
    tasks, so it loads its weights there. Every point is labelled once.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", ignore_index=True)
        n = len(pdf)
        extra = np.random.default_rng(seed).integers(0, n, -n % multiple)
        xyz = pdf[["x", "y", "z"]].to_numpy(float)[np.concatenate([np.arange(n), extra])]
        got = np.asarray(model(xyz - xyz.mean(axis=0)))
        if got.shape != (len(xyz),):
            raise ValueError(f"the model gave {got.shape} labels for {len(xyz)} points")
        return pd.DataFrame({"pid": pdf["pid"], "dl_label": got[:n].astype(np.int16)})

    blocks = permuted_blocks(points.select("pid", "x", "y", "z"), block_points, seed)
    return blocks.groupBy("block").applyInPandas(run, "pid long, dl_label smallint")


def local_context(points: DataFrame, instances: DataFrame, by: str = "instance_id", margin: float = 1.5, most: int = 150_000, cell: float = 8.0, seed: int = 0) -> DataFrame:
    """(by, pid, x, y, z): the points within ``margin`` of each instance's box, ``most`` of them by a seeded hash where there are more.

    ``instances`` has ``by`` and a box x0 to z1.
    """
    dots = points.select("pid", "z", *(F.col(c).alias(f"{c}{e}") for c in "xy" for e in (0, 1)))
    met = boxes_overlap(dots, instances.select(by, "x0", "x1", "y0", "y1", "z0", "z1"), cell, margin)
    met = met.where(F.col("a_z").between(F.col("b_z0") - margin, F.col("b_z1") + margin))
    order = Window.partitionBy(f"b_{by}").orderBy(F.xxhash64(F.lit(seed), "a_pid"), "a_pid")
    kept = met.withColumn("nth_", F.row_number().over(order)).where(F.col("nth_") <= most)
    return kept.select(F.col(f"b_{by}").alias(by), F.col("a_pid").alias("pid"), F.col("a_x0").alias("x"), F.col("a_y0").alias("y"), F.col("a_z").alias("z"))
