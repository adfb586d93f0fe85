"""The voxel accumulator as a stream, and labelled export of blocks as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spatial, voxel
from ..operators.tables import qualified

MANY_POINTS = 20_000_000


def use_stream(declared_points: int, most: int = MANY_POINTS) -> bool:
    """Whether a cloud is read in blocks."""
    return declared_points > most


def stream_settings(size: float, eps: float) -> dict[str, float]:
    """What later stages take over from a streamed reduction: no second voxel, and eps of 2.5 voxels at least."""
    return {"voxel": 0.0, "voxel_streaming": size, "eps": max(eps, 2.5 * size)}


def voxel_stream(blocks: DataFrame, size: float) -> DataFrame:
    """A streaming state of sums by voxel: write it in complete or update mode; :func:`voxel.voxel_centroids` finishes it."""
    return voxel.voxel_sums(blocks, size)


def colour_flags(blocks: DataFrame, by: str, block: str = "block", box: tuple[float, ...] | None = None) -> DataFrame:
    """(by, first_colour, all_colour): a state that merges, in whatever order blocks come, on batches and streams.

    A cloud's first block (the least ``block``) fixes whether it has colour; a later block
    without, of which a point lies in ``box``, takes it away. ``r`` null is no colour.
    """
    has = F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
    inside = spatial.inside(box) if box else F.lit(True)
    return blocks.groupBy(by).agg(F.min_by(has, F.struct(F.col(block), has)).alias("first_colour"), F.coalesce(F.bool_and(F.when(inside, has)), F.lit(True)).alias("all_colour"))


def coloured_centroids(sums: DataFrame, flags: DataFrame) -> DataFrame:
    """:func:`voxel.voxel_centroids` of one cloud's state, with colours only if its ``flags`` (one row) allow them."""
    ok = F.broadcast(flags.select((F.col("first_colour") & F.col("all_colour")).alias("ok_")))
    out = voxel.voxel_centroids(sums).join(ok, F.lit(True), "left")  # one row
    return out.withColumns({c: F.when(F.col("ok_"), F.col(c)) for c in voxel.COLOURS}).drop("ok_")


def export_stream(blocks: DataFrame, reduced: DataFrame, folder: str, checkpoint: str, first_radius: float, box: tuple[float, ...] | None = None, kind: str = "parquet"):
    """Each block's points take the nearest reduced point's label and go to ``folder``; a block that comes again replaces itself.

    ``kind`` parquet is split by macro group; ply and las give files of all points and of
    each group, in one pass, with their classes' colours. Returns the started query.
    """
    from ..sources import classified, writers

    spark = reduced.sparkSession

    def one(batch: DataFrame, epoch: int) -> None:
        part = spatial.crop(batch, box) if box else batch
        labels = spatial.propagate_labels(part, reduced, first_radius).select("pid", "label")
        out = part.join(labels, "pid")
        if kind != "parquet":
            classified.save(writers._dressed(out), qualified(spark, folder), kind, f"epoch{epoch:08d}", "both")
            return
        out = writers.with_group(out).withColumn("epoch", F.lit(epoch))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("macro_group", "epoch").parquet(folder)

    return blocks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
