"""The sink of classified files: one pass, all or nothing; streamed export in every format; colour over a stream."""

import glob

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import voxel
from cloudloom.sources import classified, readers, writers
from cloudloom.streaming import accumulator


def points_of(spark, n=600):
    draw = np.random.default_rng(5)
    return spark.createDataFrame(pd.DataFrame({"pid": range(n), **{c: draw.random(n) for c in "xyz"}, "label": draw.choice([1, 9, 13, 16], n).astype("int16")}))


def files_in(folder):
    return sorted(f.removeprefix(str(folder)) for f in glob.glob(f"{folder}/**/*", recursive=True, include_hidden=True) if f.rpartition(".")[2] in ("ply", "las") or "writing" in f)


def test_one_pass_writes_the_whole_and_the_groups(spark, tmp_path):
    points = points_of(spark).repartition(3)
    got = writers.write_grouped(points, f"file://{tmp_path}/a", "las", whole=True)
    assert list(got) == ["strutturale", "mep", "scarto"] and not [f for f in files_in(tmp_path) if "writing" in f]
    assert readers.count_points(spark, f"file://{tmp_path}/a/*.las") == 600
    want = {r.label: r["count"] for r in points.groupBy("label").count().collect()}
    for group, labels in (("strutturale", (13,)), ("mep", (1, 9)), ("scarto", (16,))):
        back = {r.label: r["count"] for r in readers.read_classified(spark, f"{got[group]}/*.las").groupBy("label").count().collect()}
        assert back == {k: want[k] for k in labels}
    listed = writers.write_classified(points, f"file://{tmp_path}/b", "ply", file_rows=50)
    assert listed.agg(F.sum("n")).first()[0] == 600 and listed.count() == len(files_in(tmp_path / "b"))
    with pytest.raises(ValueError):
        writers.write_classified(points, f"file://{tmp_path}/b", "obj")


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    points = points_of(spark).repartition(4)
    broken = points.withColumn("x", F.when(F.col("pid") == 599, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        writers.write_classified(broken, f"file://{tmp_path}/a", "ply", file_rows=10)
    assert files_in(tmp_path) == []
    rows = writers._dressed(points)
    for turn in range(2):  # a job that comes again replaces its own files, and leaves others
        classified.save(rows, f"file://{tmp_path}/b", "ply", "one", "both")
        classified.save(rows.where("label = 1"), f"file://{tmp_path}/b", "ply", "two")
    assert readers.count_points(spark, f"file://{tmp_path}/b/*.ply") == 600 + rows.where("label = 1").count()
    classified.save(rows.where("label = 9"), f"file://{tmp_path}/b", "ply", "three", overwrite=True)
    assert readers.count_points(spark, f"file://{tmp_path}/b/*.ply") == rows.where("label = 9").count()


def test_streamed_export_as_las(spark, tmp_path):
    rows = points_of(spark, 300).drop("label")
    for k in range(3):
        rows.where(F.col("pid") % 3 == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    reduced = voxel.voxel_downsample(rows, 0.25).withColumnRenamed("rid", "pid").withColumn("label", F.when(F.col("x") < 0.5, 1).otherwise(16).cast("smallint"))
    blocks = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    accumulator.export_stream(blocks, reduced, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", 0.25, kind="las").awaitTermination(180)
    assert readers.count_points(spark, f"file://{tmp_path}/out/*.las") == 300
    assert sum(readers.count_points(spark, f"file://{tmp_path}/out/{g}/*.las") for g in ("mep", "scarto")) == 300


@pytest.mark.parametrize("case", ["all", "late", "first", "outside"])
def test_a_late_block_without_colour(spark, tmp_path, case):
    """A stream gives what a batch gives: colours stay only if the first block and every later one with points in the box have them."""
    draw = np.random.default_rng(6)
    n = 90
    rows = pd.DataFrame({"pid": range(n), "cloud": "a", "block": np.arange(n) // 30, **{c: draw.random(n) for c in "xyz"}, **{c: draw.integers(0, 256, n).astype("int16") for c in "rgb"}})
    without = {"all": -1, "late": 2, "first": 0, "outside": 1}[case]
    if case == "outside":
        rows.loc[rows["block"] == 1, "x"] += 50
    rows[["r", "g", "b"]] = rows[["r", "g", "b"]].astype(object).where(rows["block"] != without, None)
    table = spark.createDataFrame(rows.astype(object).where(rows.notna(), None).values.tolist(), "pid long, cloud string, block long, x double, y double, z double, r smallint, g smallint, b smallint")
    for k in (2, 0, 1):  # blocks come in any order
        table.where(F.col("block") == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    box = (0.0, 0.0, 0.0, 1.0, 1.0, 1.0)

    def finished(sums, flags):
        return sorted(map(tuple, accumulator.coloured_centroids(sums, flags).select("rid", "n", "r", "g", "b").collect()))

    from cloudloom.operators.spatial import crop

    want = finished(accumulator.voxel_stream(crop(table, box), 0.5), accumulator.colour_flags(table, "cloud", box=box))
    stream = lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for name, df in (("sums", accumulator.voxel_stream(crop(stream(), box), 0.5)), ("flags", accumulator.colour_flags(stream(), "cloud", box=box))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(f"{name}_{case}").option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert finished(spark.table(f"sums_{case}"), spark.table(f"flags_{case}")) == want
    assert all((r is not None) == (case in ("all", "outside")) for *_, r, _, _ in want)
