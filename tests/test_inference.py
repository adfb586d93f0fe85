"""Blocks of a seeded permutation, a model over them, context of instances, and labellings that must match."""

import numpy as np
import pandas as pd
import pytest

from cloudloom.operators import inference, rules


def test_blocks_are_full_and_the_same_whatever_the_partitions(spark):
    points = spark.range(1000).withColumnRenamed("id", "pid")
    a, b = ({r.pid: (r.block, r.place) for r in inference.permuted_blocks(points.repartition(n), 300).collect()} for n in (1, 7))
    assert a == b and sorted(a.values()) == [(k // 300, k % 300) for k in range(1000)]
    c = {r.pid: r.block for r in inference.permuted_blocks(points, 300, seed=1).collect()}
    assert sum(c[k] != a[k][0] for k in c) > 400
    assert inference.permuted_blocks(points.limit(0), 300).count() == 0


def test_a_model_labels_every_point_once(spark):
    draw = np.random.default_rng(1)
    points = spark.createDataFrame(pd.DataFrame({"pid": range(700), **{c: draw.random(700) for c in "xyz"}}))

    def model(xyz):
        assert len(xyz) % 64 == 0 and np.abs(xyz.mean(axis=0)).max() < 1e-9
        return np.where(xyz[:, 0] > 0, 3, 5)

    got = inference.infer(points, model, 256, 64).join(points, "pid").toPandas()
    assert len(got) == 700 == got.pid.nunique()
    assert (got[got.x > 0.6].dl_label == 3).all() and (got[got.x < 0.4].dl_label == 5).all()
    with pytest.raises(Exception, match="labels for"):
        inference.infer(points, lambda xyz: np.zeros(3), 256, 64).count()


def test_context_of_an_instance(spark):
    points = spark.createDataFrame([(i, float(i % 10), float(i // 10), 0.0) for i in range(100)], "pid long, x double, y double, z double")
    boxes = spark.createDataFrame([(1, 2.0, 3.0, 2.0, 2.0, 0.0, 0.0), (2, 50.0, 51.0, 0.0, 1.0, 0.0, 1.0)], "instance_id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    got = inference.local_context(points, boxes, margin=1.5).collect()
    assert {(r.instance_id, r.pid) for r in got} == {(1, 10 * y + x) for x in (1, 2, 3, 4) for y in (1, 2, 3)} and len(got) == 12
    assert inference.local_context(points, boxes, margin=1.5, most=5).count() == 5


def test_labellings_of_other_points_are_an_error(spark):
    points = spark.createDataFrame([(1, 9), (2, 3), (3, 9)], "pid long, label smallint")
    other = spark.createDataFrame([(1, 4), (2, 5), (3, None)], "pid long, dl_label smallint")
    assert {r.pid: r.label for r in rules.fuse_labels(points, other).collect()} == {1: 4, 2: 3, 3: 9}
    for a, b in ((points, other.where("pid < 3")), (points.where("pid < 3"), other)):
        with pytest.raises(Exception, match="same points"):
            rules.fuse_labels(a, b).collect()
