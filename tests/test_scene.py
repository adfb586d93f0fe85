"""The whole plan on a room with known contents."""

from pyspark.sql import functions as F

from cloudloom.plans.model import CODE, Config
from cloudloom.plans.pipeline import segment
from cloudloom.plans.scene import room_points


def test_room_end_to_end(spark):
    points = room_points(spark, structure_step=0.08, object_step=0.035)
    got = segment(points, Config().with_values("preprocess", voxel=0.06))
    assert abs(got.floor) < 0.02 and abs(got.ceiling - 3.5) < 0.02
    rows = got.points.groupBy("truth", "label").count().toPandas()
    share = lambda truth, label: rows[(rows.truth == truth) & (rows.label == label)]["count"].sum() / rows[rows.truth == truth]["count"].sum()
    assert rows["count"].sum() == points.count() and not rows.label.isna().any()
    for key, least in (("PAVIMENTO", 0.9), ("SOFFITTO", 0.9), ("PARETE", 0.9), ("PILASTRO", 0.8), ("CONDOTTA_CIRCOLARE", 0.9), ("APPARECCHIATURA", 0.7), ("TERMINALE_ARIA", 0.7), ("LUCE", 0.5)):
        assert share(CODE[key], CODE[key]) >= least, key
    duct = got.instances.where(F.col("label") == CODE["CONDOTTA_CIRCOLARE"]).select("cylinder.radius").toPandas().radius
    assert (duct.sub(0.30).abs() < 0.02).any()
