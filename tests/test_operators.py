"""Points, voxels, joins, fits and review on small made clouds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom.functions import expr
from cloudloom.operators import cluster, context, dataset, features, fits, graph, ordered, raster, review, rules, spatial, structure, voxel
from cloudloom.plans.model import CLASSES, CLUSTER, CODE, GROUPS, Config, class_table, excluded_codes


def cloud(spark, xyz, **more):
    pdf = pd.DataFrame({"pid": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], **more})
    return spark.createDataFrame(pdf)


def tube(radius, length, n, axis=0, offset=(0.0, 0.0, 0.0), sigma=0.003, seed=0):
    draw = np.random.default_rng(seed)
    a, t = draw.random(n) * 2 * np.pi, (draw.random(n) - 0.5) * length
    normal = np.zeros((n, 3))
    others = [k for k in range(3) if k != axis]
    normal[:, others[0]], normal[:, others[1]] = np.cos(a), np.sin(a)
    p = normal * (radius + draw.normal(0, sigma, (n, 1)))
    p[:, axis] = t
    return p + np.asarray(offset), normal


def test_groups_partition_the_classes(spark):
    assert len(CLASSES) == 17 == class_table(spark).count() and {g for *_, g, _ in CLASSES} == set(GROUPS)
    assert excluded_codes([" luce", "SPRINKLER "]) == {5, 6}
    with pytest.raises(ValueError, match="valid are"):
        excluded_codes(["MURO"])
    with pytest.raises(ValueError):
        Config().with_values("rules", nonsense=1)


def test_voxel_blocks_merge(spark):
    block = lambda rows: spark.createDataFrame(rows, "pid long, x double, y double, z double, r smallint, g smallint, b smallint")
    one = block([(1, 0.01, 0.0, 0.0, 200, 0, 0), (2, 0.02, 0.0, 0.0, 100, 0, 0), (3, 0.5, 0.0, 0.0, 0, 255, 0)])
    two = block([(4, 0.03, 0.0, 0.0, 0, 0, 0)])
    got = voxel.voxel_centroids(voxel.merge_sums(voxel.voxel_sums(one, 0.1).unionByName(voxel.voxel_sums(two, 0.1)))).orderBy("x").collect()
    assert [(r.n, r.r, r.g, r.b) for r in got] == [(3, 100, 0, 0), (1, 0, 255, 0)] and abs(got[0].x - 0.02) < 1e-12
    with pytest.raises(Exception, match="outside the voxel range"):
        voxel.voxel_sums(block([(1, 1e9, 0.0, 0.0, 0, 0, 0)]), 0.1).count()
    assert voxel.voxel_downsample(block([]), 0.1).count() == 0
    missing = voxel.voxel_centroids(voxel.voxel_sums(block([(1, 0.0, 0.0, 0.0, None, None, None), (2, 0.01, 0.0, 0.0, 1, 1, 1)]), 0.1)).first()
    assert missing.n == 2 and missing.r is None


@pytest.mark.parametrize("seed", [0, 1])
def test_joins_in_space_against_numpy(spark, seed):
    p = np.random.default_rng(seed).random((200, 3))
    points = cloud(spark, p)
    d2 = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if d2[i, j] <= 0.04}
    assert {(r.src, r.dst) for r in spatial.pairs_within(points, 0.2).collect()} == want
    np.fill_diagonal(d2, 9)
    got = spatial.knn(points, 3, 0.5).toPandas()
    for i, g in got.groupby("src"):
        assert g.sort_values("rank").dst.tolist() == np.lexsort((np.arange(200), d2[i]))[: len(g)].tolist()
    far = cloud(spark, p[:5] + 40.0)
    near = spatial.nearest(far, points, 0.1).toPandas().set_index("pid")
    for i in range(5):
        assert near.near_pid[i] == ((p - p[i] - 40.0) ** 2).sum(axis=1).argmin()
    assert spatial.nearest(far, points, 0.1, max_radius=1.0).count() == 0 and spatial.nearest(far, points.limit(0), 0.1).count() == 0


def test_components_of_a_long_path(spark):
    order = np.random.default_rng(3).permutation(300)
    edges = [(int(a), int(b)) for a, b in zip(order, order[1:], strict=False)] + [(1000, 1001), (1002, 1002), (None, 5)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[int(i)] for i in order} == {0} and got[1001] == 1000 and got[1002] == 1002 and len(got) == 303
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_holes_and_erosion(spark):
    ring = [(i, j) for i in range(9) for j in range(9) if not (3 <= i <= 5 and 3 <= j <= 5)]
    cells = spark.createDataFrame([(0, i, j) for i, j in ring], "level int, i long, j long")
    assert {(r.i, r.j) for r in raster.holes(cells, "level").collect()} == {(i, j) for i in range(3, 6) for j in range(3, 6)}
    solid = spark.createDataFrame([(i, j) for i in range(5) for j in range(5)], "i long, j long")
    assert raster.erode(solid).count() == 9 and raster.erode(solid, 2).count() == 1 and raster.dilate(solid).count() == 49


def test_cylinder_fit_and_residuals(spark):
    p, n = tube(0.15, 3.0, 2000)
    points = cloud(spark, p, nx=n[:, 0], ny=n[:, 1], nz=n[:, 2], cluster_id=7)
    fit = fits.fit_cylinders(points, "cluster_id")
    c = fit.first().cylinder
    assert c.valid and abs(c.radius - 0.15) < 0.005 and abs(abs(c.axis[0]) - 1) < 1e-2 and c.inliers > 0.95 and c.radial > 0.95 and abs(c.length - 3) < 0.05
    assert fits.cylinder_residuals(points, fit, "cluster_id").agg(F.avg("residual")).first()[0] < 0.01
    assert not fits.fit_cylinders(points.limit(10), "cluster_id").first().cylinder.valid
    ring = fits.circle_fits(points, ["cluster_id"], "y", "z").first()
    assert abs(ring.radius - 0.15) < 0.002
    assert fits.fit_circle(np.zeros((2, 2)))[1] == 0.0


def test_direction_split():
    a, na = tube(0.15, 3.0, 2000, axis=0)
    b, nb = tube(0.15, 3.0, 2000, axis=1, offset=(0, 0, 0.35), seed=1)
    part = fits.split_by_direction(np.concatenate([a, b]), np.concatenate([na, nb]), sphericity=None)
    for k in np.argsort(-np.bincount(part))[:2]:  # the two largest parts are of one tube each
        share = (np.flatnonzero(part == k) < 2000).mean()
        assert share >= 0.9 or share <= 0.1
    blind = nb.copy()
    blind[::2] = np.nan  # points without a normal follow their neighbours
    part = fits.split_by_direction(np.concatenate([a, b]), np.concatenate([na, blind]), sphericity=None, scraps="nearest")
    assert len(np.unique(part)) == 2 and (part[:2000] == np.bincount(part[:2000]).argmax()).mean() >= 0.9 and (part[2000:] == np.bincount(part[2000:]).argmax()).mean() >= 0.9
    part = fits.split_by_direction(np.concatenate([a, b]), np.concatenate([na, nb]), sphericity=None, scraps="nearest")
    first, second = np.bincount(part[:2000]).argmax(), np.bincount(part[2000:]).argmax()
    assert first != second and (part[:2000] == first).mean() >= 0.9 and (part[2000:] == second).mean() >= 0.9
    assert fits.split_by_direction(a, na).max() == 0
    draw = np.random.default_rng(2)
    slab = np.column_stack([draw.random((2000, 2)) * 2, draw.normal(0, 0.003, 2000)])
    assert fits.split_by_direction(slab, np.tile([0.0, 0.0, 1.0], (2000, 1))).max() == 0
    short, ns = tube(0.2, 0.6, 1200)
    other, no = tube(0.2, 0.6, 1200, axis=1, seed=3)
    blob, nn = np.concatenate([short, other]), np.concatenate([ns, no])
    assert fits.split_by_direction(blob, nn).max() == 0 < fits.split_by_direction(blob, nn, sphericity=None).max()


def test_nearest_and_components_by_cells():
    draw = np.random.default_rng(9)
    known, asked = draw.random((300, 3)) * 3, draw.random((200, 3)) * 9 - 3
    d = ((asked[:, None] - known[None]) ** 2).sum(axis=2)
    assert (fits.nearest_of(asked, known, 0.1) == d.argmin(axis=1)).all() and len(fits.nearest_of(asked[:0], known, 0.1)) == 0
    close = ((known[:, None] - known[None]) ** 2).sum(axis=2) <= 0.25**2
    label, want = fits.components_within(known, 0.25), np.arange(300)
    for _ in range(300):
        want = np.where(close, want[None], 300).min(axis=1)
    assert len(np.unique(label)) == len(np.unique(want)) == len(set(zip(label.tolist(), want.tolist(), strict=True)))


def test_circles_through_triples():
    centre, radius = np.array([[2.0, -1.0]]), 0.5
    at = np.array([[[np.cos(a), np.sin(a)] for a in (0.1, 2.0, 4.0)]]) * radius + centre[:, None]
    got, r = fits.circles_through(np.concatenate([at, [[[0, 0], [1, 1], [2, 2]]]]))
    assert np.allclose(got, centre) and np.allclose(r, radius)


def test_erosion_split():
    draw = np.random.default_rng(0)
    a, b = draw.random((3000, 3)) * (4, 4, 1), draw.random((3000, 3)) * (4, 4, 1) + (6, 0, 0)
    bridge = draw.random((200, 3)) * (2, 0.2, 1) + (4, 2, 0)
    part = fits.erosion_split(np.concatenate([a, b, bridge]))
    assert len(set(part[:3000])) == 1 and part[0] != part[3000]


def test_shape_of_a_slab_and_a_rod(spark):
    draw = np.random.default_rng(0)
    slab = draw.random((800, 3)) * (4, 2, 0.01)
    rod = draw.random((800, 3)) * (0.02, 0.02, 3) + (9, 9, 0)
    points = cloud(spark, np.concatenate([slab, rod]), cluster_id=[0] * 800 + [1] * 800)
    got = {r.cluster_id: r for r in features.build_features(points, 0.05, ceiling=3.0, floor=0.0).collect()}
    assert got[0].planarity + got[0].linearity > 0.9 and got[1].linearity > 0.95 and got[1].verticality > 0.99 > 0.1 > got[0].verticality
    assert abs(got[1].dims[0] - 3) < 0.1 and got[1].dims[1] < 0.1 and abs(got[1].to_ceiling) < 0.1


def test_colour_cut_in_growth(spark):
    g = np.mgrid[0:2:0.04, 0:1:0.04].reshape(2, -1).T
    xyz = np.column_stack([g, np.random.default_rng(0).normal(0, 0.002, len(g))])
    grey = xyz[:, 0] < 1
    t = CLUSTER | {"patch": 20, "eps": 0.1}
    colour = {c: np.where(grey, 128, v).astype("int16") for c, v in zip("rgb", (255, 220, 0), strict=True)}
    got = cluster.grow(cloud(spark, xyz, **colour), 0.04, t).toPandas().set_index("pid").cluster_id
    assert got[grey.nonzero()[0]].nunique() == 1 and got[(~grey).nonzero()[0]].nunique() == 1 and got.nunique() == 2
    assert cluster.grow(cloud(spark, xyz), 0.04, t).select("cluster_id").distinct().count() == 1


def test_dominant_colour_and_guide(spark):
    draw = np.random.default_rng(0)
    points = cloud(spark, draw.random((400, 3)), cluster_id=1, r=np.int16(250), g=np.int16(220), b=np.int16(5))
    got = features.dominant_colour(points, ["cluster_id"]).withColumn("label", F.lit(9).cast("smallint"))
    assert got.first().colour == [250, 220, 5] and got.first().uniformity == 1.0
    assert rules.colour_guide(got, [("luce", (255, 220, 0), None)]).first().label == 5
    assert rules.colour_guide(got, []).first().label == 9
    assert rules.colour_guide(got.withColumn("label", F.lit(3).cast("smallint")), [("luce", (255, 220, 0), None)]).first().label == 3


def test_planes_are_peeled(spark):
    draw = np.random.default_rng(0)
    floor = np.column_stack([draw.random((3000, 2)) * 6, draw.normal(0, 0.003, 3000)])
    wall = np.column_stack([draw.normal(0, 0.003, 2000), draw.random((2000, 2)) * (6, 3)])
    noise = draw.random((300, 3)) * (6, 6, 3)
    points = cloud(spark, np.concatenate([floor, wall, noise]))
    planes, left = structure.peel_planes(points, 0.02, 1000, 5)
    assert [structure.orientation_of(p["plane"]) for p in planes] == ["horizontal", "vertical"] and left.count() <= 320


def test_anchoring_follows_earlier_demotions(spark):
    row = lambda i, x, label: (i, label, 500, [x, 0.0, 1.0], [1.0, 0.0, 0.0], [1.0, 0.1, 0.1], (False, 0.0, 0.0, [0.0, 0.0, 0.0]))
    schema = "instance_id long, label smallint, n long, centre array<double>, axis array<double>, dims array<double>, cylinder struct<valid:boolean,radius:double,length:double,axis:array<double>>"
    inst = spark.createDataFrame([row(1, 0.0, 3), row(2, 1.2, 3), row(3, 9.0, 3)], schema)
    pts = [(10 * i + k, x - 0.5 + k / 9.0, 0.0, 1.0, 3, i) for i, x in ((1, 0.0), (2, 1.2), (3, 9.0)) for k in range(10)]
    schema = "pid long, x double, y double, z double, label smallint, instance_id long"
    got = {r.instance_id: r.label for r in context.anchoring(inst, spark.createDataFrame(pts, schema)).collect()}
    assert got == {1: 3, 2: 3, 3: CODE["NON_MEP_ARREDO"]}  # one and two hold each other, three holds nothing


def test_reviews(spark):
    sign = "instance_id long, label smallint, d1 double, d2 double, d3 double, z_extent double, to_ceiling double, to_floor double, verticality double, cx double, cy double, cz double"
    a = spark.createDataFrame([(1, 9, 1.0, 0.5, 0.1, 0.1, 0.2, 2.0, 0.1, 0.0, 0.0, 2.0), (2, 9, 3.0, 2.0, 1.0, 1.0, 2.0, 0.0, 0.9, 5.0, 0.0, 0.0)], sign)
    model = a.where("instance_id = 1").select(F.lit(0).alias("ord"), F.lit("lamp").alias("name"), F.lit(5).alias("target"), *a.columns[2:])
    assert {r.instance_id: r.label for r in review.apply_models(a, model).collect()} == {1: 5, 2: 9}
    assert {r.instance_id: r.label for r in review.apply_models(a, model, a.where("instance_id = 1")).collect()} == {1: 9, 2: 9}
    yes = a.where("instance_id = 2").withColumns({"decision": F.lit(0).cast("long"), "label": F.lit(8).cast("smallint")})
    assert {r.instance_id: r.label for r in review.apply_pins(a, yes, a.where("instance_id < 3").withColumn("decision", F.col("instance_id"))).collect()} == {1: 16, 2: 8}
    diff = review.diff_greedy(a, a.where("instance_id = 1").withColumn("label", F.lit(5).cast("smallint")))
    assert sorted((r.id_before, r.outcome) for r in diff.collect()) == [(1, "changed"), (2, "lost")]


def test_ordered_and_dataset(spark):
    t = spark.createDataFrame([(0, z) for z in (0.0, 0.1, 0.9, 1.0, 3.0)], "grp int, z double")
    assert [(r.low, r.high, r.cut) for r in ordered.levels(t, ["grp"]).orderBy("level").collect()] == [(0.0, 0.1, 0.5), (0.9, 1.0, 2.0), (3.0, 3.0, None)]
    assert ordered.kept_levels(t, ["grp"], "z", 0.5).first().kept == [0.0, 0.9, 3.0]
    m = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "truth int, predicted int")
    assert {r.code: r.iou for r in dataset.intersection_over_union(dataset.confusion(m)).collect()} == {0: 0.5, 1: 0.5}
    text = spark.createDataFrame([("Pump here\nlight",), ("x\nLIGHT",), (None,)], "t string").select(expr.first_keyword(F.col("t"), [("light", "L"), ("pump", "P")], "-").alias("v"))
    assert [r.v for r in text.collect()] == ["P", "L", "-"]


def test_chains_of_any_direction_equal_all_pairs(spark):
    """Random axes, sections and lengths: the keyed join has the pairs of the plain one."""
    from cloudloom.operators import context
    from cloudloom.plans.model import CONTEXT as t

    draw = np.random.default_rng(31)
    n = 500
    axis = draw.normal(size=(n, 3))
    axis[: n // 2] = np.array([[0.6, 0.8, 0], [0, 0, 1.0]])[draw.integers(0, 2, n // 2)] + draw.normal(size=(n // 2, 3)) * 0.1
    axis /= np.linalg.norm(axis, axis=1, keepdims=True)
    axis[0], axis[1] = (1, 0, 0), (-1, 0, 0)
    centre, length, section = draw.uniform(0, 6, (n, 3)), draw.uniform(0.3, 4, n), draw.uniform(0.02, 0.8, n)
    centre[1] = centre[0] + (1.0, 0.1, 0)
    section[1] = section[0]
    rows = [(i, centre[i].tolist(), axis[i].tolist(), float(length[i]), float(section[i])) for i in range(n)]
    got = context.chain_pairs(spark.createDataFrame(rows, "instance_id long, centre array<double>, axis_ array<double>, length_ double, section_ double"))
    want = set()
    for a in range(n):
        for b in range(a + 1, n):
            d = centre[b] - centre[a]
            along = d @ axis[a]
            if np.linalg.norm(d) <= t["chain_reach"] and abs(axis[a] @ axis[b]) >= t["parallel"] and max(section[a], section[b]) <= t["chain_ratio"] * min(section[a], section[b]):
                if np.linalg.norm(d - along * axis[a]) <= t["chain_offset"] and abs(along) - (length[a] + length[b]) / 2 <= t["chain_gap"]:
                    want.add((a, b))
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and (0, 1) in want and len(want) > 50
    assert context.chain_pairs(spark.createDataFrame([], "instance_id long, centre array<double>, axis_ array<double>, length_ double, section_ double")).count() == 0


def test_a_small_plane_of_a_large_cloud_is_found(spark):
    """A plane with one point in two hundred is proposed by its own cells, by jobs and at once alike."""
    draw = np.random.default_rng(9)
    floor = np.column_stack([draw.random((25_000, 2)) * (40, 10), draw.normal(0, 0.002, 25_000)])
    noise = draw.random((25_000, 3)) * (40, 10, 6) + (0, 0, 0.5)
    small = np.column_stack([draw.random((300, 2)) * (1.5, 1.0) + (33.2, 4.1), draw.normal(3.0, 0.002, 300)])
    points = spark.createDataFrame(pd.DataFrame(np.concatenate([floor, noise, small]), columns=list("xyz")))
    for small_rows in (0, 100_000):
        planes, left = structure.peel_planes(points, 0.02, 250, 2, small_rows=small_rows)
        at = [np.abs(np.array([33.95, 4.6, z, 1.0]) @ p["plane"]) for z, p in zip((0.0, 3.0), planes, strict=True)]
        assert max(at) < 0.02 and planes[1]["n"] >= 300
        assert left.count() == 50_300 - sum(p["n"] for p in planes)
