"""Findings of the fourth round, each on a small table that failed before."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cloudloom.operators import cluster, context, fits, graph, raster, review, spatial, structure
from cloudloom.plans import queries
from cloudloom.plans.model import CODE


def test_signs_round_as_their_sql(spark, tmp_path):
    """lengths whose fifth decimal is a 5, where digits and product round apart."""
    money = np.arange(-100_000, 1_000_000, 25) / 100
    pd.DataFrame({"s_suppkey": np.arange(len(money)), "s_acctbal": money}).to_parquet(tmp_path / "supplier.parquet")
    got = queries.signs(spark, str(tmp_path)).toPandas().sort_values("instance_id", ignore_index=True)
    with duckdb.connect() as at:
        at.sql(f"create view supplier as select * from '{tmp_path}/supplier.parquet'")
        want = at.sql(f"with {queries._SIGN_SQL} select * from sign order by instance_id").df()
    for c in ("d1", "d2", "d3"):
        assert (got[c] == want[c]).all(), c


SIGN = "instance_id long, label smallint, d1 double, d2 double, d3 double, z_extent double, to_ceiling double, to_floor double, verticality double, cx double, cy double, cz double"


def _signs(spark, n, seed, copies=1):
    draw = np.random.default_rng(seed)
    place = lambda k: draw.integers(0, 12, k) / 20
    some = np.column_stack([draw.uniform(0.02, 3, n), draw.uniform(0.02, 1, n), draw.uniform(0.02, 0.4, n), draw.uniform(0, 1, (n, 4)), place(n), place(n), place(n)])
    some[0, :3] = some[1, :3] = (0.25, 0.2, 0.25)
    rows = np.concatenate([some] * copies)
    return rows, [(i, int(draw.integers(0, 17)), *map(float, r)) for i, r in enumerate(rows)]


def _same(a, m):
    """Which of ``a`` lie in the place of each ``m``."""
    d = ((a[:, None, 7:] - m[None, :, 7:]) ** 2)[..., 0] + ((a[:, None, 7:] - m[None, :, 7:]) ** 2)[..., 1] + ((a[:, None, 7:] - m[None, :, 7:]) ** 2)[..., 2]
    return (d <= 0.09) & (np.abs(a[:, None, :3] - m[None, :, :3]) <= np.maximum(m[None, :, :3] * 0.2, 0.05)).all(axis=2), d


def test_more_models_than_a_broadcast_holds(spark, monkeypatch):
    """Bands give the pairs of all against all, whatever the number of models."""
    monkeypatch.setattr(review, "MODELS_AT_MOST", 10, raising=False)
    rows, table = _signs(spark, 150, 1)
    a = spark.createDataFrame(table, SIGN)
    m = a.select(F.col("instance_id").alias("ord"), F.lit("m").alias("name"), (F.col("instance_id") % 5).cast("int").alias("target"), *a.columns[2:])
    got = {(r.instance_id, r.ord) for r in review.model_matches(a, m).collect()}
    want = {(i, j) for i, x in enumerate(rows) for j, y in enumerate(rows) if (np.abs(x[:3] - y[:3]) <= np.maximum(y[:3] * 0.4, 0.08)).all() and x[3] <= y[3] + max(y[3] * 0.4, 0.08)
            and (x[6] > 0.7, x[6] < 0.35) == (y[6] > 0.7, y[6] < 0.35) and abs(x[4] - y[4]) <= 0.6}
    assert got == want and len(got) > 200
    assert review.apply_models(a, m, a.where("instance_id % 3 = 0")).count() == 150


def test_places_of_copies_are_compared_once(spark):
    """no side of the join is broadcast, and copies of a signature cost no pairs where only the nearest counts."""
    rows, table = _signs(spark, 60, 2, copies=4)
    a, b = spark.createDataFrame(table, SIGN).where("instance_id % 6 > 0"), spark.createDataFrame(table, SIGN).where("instance_id % 7 > 0")
    plan = review.place_join(b, a)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    before, after = np.array([r[0] for r in table if r[0] % 6 > 0]), np.array([r[0] for r in table if r[0] % 7 > 0])
    met, d = _same(rows[after], rows[before])
    assert {(r.a_instance_id, r.b_instance_id) for r in review.place_join(b, a).collect()} == {(int(after[i]), int(before[j])) for i, j in np.argwhere(met)}
    label, want = {r[0]: r[1] for r in table}, set()
    for i, x in enumerate(after):
        near = min(((d[i, j], before[j]) for j in np.flatnonzero(met[i])), default=None)
        if near and label[near[1]] != label[x]:
            want.add((int(x), label[near[1]], label[x]))
    assert {tuple(r) for r in review.diff_nearest(a, b).collect()} == want and len(want) > 0


def test_greedy_goes_in_order_where_rounds_are_slow(spark):
    """rows that all want the same partners are settled by stretches, with the result of one by one."""
    rows, table = _signs(spark, 12, 3, copies=20)
    a, b = spark.createDataFrame(table, SIGN).where("instance_id % 6 > 0"), spark.createDataFrame(table, SIGN).where("instance_id % 7 > 0")
    before, after = np.array([r[0] for r in table if r[0] % 6 > 0]), np.array([r[0] for r in table if r[0] % 7 > 0])
    met, _ = _same(rows[after], rows[before])
    used, want = set(), {}
    for j, x in enumerate(before):
        first = next((int(after[i]) for i in np.flatnonzero(met[:, j]) if after[i] not in used), None)
        if first is not None:
            used.add(first)
            want[int(x)] = first
    got = review.diff_greedy(a, b, pairs_at_once=1500).collect()
    assert {r.id_before: r.id_after for r in got if r.id_before is not None and r.id_after is not None} == want and len(want) > 100
    assert sum(r.outcome == "new" for r in got) == len(after) - len(want) and sum(r.outcome == "lost" for r in got) == len(before) - len(want)


def _rods(spark, copies):
    """Members of few shapes, some of which do not pair with themselves (axes of length 0.5), in a mixed order."""
    draw = np.random.default_rng(5)
    shapes = [([float(v) for v in draw.integers(0, 8, 3) / 2], [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.5, 0.0, 0.0]][k % 3], float(draw.integers(1, 5)) / 2, [0.1, 0.2][k % 2]) for k in range(30)]
    ids = draw.permutation(30 * copies)
    return spark.createDataFrame([(int(i), *shapes[int(i) % 30]) for i in ids], "instance_id long, centre array<double>, axis_ array<double>, length_ double, section_ double")


def test_rods_are_compared_by_shape(spark, monkeypatch):
    """copies of a rod cost no comparisons, and components need no pairs of copies; both are those of all pairs."""
    from cloudloom.plans.model import CONTEXT as t

    compared, join = [], context.grid_join
    monkeypatch.setattr(context, "grid_join", lambda a, b, *rest, **more: compared.append(a.count()) or join(a, b, *rest, **more))
    rods = _rods(spark, 6)
    rows = sorted(map(tuple, rods.collect()))
    for pairs, shapes in ((context.chain_pairs, context._chain_shapes), (context.parallel_pairs, context._light_shapes)):
        want = set()
        for a in rows:
            for b in rows:
                d = np.array(b[1]) - np.array(a[1])
                if a[0] < b[0] and abs(np.dot(a[2], b[2])) >= 0.9:
                    along = d @ np.array(a[2])
                    chain = np.linalg.norm(d) <= t["chain_reach"] and max(a[4], b[4]) <= t["chain_ratio"] * min(a[4], b[4]) and np.linalg.norm(d - along * np.array(a[2])) <= t["chain_offset"] and abs(along) - (a[3] + b[3]) / 2 <= t["chain_gap"]
                    light = d[:2] @ d[:2] <= 36 and 0.7 < a[3] / b[3] < 1.43 and abs(d[2]) < 0.5
                    if chain if pairs is context.chain_pairs else light:
                        want.add((a[0], b[0]))
        got = [tuple(r) for r in pairs(rods).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
        own = {r.node: r.component for r in context._linked(*shapes(rods, t)).collect()}
        assert own == {r.node: r.component for r in graph.connected_components(spark.createDataFrame(sorted(want), "src long, dst long")).collect()}
    assert compared and max(compared) <= 30


def test_anchoring_by_places_is_that_of_points(spark):
    """places that many instances share are compared once, and who falls is who falls one by one."""
    draw = np.random.default_rng(8)
    n, label = 160, [1, 2, 3, 9, 5, 8]
    rows, pts = [], []
    for i in range(1, n + 1):
        x, y, up = *(float(v) for v in draw.integers(0, 14, 2)), bool(draw.integers(0, 4) == 0)
        rows.append((i, label[int(draw.integers(0, 6))] if i > 40 else 3, [x, y, 0.0], [0.0, 0.0, 1.0] if up else [1.0, 0.0, 0.0], [1.0, 0.1, [0.05, 0.4][i % 2]], (False, 0.0, 0.0, [0.0, 0.0, 0.0])))
        pts += [(20 * i + k, x + (0.0 if up else k / 8), y, k / 8 if up else 0.0, rows[-1][1], i) for k in range(9)]
    pts += [(10**6 + k, 3.0, float(k), -0.2, 0, None) for k in range(3)]
    inst = spark.createDataFrame(rows, "instance_id long, label smallint, centre array<double>, axis array<double>, dims array<double>, cylinder struct<valid:boolean,radius:double,length:double,axis:array<double>>")
    points = spark.createDataFrame(pts, "pid long, x double, y double, z double, label smallint, instance_id long")
    code = lambda keys: {CODE[k] for k in keys}
    anchors, low = code(context.ANCHORS), code(context.NOT_AT_TOP)
    held = [(np.array(p[1:4]), p[4], p[5] or 0) for p in pts if p[4] in anchors]
    fell = set()
    for i, lab, _, axis, dims, _ in rows:
        if lab not in code(context.ANCHORED):
            continue
        mine, reach, up = [np.array(p[1:4]) for p in pts if p[5] == i], max(0.4, 1.5 * dims[2]), axis[2] == 1.0
        along = [m @ np.array(axis) for m in mine]
        ends = sum(
            any(((m - q) ** 2).sum() <= reach * reach and who != i and (who > i or who not in fell) and not (up and e and kind in low)
                for m, s in zip(mine, along, strict=True) if (s >= max(along) - 0.2 if e else s <= min(along) + 0.2) for q, kind, who in held) for e in (0, 1))
        if ends < (2 if up else 1):
            fell.add(i)
    got = {r.instance_id: r.label for r in context.anchoring(inst, points).collect()}
    assert {i for i, lab, *_ in rows if got[i] != lab} == fell and 10 < len(fell) < 100 and all(got[i] == CODE["NON_MEP_ARREDO"] for i in fell)


def test_nearest_few_need_few_pairs(spark, monkeypatch):
    """Dense and thin parts alike give the k nearest of all pairs, from a part of the pairs within the radius."""
    draw = np.random.default_rng(4)
    p = np.concatenate([draw.normal(0, 0.02, (300, 3)), draw.normal(0.5, 0.2, (150, 3)), draw.uniform(-2, 2, (40, 3)), np.tile([[0.25, 0.25, 0.0]], (30, 1))])
    points = spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})).cache()
    d = p[:, None] - p[None]
    d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
    met, join = [], spatial._by_level
    monkeypatch.setattr(spatial, "_by_level", lambda *a: met.append(join(*a)) or met[-1])
    for own in (True, False):
        got = {}
        for r in spatial.nearest_few(points, points, 6, 0.8, own=own).collect():
            got.setdefault(r.a_pid, []).append((r.nth_, r.b_pid, r.d2))
        for i in range(len(p)):
            order = [j for j in np.lexsort((np.arange(len(p)), d2[i])) if d2[i, j] <= 0.8 * 0.8 and (own or j != i)][:6]
            assert [b for _, b, _ in sorted(got.get(i, []))] == order, i
    assert 0 < met[-1].count() < (d2 <= 0.64).sum() / 5


def test_equal_planes_are_met_once(spark, monkeypatch):
    """of planes that are alike only the first meets points; a plane of two boxes is not alike one of them."""
    met, join = [], structure.in_boxes
    monkeypatch.setattr(structure, "in_boxes", lambda p, boxes, *a, **b: met.append(boxes.count()) or join(p, boxes, *a, **b))
    points = spark.createDataFrame([(k, 0.1 * i, 0.1 * i, 0.0) for k in (2, 3) for i in range(10)], "cluster_id int, x double, y double, z double").withColumn("x", F.col("x") + F.col("cluster_id"))
    box = lambda x0, x1: (0.0, 0.0, 1.0, 0.0, 0.0, x0, x1, -1.0, 1.0, -1.0, 1.0)
    rows = [(o, o % 3, *box(2.0, 3.0)) for o in range(7, 60)] + [(5, 9, *box(2.0, 3.0)), (5, 9, *box(3.0, 4.0)), (6, 4, *box(9.0, 9.5))]
    planes = spark.createDataFrame(rows, "ord int, code int, a double, b double, c double, d double, margin double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    thick = spark.createDataFrame([(2, 0.0), (3, 0.0)], "cluster_id int, thickness double")
    got = {r.cluster_id: r.code for r in structure.structural_residual(points, planes, thick, t=structure.STRUCTURE | {"residual_share": 0.9}).collect()}
    assert got == {2: 9, 3: 9} and met == [4]
    assert {r.cluster_id: r.code for r in structure.structural_residual(points, planes.where("ord > 6"), thick, t=structure.STRUCTURE | {"residual_share": 0.9}).collect()} == {2: 1}


def test_giants_hold_places_not_points(spark):
    """points of one place go to the cluster's task once, and count as often as they are."""
    draw = np.random.default_rng(6)
    some = np.concatenate([draw.integers(0, 40, (250, 3)) / (4, 4, 20) + (0, 0, 0.5), draw.integers(0, 40, (250, 3)) / (4, 4, 20) + (13, 0, 0.5), draw.integers(0, 20, (60, 3)) / 10 + (5, 5, 8.2)])
    often = draw.integers(1, 9, len(some))
    p = np.repeat(some, often, axis=0)[draw.permutation(often.sum())]
    pdf = pd.DataFrame({"pid": draw.permutation(len(p)), "cluster_id": 1, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})
    got = cluster.split_giants(spark.createDataFrame(pdf), 9.0, [0.0, 4.0]).toPandas().sort_values("pid")
    # the same by points, each a place of its own
    apart = pdf.sort_values("pid", ignore_index=True)
    q, t = apart[["x", "y", "z"]].to_numpy(), cluster.CLUSTER
    top, part = q[:, 2] >= 9.0 - t["ceiling_band"], np.full(len(q), -1)
    low = ~top
    sub, radius = np.zeros(low.sum(), int), t["erosion"]
    while radius <= 4 * t["erosion"]:
        sub = fits.erosion_split(q[low], radius, t["erosion_cell"], t["instance"])
        if max((np.ptp(q[low][sub == s, :2], axis=0).max() for s in np.unique(sub[sub >= 0])), default=0) <= t["giant"]:
            break
        radius *= 2
    part[low] = sub
    up = fits.components_within(q[top], t["eps"] * 2)
    part[top] = np.where(np.bincount(up)[up] < t["least"], -1, up + sub.max() + 1)
    assert len(got) == len(p) and (got["part"].to_numpy() == part).all() and len(set(part)) > 2
    plan = cluster.split_giants(spark.createDataFrame(pdf), 9.0, [0.0, 4.0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("FlatMapGroupsInPandas") < plan.rindex("Aggregate")


def test_distances_across_wide_empty_rasters(spark):
    """a few cells far apart, where rows and columns in full would be 10^13 cells."""
    draw = np.random.default_rng(7)
    known = {(int(a), int(b)): int(draw.integers(0, 99)) for c in (0, 1_000, 3_000_000) for a, b in draw.integers(-9, 9, (12, 2)) + c}
    known |= {(50, -7): 1, (50, 7): 2, (64, 0): 3}
    wanted = {(int(a), int(b)) for c in (-2_500_000, 0, 990, 40_000, 1_500_000, 3_000_100) for a, b in draw.integers(-30, 30, (30, 2)) + c} | {(50, 0), (57, 0)}
    cells = spark.createDataFrame([(*k, v) for k, v in known.items()], "i long, j long, v int")
    got = {(r.i, r.j): (r.v, r.d2) for r in raster.nearest_cell(cells, spark.createDataFrame([*wanted], "i long, j long"), "v").collect()}
    for i, j in wanted:
        d2, a, b = min(((i - a) ** 2 + (j - b) ** 2, a, b) for a, b in known)
        assert got[i, j] == (known[a, b], d2), (i, j)
    assert len(got) == len(wanted)


def test_long_empty_runs_cost_one_row(spark, monkeypatch):
    """an open shape whose rows are 2^36 cells wide, and closing across tiles' borders."""
    far = 1 << 36
    open_ = spark.createDataFrame([(0, i, j) for i in range(1, 5) for j in (0, far)], "level int, i long, j long")
    assert raster.holes(open_, "level").count() == 0
    draw = np.random.default_rng(2)
    some = spark.createDataFrame([(k, int(a), int(b)) for k in (0, 1) for a, b in draw.integers(-30, 30, (900, 2))], "level int, i long, j long").distinct()
    whole = {tuple(r) for r in raster.close(some, ["level"]).collect()}
    small = [tuple(r) for r in raster.close(some, ["level"], (5, 7)).collect()]
    assert set(small) == whole and len(small) == len(whole) and {r[:3] for r in whole if r[3]} == {tuple(r) for r in some.collect()}
    assert any(not own for *_, own in whole)
