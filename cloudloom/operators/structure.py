"""Floors, ceilings, walls, columns and beams.

Planes are peeled off one after another. Each round scores all candidate planes in one
pass over the points (a conditional count each), so the driver only ever holds some
hundred candidate planes and the table of accepted ones.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import voxel_index
from ..plans.model import CODE, STRUCTURE
from . import raster, voxel
from .quantiles import quantiles
from .spatial import near
from .tables import stored


def _offset(plane) -> Column:
    a, b, c, d = (float(v) for v in plane)
    return a * F.col("x") + b * F.col("y") + c * F.col("z") + d


LOCAL_CELL, LOCAL_TRIES, LOCAL_PLANES = 1.0, 24, 10  # a cell's side, the triples tried for each of its planes, and so many planes of it at most
MERGED = 400  # proposals that are counted over all points


def local_planes(xyz: np.ndarray, distance: float, tries: int = LOCAL_TRIES, planes: int = LOCAL_PLANES, seed: int = 0) -> np.ndarray:
    """(k, 5): planes of one cell's points, (a, b, c, d) and the points that each holds; peeled off one after another.

    Planes go through triples of the points that are left and are laid through the middle
    of what they hold. Triples are drawn by the number of points alone.
    """
    out, left = [], xyz
    draw = np.random.default_rng(seed)
    while len(out) < planes and len(left) >= max(12, len(xyz) // 20):
        pick = left[draw.integers(0, len(left), (tries, 3))]
        normal = np.cross(pick[:, 1] - pick[:, 0], pick[:, 2] - pick[:, 0])
        size = np.linalg.norm(normal, axis=1)
        good = size > 1e-9
        if not good.any():
            break
        normal = normal[good] / size[good, None]
        near_ = np.abs(left @ normal.T - (normal * pick[good, 0]).sum(axis=1)) <= distance
        mine = near_[:, near_.sum(axis=0).argmax()]
        mid = left[mine].mean(axis=0)
        own = np.linalg.eigh(np.cov((left[mine] - mid).T, bias=True))[1][:, 0] if mine.sum() > 3 else normal[near_.sum(axis=0).argmax()]
        mine = np.abs((left - mid) @ own) <= distance
        if mine.sum() < 3:
            break
        own = own if own[np.abs(own).argmax()] > 0 else -own
        out.append((*own, -float(own @ mid), float(mine.sum())))
        left = left[~mine]
    return np.array(out).reshape(-1, 5)


def merged_planes(votes: np.ndarray, distance: float, most: int = MERGED) -> np.ndarray:
    """(k, 4): cells' planes that are alike, as one: the mean by votes of each bin of direction and offset, those with the most votes first."""
    if not len(votes):
        return np.zeros((0, 4))
    order = np.lexsort(np.round(votes, 9).T)  # the same sums whatever the order that cells come in
    votes = votes[order]
    key = np.column_stack([np.round(votes[:, :3] / 0.05), np.round(votes[:, 3] / max(4 * distance, 0.05))]).astype(np.int64)
    _, of = np.unique(key, axis=0, return_inverse=True)
    weight = np.bincount(of.ravel(), votes[:, 4])
    mean = np.stack([np.bincount(of.ravel(), votes[:, 4] * votes[:, k]) for k in range(4)], axis=1) / weight[:, None]
    mean /= np.linalg.norm(mean[:, :3], axis=1, keepdims=True)
    return mean[np.argsort(-weight, kind="stable")[:most]]


def proposals(points: DataFrame, distance: float, cell: float = LOCAL_CELL, most: int = MERGED) -> np.ndarray:
    """(k, 4): planes that cells of all points propose, each cell a group of its own; the bins' votes are added up by Spark, and the ``most`` voted come to the driver."""
    keys = [F.floor(F.col(c) / cell).alias(f"c{c}_") for c in "xyz"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz = pdf.sort_values(["x", "y", "z"])[["x", "y", "z"]].to_numpy(float)
        return pd.DataFrame(local_planes(xyz, distance), columns=["a", "b", "c", "d", "n"])

    each = points.select("x", "y", "z", *keys).groupBy(*(f"c{c}_" for c in "xyz")).applyInPandas(run, "a double, b double, c double, d double, n double")
    each = each.withColumns({"u_": F.round(F.col("a") / 0.05), "v_": F.round(F.col("b") / 0.05), "w_": F.round(F.col("c") / 0.05), "o_": F.round(F.col("d") / max(4 * distance, 0.05))})
    bins = each.groupBy("u_", "v_", "w_", "o_").agg(F.sum("n").alias("n"), *(F.sum(F.col(c) * F.col("n")).alias(c) for c in "abcd"))
    top = bins.orderBy(F.desc("n"), "u_", "v_", "w_", "o_").limit(most).toPandas()
    mean = top[["a", "b", "c", "d"]].to_numpy(float) / top[["n"]].to_numpy(float) if len(top) else np.zeros((0, 4))
    return mean / np.maximum(np.linalg.norm(mean[:, :3], axis=1, keepdims=True), 1e-12)


def _over_all(points: DataFrame, planes: np.ndarray, distance: float, width: int, sums) -> np.ndarray:
    """(planes, width): for each of ``planes`` the sums that ``sums(points, offsets near it)`` gives, over all points, in one pass."""

    def run(parts):
        out = np.zeros((len(planes), width))
        for batch in parts:
            xyz = np.column_stack([c.to_numpy() for c in batch.columns])
            for at in range(0, len(xyz), 2000):
                some = xyz[at : at + 2000]
                out += sums(some, np.abs(some @ planes[:, :3].T + planes[:, 3]) <= distance)
        yield pa.record_batch([pa.array(np.arange(len(planes))), *(pa.array(c) for c in out.T)], names=["k", *(f"s{i}" for i in range(width))])

    kinds = ", ".join(f"s{i} double" for i in range(width))
    added = points.select("x", "y", "z").mapInArrow(run, f"k long, {kinds}").groupBy("k").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(width)))
    got = added.toPandas().sort_values("k")  # a row a plane
    return got[[f"s{i}" for i in range(width)]].to_numpy()


def _counts(xyz: np.ndarray, near_: np.ndarray) -> np.ndarray:
    return near_.sum(axis=0)[:, None].astype(float)


def _moments(xyz: np.ndarray, near_: np.ndarray) -> np.ndarray:
    x, y, z = xyz.T
    return near_.T.astype(float) @ np.column_stack([np.ones(len(x)), x, y, z, x * x, x * y, x * z, y * y, y * z, z * z])


class _Cloud:
    """Passes over a cloud's points: by Spark, or at once where they are few; the same sums either way."""

    def __init__(self, points: DataFrame, distance: float, cell: float, small_rows: int, n: int | None = None) -> None:
        self.points, self.distance, self.cell = points, distance, cell
        self.n = points.count() if n is None else n
        self.sample = points.select("x", "y", "z").toPandas().sort_values(["x", "y", "z"]).to_numpy(float) if self.n <= small_rows else None
        if self.n:  # moments are taken about the middle
            self.mid = self.sample.mean(axis=0) if self.sample is not None else np.array([float(v) for v in points.agg(*(F.avg(c) for c in "xyz")).first()])

    def proposals(self) -> np.ndarray:
        if self.sample is None:
            return proposals(self.points, self.distance, self.cell)
        cells = np.floor(self.sample / self.cell).astype(np.int64)
        order = np.lexsort(cells.T)
        cuts = np.flatnonzero((np.diff(cells[order], axis=0) != 0).any(axis=1)) + 1
        parts = [local_planes(self.sample[np.sort(part)], self.distance) for part in np.split(order, cuts)]
        return merged_planes(np.concatenate([np.zeros((0, 5)), *parts]), self.distance)

    def over_all(self, planes: np.ndarray, width: int, sums) -> np.ndarray:
        mid = self.mid
        about = lambda xyz, near_: sums(xyz - mid, near_)
        if self.sample is None:
            return _over_all(self.points, planes, self.distance, width, about)
        out = np.zeros((len(planes), width))
        for at in range(0, len(self.sample), 2000):
            part = self.sample[at : at + 2000]
            out += about(part, np.abs(part @ planes[:, :3].T + planes[:, 3]) <= self.distance)
        return out

    def best(self, planes: np.ndarray, finals: int) -> tuple[tuple[float, ...] | None, int, np.ndarray]:
        """(plane, points, counts of ``planes``): the best few of ``planes`` are laid through the middle of all points that they hold and counted again."""
        if not len(planes) or self.n < 3:
            return None, 0, np.zeros(len(planes))
        hits = self.over_all(planes, 1, _counts)[:, 0]
        refined = []
        for m in self.over_all(planes[np.argsort(-hits, kind="stable")[:finals]], 10, _moments):
            if m[0] >= 3:
                centre = m[1:4] / m[0]
                second = m[[4, 5, 6, 5, 7, 8, 6, 8, 9]].reshape(3, 3) / m[0] - np.outer(centre, centre)
                normal = np.linalg.eigh(second)[1][:, 0]
                refined.append((*normal.tolist(), -float(normal @ (centre + self.mid))))
        if not refined:
            return None, 0, hits
        counts = self.over_all(np.array(refined), 1, _counts)[:, 0].astype(int).tolist()
        at = max(range(len(refined)), key=lambda i: (counts[i], -i))
        plane = np.array(refined[at]) * (1 if max(refined[at][:3], key=abs) > 0 else -1)
        return tuple(plane.tolist()), int(counts[at]), hits


def peel_planes(points: DataFrame, distance: float = 0.02, least: int = 1500, most: int = 60, cell: float = LOCAL_CELL, small_rows: int = 20_000, finals: int = 12) -> tuple[list[dict], DataFrame]:
    """(planes, what is left): the best plane again and again, its points removed, until the best has under ``least`` points.

    Each cell of the cloud proposes planes of its own points, so a plane is proposed
    whatever part of the cloud it is; like proposals are merged and counted over all points.
    Proposals serve as long as they give planes, then those of what is left are asked for.
    A plane is {plane_id, plane, n}; membership is by the first plane within ``distance``.
    A cloud of at most ``small_rows`` is handled at once, the same way.
    """
    planes, cloud = [], _Cloud(points, distance, cell, small_rows)
    asked, fresh = (cloud.proposals() if cloud.n else np.zeros((0, 4))), True
    while len(planes) < most and cloud.n >= max(least, 3):
        plane, n, hits = cloud.best(asked, finals)
        if plane is None or n < least:
            if fresh:
                break
            asked, fresh = cloud.proposals(), True
            continue
        planes.append({"plane_id": len(planes), "plane": plane, "n": n})
        left = cloud.points.where(F.abs(_offset(plane)) > distance)
        left = stored(left, "left") if len(planes) % 4 == 0 else left
        cloud = _Cloud(left, distance, cell, small_rows, cloud.n - n)
        asked, fresh = asked[hits >= least / 4], False  # what holds few of all points holds fewer of the rest
    return planes, cloud.points


def plane_of(planes: list[dict], distance: float) -> Column:
    """The number of the first plane within ``distance`` of a point; null if there is none."""
    out = F.lit(None).cast("int")
    for p in reversed(planes):
        out = F.when(F.abs(_offset(p["plane"])) <= distance, p["plane_id"]).otherwise(out)
    return out


def orientation_of(plane) -> str:
    up = abs(plane[2])
    return "horizontal" if up >= 0.9 else "vertical" if up <= 0.2 else "inclined"


def horizontal_kind(points: DataFrame, planes: DataFrame, near_band: float = 0.08, far_band: float = 0.20, ratio: float = 2.0, least: int = 20, middle: float = 0.0) -> DataFrame:
    """(plane_id, above, below, kind): floor if far more points stand in the band above than below, ceiling the other way round, else by the middle height. ``planes`` has plane_id, z and an xy box."""
    from .spatial import boxes_overlap

    dots = points.select("z", F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1"))
    met = boxes_overlap(dots, planes, 4.0)
    up, down = F.col("a_z") - F.col("b_z"), F.col("b_z") - F.col("a_z")
    seen = met.groupBy(F.col("b_plane_id").alias("plane_id")).agg(F.count_if(up.between(near_band, far_band)).alias("above"), F.count_if(down.between(near_band, far_band)).alias("below"))
    out = planes.join(seen, "plane_id", "left").withColumns({"above": F.coalesce("above", F.lit(0)), "below": F.coalesce("below", F.lit(0))})
    kind = F.when((F.col("above") > least) & (F.col("above") >= ratio * F.col("below")), "floor").when((F.col("below") > least) & (F.col("below") >= ratio * F.col("above")), "ceiling").otherwise(F.when(F.col("z") < middle, "floor").otherwise("ceiling"))
    return out.select("plane_id", "above", "below", kind.alias("kind"))


def plane_components(points: DataFrame, planes: list[dict], t: dict = STRUCTURE) -> DataFrame:
    """(pid, plane_id, part): the points of each plane by the components of their cells in the plane; for a vertical plane cells run along it and up."""
    held = points.withColumn("plane_id", plane_of(planes, t["plane_distance"])).where("plane_id is not null")
    along, up, facing = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(True)
    for p in planes:
        a, b, c, _ = p["plane"]
        mine, flat = F.col("plane_id") == p["plane_id"], abs(c) >= 0.9
        along = F.when(mine, F.col("x") if flat else (F.col("y") * a - F.col("x") * b) / float(max((a * a + b * b) ** 0.5, 1e-9))).otherwise(along)
        up = F.when(mine, F.col("y") if flat else F.col("z")).otherwise(up)
        if "nx" in points.columns:  # what merely crosses the plane would join its parts
            facing = F.when(mine, F.abs(a * F.col("nx") + b * F.col("ny") + c * F.col("nz")) > 0.85).otherwise(facing)
    cell = t["component_cell"]
    held = held.withColumns({"s_": along, "u_": up, "ok_": F.coalesce(facing, F.lit(False))}).where("ok_")
    # each plane has its own stretch of rows, so one search over cells serves all planes
    held = held.withColumns({"i": F.floor(F.col("s_") / cell).cast("long") + F.col("plane_id").cast("long") * 4_000_000, "j": F.floor(F.col("u_") / cell).cast("long")})
    held = stored(held.select("pid", "plane_id", "x", "y", "z", "s_", "u_", "i", "j"), "held")
    parts = raster.grid_components(held.select("i", "j"))
    return held.join(parts, ["i", "j"]).withColumnRenamed("component", "part").select("pid", "plane_id", "part", "x", "y", "z", "s_", "u_", "i", "j")


def accept_components(parts: DataFrame, planes: list[dict], bottom: float, top: float, t: dict = STRUCTURE, least: int = 200) -> DataFrame:
    """(plane_id, part, n, area, side, rise, z, kind): horizontal parts with sides and area enough are ``horizontal``; upright ones that rise far enough and meet the floor and the ceiling, or span most of the scene, are ``wall``."""
    flat = F.col("plane_id").isin([p["plane_id"] for p in planes if abs(p["plane"][2]) >= 0.9] or [-1])
    upright = F.col("plane_id").isin([p["plane_id"] for p in planes if abs(p["plane"][2]) <= 0.2] or [-1])
    cell = t["component_cell"]
    sums = parts.groupBy("plane_id", "part").agg(
        F.count(F.lit(1)).alias("n"), (F.count_distinct("i", "j") * cell * cell).alias("area"),
        F.least(F.max("s_") - F.min("s_"), F.max("u_") - F.min("u_")).alias("side"), (F.max("z") - F.min("z")).alias("rise"), F.avg("z").alias("z"), F.min("z").alias("z0"), F.max("z").alias("z1"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
    )
    meets = (F.col("z0") <= bottom + t["meet"]) & (F.col("z1") >= top - t["meet"])
    spans = F.col("rise") >= t["wall_share"] * (top - bottom)
    kind = (
        F.when(flat & (F.col("side") >= t["horizontal_side"]) & (F.col("area") >= t["horizontal_area"]), "horizontal")
        .when(upright & (F.col("rise") >= t["wall_height"]) & (F.col("area") >= t["wall_area"]) & (meets | spans), "wall")
    )
    return sums.where(F.col("n") >= least).withColumn("kind", kind).where("kind is not null")


def in_boxes(points: DataFrame, boxes: DataFrame, keep: list[str], cell: float = 4.0) -> DataFrame:
    """(keep of ``points``, columns of ``boxes`` after ``w_``): each point with each xyz box (x0 to z1) that holds it, by the cells of the plan."""
    from .spatial import boxes_overlap

    dots = points.select(*dict.fromkeys([*keep, "z"]), *(F.col(c).alias(f"{c}{e}") for c in "xy" for e in (0, 1)))
    met = boxes_overlap(dots, boxes, cell).where(F.col("a_z").between(F.col("b_z0"), F.col("b_z1")))
    names = {"x": "x0", "y": "y0"}
    return met.select(*(F.col(f"a_{names.get(c, c)}").alias(c) for c in dict.fromkeys([*keep, "x", "y", "z"])), *(F.col(f"b_{c}").alias(f"w_{c}") for c in boxes.columns))


def _widened(boxes: DataFrame, margin) -> DataFrame:
    return boxes.withColumns({f"{c}{e}": F.col(f"{c}{e}") + (margin if e else -margin) for c in "xyz" for e in (0, 1)})


def wall_completion(points: DataFrame, walls: DataFrame, t: dict = STRUCTURE, margin: float = 3.0) -> DataFrame:
    """(pid): points on a wall's plane, within its box and a margin, whose normal is along it. ``walls`` has plane_id, a, b, c, d and an xyz box."""
    met = in_boxes(points, _widened(walls, F.lit(float(margin))), ["pid", "nx", "ny", "nz"])
    on = F.abs(F.col("w_a") * F.col("x") + F.col("w_b") * F.col("y") + F.col("w_c") * F.col("z") + F.col("w_d")) <= t["residual_distance"]
    along = F.abs(F.col("w_a") * F.col("nx") + F.col("w_b") * F.col("ny") + F.col("w_c") * F.col("nz")) >= t["wall_align"]
    return met.where(on & along).select("pid").distinct()


def structural_residual(points: DataFrame, planes: DataFrame, thickness: DataFrame, by: str = "cluster_id", t: dict = STRUCTURE) -> DataFrame:
    """(by, code): thin clusters most of whose points lie within reach of one plane and in its widened box; the first plane decides. ``planes`` has ord, code, a, b, c, d, margin and an xyz box."""
    thin = points.join(thickness.where(F.col("thickness") <= t["residual_thickness"]).select(by), by, "left_semi").select(by, "x", "y", "z")
    sizes = thin.groupBy(by).agg(F.count(F.lit(1)).alias("n_"))
    close = F.abs(F.col("w_a") * F.col("x") + F.col("w_b") * F.col("y") + F.col("w_c") * F.col("z") + F.col("w_d")) <= t["residual_distance"]
    # planes that are alike hold the same points, so the first of them is enough; a plane of several boxes is alike another of the same ones
    shape = ["a", "b", "c", "d", "margin", *(f"{c}{e}" for c in "xyz" for e in (0, 1))]
    whole = planes.groupBy("ord", "code").agg(F.array_sort(F.collect_list(F.struct(*shape))).alias("boxes_"))
    first = whole.groupBy("boxes_").agg(F.min(F.struct("ord", "code")).alias("o_")).select("o_.*", F.explode("boxes_").alias("b_")).select("ord", "code", "b_.*")
    held = in_boxes(thin, _widened(stored(first, "planes"), F.col("margin")), [by]).where(close).groupBy(by, "w_ord", "w_code").agg(F.count(F.lit(1)).alias("on_"))
    good = held.join(sizes, by).where(F.col("on_") >= t["residual_share"] * F.col("n_"))
    return good.groupBy(by).agg(F.min_by("w_code", "w_ord").alias("code"))


def residual_planes(accepted: DataFrame) -> DataFrame:
    """The planes of :func:`extract_structure` that take up residues: walls with a wide margin, floors with a narrow one; ceilings do not, since what was freed from them lies in them."""
    wall, floor = F.col("kind") == "wall", F.col("sort") == "floor"
    return accepted.where(wall | floor).select(
        F.struct((-F.col("n")).alias("n"), "plane_id", "part").alias("ord"), F.when(wall, CODE["PARETE"]).otherwise(CODE["PAVIMENTO"]).cast("smallint").alias("code"),
        "a", "b", "c", "d", F.when(wall, 2.0).otherwise(0.3).alias("margin"), "x0", "x1", "y0", "y1", "z0", "z1",
    )


def _levels(points: DataFrame, gap: float) -> DataFrame:
    """``points`` with ``level``: heights without a gap are one."""
    # a bin of half a gap holds no gap, so levels follow from the bins' bounds and no window sees a point
    width = F.lit(gap / 2)
    bins = points.groupBy(F.floor(F.col("z") / width).alias("bin_")).agg(F.min("z").alias("low_"), F.max("z").alias("high_"))
    order = Window.orderBy("bin_")
    new = F.coalesce(((F.col("low_") - F.lag("high_").over(order)) > gap).cast("int"), F.lit(0))
    level_of = bins.withColumn("new_", new).withColumn("level", F.sum("new_").over(order)).select("bin_", "level")
    return points.withColumn("bin_", F.floor(F.col("z") / width)).join(level_of, "bin_")


def floor_map(points: DataFrame, cell: float = 0.5, gap: float = 0.5, least: int = 30) -> DataFrame:
    """(level, i, j, z): the lowest floor point of each cell, for levels (split at gaps) with enough points."""
    runs = _levels(points, gap)
    big = runs.groupBy("level").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("level")
    return runs.join(big, "level", "left_semi").groupBy("level", voxel_index(F.col("x"), cell).alias("i"), voxel_index(F.col("y"), cell).alias("j")).agg(F.min("z").alias("z"))


def fill_map(floors: DataFrame, asked: DataFrame, cell: float = 0.5, radius: float = 8.0) -> DataFrame:
    """(level, i, j, z) of the ``asked`` cells: for each level of a :func:`floor_map` the nearest observed floor within ``radius``."""
    levels = F.broadcast(floors.select("level").distinct())  # levels of a building
    wanted = asked.select("i", "j").distinct().join(levels, F.lit(True))
    return raster.fill_from_nearest(floors, wanted, "z", cell, radius, ["level"])


def level_medians(points: DataFrame, gap: float = 0.5, least: int = 30) -> DataFrame:
    """(level, n, low, z): the levels of a :func:`floor_map` with their points' number, least and median height."""
    runs = _levels(points, gap)
    about = runs.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low")).where(F.col("n") >= least)
    return about.join(quantiles(runs, ["level"], "z", (0.5,)), "level").select("level", "n", "low", F.get("q", F.lit(0)).alias("z"))


def floor_at(points: DataFrame, floors: DataFrame, cell: float = 0.5) -> DataFrame:
    """``points`` with ``lowest_floor`` of their cell and ``own_floor``, the highest one not above them."""
    at = points.withColumns({"i": voxel_index(F.col("x"), cell), "j": voxel_index(F.col("y"), cell)})
    f = floors.groupBy("i", "j").agg(F.array_sort(F.collect_set("z")).alias("zs_"))
    met = at.join(f, ["i", "j"], "left")
    return met.withColumns({"lowest_floor": F.array_min("zs_"), "own_floor": F.array_max(F.filter("zs_", lambda z: z <= F.col("z")))}).drop("zs_", "i", "j")


def column_cells(points: DataFrame, t: dict = STRUCTURE) -> DataFrame:
    """(i, j, coverage): cells covered from bottom to top."""
    return voxel.slice_coverage(points, t["column_cell"]).where(F.col("coverage") >= t["column_coverage"]).select("i", "j", "coverage")


def columns(points: DataFrame, walls: DataFrame | None = None, t: dict = STRUCTURE, near_wall: float = 0.3) -> DataFrame:
    """(component, i, j): column cells in components of a column's size, without those mostly beside a wall."""
    size = t["column_cell"]
    parts = stored(raster.grid_components(column_cells(points, t)), "columns")
    boxes = raster.component_boxes(parts, size).where(F.col("short").between(t["column_min"] - size, t["column_max"]) & (F.col("long") <= t["column_max"]) & (F.col("long") <= t["column_elongation"] * F.col("short")))
    out = parts.join(boxes.select("component"), "component", "left_semi")
    if walls is None:
        return out.select("component", "i", "j")
    centres = out.select(raster.cell_id().alias("pid"), ((F.col("i") + 0.5) * size).alias("x"), ((F.col("j") + 0.5) * size).alias("y"), "component", "i", "j")
    flat = walls.select("pid", "x", "y").withColumn("z", F.lit(0.0))
    beside = near(centres.withColumn("z", F.lit(0.0)), flat, near_wall).withColumn("beside_", F.lit(1.0))
    share = centres.join(beside, "pid", "left").groupBy("component").agg(F.avg(F.coalesce("beside_", F.lit(0.0))).alias("share")).where("share > 0.5")
    return out.join(share, "component", "left_anti").select("component", "i", "j")


def beams(ceiling: DataFrame, points: DataFrame, t: dict = STRUCTURE, top: float = 0.0) -> DataFrame:
    """(pid): points that hang in the strips left open in a ceiling at height ``top``."""
    size = t["beam_cell"]
    cells = ceiling.select(voxel_index(F.col("x"), size).alias("i"), voxel_index(F.col("y"), size).alias("j")).distinct().withColumn("level", F.lit(0))
    gaps = raster.holes(cells, "level").select("i", "j")
    parts = raster.grid_components(gaps)
    good = raster.strips(raster.component_boxes(parts, size), t["beam_min"], t["beam_max"], t["beam_length"], t["beam_elongation"])
    open_ = raster.dilate(parts.join(good.select("component"), "component", "left_semi"))
    hung = points.where(F.col("z").between(top - t["beam_depth"], top + 0.2)).withColumns({"i": voxel_index(F.col("x"), size), "j": voxel_index(F.col("y"), size)})
    return hung.join(open_, ["i", "j"], "left_semi").select("pid")


def protrusions(ceiling: DataFrame, t: dict = STRUCTURE, cell: float = 0.15) -> DataFrame:
    """(pid): ceiling points in small patches that hang below the local height; none if that were 40 % of the ceiling or more."""
    cells = stored(voxel.cells(ceiling, cell).select("i", "j", "mean_z"), "cells")
    local = raster.max_filter(cells, "mean_z", max(1, round(t["bump_window"] / cell / 2))).withColumnRenamed("mean_z", "local_")
    low = cells.join(local, ["i", "j"]).where(F.col("local_") - F.col("mean_z") >= t["bump_min"])
    parts = raster.grid_components(low)
    small = raster.component_boxes(parts, cell).where(F.col("long") <= t["bump_side"])
    patch = raster.dilate(parts.join(small.select("component"), "component", "left_semi"))
    at = ceiling.withColumns({"i": voxel_index(F.col("x"), cell), "j": voxel_index(F.col("y"), cell)}).join(low.select("i", "j"), ["i", "j"], "left_semi")
    out = stored(at.join(patch, ["i", "j"], "left_semi").select("pid"), "bumps")
    n, every = out.count(), ceiling.count()
    return out if 0 < n < 0.4 * every else out.limit(0)


def extract_structure(points: DataFrame, t: dict = STRUCTURE, voxel_size: float = 0.03) -> tuple[DataFrame, DataFrame, float, float]:
    """(points with label, accepted components, floor, ceiling): R21 as a composition.

    Points (pid, x, y, z, label, ...) of accepted horizontal components become PAVIMENTO
    or SOFFITTO by the evidence above and below, those of walls PARETE, then columns and
    beams. Protrusions of the ceiling go back to the pool. A plane needs as many points as
    its least area has voxels, and ``plane_points`` at least, whatever the cloud's size.
    """
    least = max(t["plane_points"], int(t["horizontal_area"] / max(voxel_size, 0.005) ** 2))
    planes, _ = peel_planes(points, t["plane_distance"], least, t["planes"], t["plane_cell"])
    span = points.agg(F.percentile_approx("z", F.lit(0.005), F.lit(20_000)).alias("a"), F.percentile_approx("z", F.lit(0.995), F.lit(20_000)).alias("b")).first()  # a sketch: no task holds all heights
    if not planes:
        return points, None, float(span.a or 0.0), float(span.b or 0.0)
    parts = stored(plane_components(points, planes, t), "parts")
    ok = stored(accept_components(parts, planes, span.a, span.b, t, t["part_points"]), "accepted")
    flats = ok.where("kind = 'horizontal'").select((F.col("plane_id") * F.lit(1 << 32) + F.pmod(F.xxhash64("part"), F.lit(1 << 31))).alias("plane_id"), "z", "x0", "x1", "y0", "y1", F.col("plane_id").alias("of"), "part")
    kinds = horizontal_kind(points, flats.drop("of", "part"), middle=(span.a + span.b) / 2)
    typed = stored(flats.join(kinds, "plane_id").select(F.col("of").alias("plane_id"), "part", F.col("kind").alias("sort"), "z"), "typed")
    of_plane = points.sparkSession.createDataFrame([(p["plane_id"], *map(float, p["plane"])) for p in planes], "plane_id int, a double, b double, c double, d double")
    ok = stored(ok.join(F.broadcast(of_plane), "plane_id").join(typed.select("plane_id", "part", "sort"), ["plane_id", "part"], "left"), "planes")
    code = F.when(F.col("kind") == "wall", CODE["PARETE"]).when(F.col("sort") == "floor", CODE["PAVIMENTO"]).otherwise(CODE["SOFFITTO"])
    found = parts.join(ok.select("plane_id", "part", "kind", "sort"), ["plane_id", "part"]).select("pid", code.alias("new_"))
    found = stored(found.groupBy("pid").agg(F.min("new_").alias("new_")), "found")
    ends = typed.agg(F.max(F.when(F.col("sort") == "ceiling", F.col("z"))).alias("c"), F.min(F.when(F.col("sort") == "floor", F.col("z"))).alias("f")).first()
    floor, ceiling = float(ends.f if ends.f is not None else span.a), float(ends.c if ends.c is not None else span.b)
    out = points.join(found, "pid", "left").withColumn("label", F.coalesce("new_", "label").cast("smallint")).drop("new_")
    out = stored(out, "planes")
    roof = out.where(F.col("label") == CODE["SOFFITTO"])
    bumps = protrusions(roof, t).withColumn("bump_", F.lit(True))
    walls = out.where(F.col("label") == CODE["PARETE"])
    pool = out.where(F.col("label") == CODE["MEP_GENERICO"])
    cells = columns(pool, walls, t).select("i", "j").distinct()
    size = t["column_cell"]
    col = pool.withColumns({"i": voxel_index(F.col("x"), size), "j": voxel_index(F.col("y"), size)}).join(cells, ["i", "j"], "left_semi").select("pid", F.lit(True).alias("column_"))
    beam = beams(roof, pool, t, ceiling).withColumn("beam_", F.lit(True))
    out = out.join(bumps, "pid", "left").join(col, "pid", "left").join(beam, "pid", "left")
    label = F.when(F.col("bump_"), CODE["MEP_GENERICO"]).when(F.col("column_"), CODE["PILASTRO"]).when(F.col("beam_"), CODE["TRAVE"]).otherwise(F.col("label"))
    return stored(out.withColumn("label", label.cast("smallint")).drop("bump_", "column_", "beam_"), "structure"), ok, floor, ceiling
