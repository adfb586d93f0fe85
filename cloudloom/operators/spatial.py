"""Joins in space: a grid turns a distance into an equality on cells.

The cell is as large as the radius, so all partners of a point lie in its own cell or in
one that touches it. One side is repeated for those cells (9 in the plane, 27 in space)
and the join is an equi-join, which adaptive execution may split where a cell is dense.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import squared_distance
from .tables import stored


def _named(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in columns))


def grid_join(left: DataFrame, right: DataFrame, radius: float, axes: str = "xyz", keep: tuple[list[str], list[str]] | None = None, bands: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a_*, b_*) of ``left`` and ``right`` at most ``radius`` apart, with ``d2``. Rows with a null coordinate pair with none.

    ``keep`` names the columns of each side that are wanted; all by default. ``bands`` are
    columns of whole numbers in which the two may differ by one at most.
    """
    lc, rc = keep or (left.columns, right.columns)
    a = _named(left, "a_", list(dict.fromkeys([*lc, *axes])))
    b = _named(right, "b_", list(dict.fromkeys([*rc, *axes])))
    size = F.lit(float(radius))
    for c in axes:
        b = b.withColumn(f"cell_{c}", F.floor(F.col(f"b_{c}") / size))
    offsets = F.array(*(F.struct(*(F.lit(o).alias(c) for o, c in zip(off, axes, strict=True))) for off in product((-1, 0, 1), repeat=len(axes))))
    a = a.withColumn("o_", F.explode(offsets))
    for c in axes:
        a = a.withColumn(f"cell_{c}", F.floor(F.col(f"a_{c}") / size) + F.col(f"o_.{c}"))
    for c in bands:
        a = a.withColumn(f"cell_{c}", F.explode(F.array(*(F.col(f"a_{c}") + k for k in (-1, 0, 1)))))
        b = b.withColumn(f"cell_{c}", F.col(f"b_{c}"))
    cells = [f"cell_{c}" for c in (*axes, *bands)]
    pairs = a.drop("o_").join(b, cells).drop(*cells)
    pairs = pairs.withColumn("d2", squared_distance("a_", "b_", axes)).where(F.col("d2") <= F.lit(float(radius) * float(radius)))
    return pairs


LEVELS = 10  # the least radius that is tried is the wanted one halved so many times
TIGHTER = 3  # steps from a radius to its half


def _by_level(points: DataFrame, others: DataFrame, radius: float, levels: list[int], pid: str, keep: list[str]) -> DataFrame:
    """Pairs (a_*, b_*, d2) at most as far apart as the ``reach2_`` of ``points``, which is within the radius of their ``level_``: the wanted one halved ``level_`` times."""
    size = lambda c: F.lit(float(radius)) / F.pow(F.lit(2.0), F.col(c))
    a = points.select(*(F.col(c).alias(f"a_{c}") for c in (pid, *"xyz", "reach2_")), "level_")
    around = F.array(*(F.struct(*(F.lit(o).alias(c) for o, c in zip(off, "xyz", strict=True))) for off in product((-1, 0, 1), repeat=3)))
    a = a.withColumn("o_", F.explode(around))
    b = _named(others, "b_", list(dict.fromkeys([*keep, pid, *"xyz"]))).withColumn("level_", F.explode(F.array(*map(F.lit, levels))))
    a = a.withColumns({f"cell_{c}": F.floor(F.col(f"a_{c}") / size("level_")) + F.col(f"o_.{c}") for c in "xyz"}).drop("o_")
    b = b.withColumns({f"cell_{c}": F.floor(F.col(f"b_{c}") / size("level_")) for c in "xyz"})
    keys = ["level_", *(f"cell_{c}" for c in "xyz")]
    pairs = a.join(b, keys).drop(*keys[1:]).withColumn("d2", squared_distance("a_", "b_"))
    return pairs.where(F.col("d2") <= F.col("a_reach2_"))


def nearest_few(points: DataFrame, others: DataFrame, k: int, radius: float, pid: str = "pid", keep: list[str] | None = None, own: bool = False) -> DataFrame:
    """Pairs (a_pid, b_pid, columns ``keep`` as b_*, d2, nth_) of each point and its ``k`` nearest of ``others`` within ``radius``, ties to the smaller id.

    Without ``own`` a row of the same id does not count. Where points are dense a smaller
    radius holds ``k`` of them: each point begins with the least one whose cell holds about
    as many, and doubles it until they are in reach or it is the wanted one. So pairs follow
    ``k``, not what a ball of the wanted radius holds.
    """
    keep = list(dict.fromkeys([pid, *(keep or [])]))
    order = Window.partitionBy(f"a_{pid}").orderBy("d2", f"b_{pid}")
    self_ = F.lit(True) if own else F.col(f"a_{pid}") != F.col(f"b_{pid}")
    columns = [f"a_{pid}", *(f"b_{c}" for c in keep), "d2"]
    level = F.explode(F.array(*map(F.lit, range(1, LEVELS + 1)))).alias("level_")
    cell = [F.floor(F.col(c) / (F.lit(float(radius)) / F.pow(F.lit(2.0), F.col("level_")))).alias(f"cell_{c}") for c in "xyz"]
    keys = ["level_", *(f"cell_{c}" for c in "xyz")]
    full = others.select(*"xyz", level).select("level_", *cell).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") * 4 >= k).select(*keys)
    met = points.select(pid, *"xyz", level).select(pid, "level_", *cell).join(full, keys).groupBy(pid).agg(F.max("level_").alias("level_"))
    met = stored(met, "levels")
    rest = points.select(pid, *"xyz").join(met, pid, "left").withColumn("level_", F.coalesce("level_", F.lit(0)))
    done = rest.where("level_ = 0").withColumn("reach2_", F.lit(float(radius) * float(radius)))
    rest, settled = rest.where("level_ > 0"), []
    while levels := sorted(r[0] for r in rest.select("level_").distinct().collect()):
        asked = rest.withColumn("reach2_", F.pow(F.lit(float(radius)) / F.pow(F.lit(2.0), F.col("level_")), F.lit(2)))
        pairs = _by_level(asked, others, radius, levels, pid, [pid]).where(self_)
        steps = [F.col("a_reach2_") * F.lit(2.0 ** (-2 * m / TIGHTER)) for m in range(TIGHTER)]
        counts = pairs.groupBy(F.col(f"a_{pid}").alias(pid)).agg(*(F.count_if(F.col("d2") <= r).alias(f"n{m}_") for m, r in enumerate(steps)), F.max("a_reach2_").alias("a_reach2_"))
        reach = F.coalesce(*(F.when(F.col(f"n{m}_") >= k, steps[m]) for m in reversed(range(TIGHTER))))
        tried = stored(rest.join(counts.select(pid, reach.alias("reach2_")), pid, "left"), "tried")
        settled.append(tried.where("reach2_ is not null"))
        rest = tried.where("reach2_ is null").drop("reach2_").withColumn("level_", F.col("level_") - 1)
        done = done.unionByName(rest.where("level_ = 0").withColumn("reach2_", F.lit(float(radius) * float(radius))))
        rest = rest.where("level_ > 0")
    if not settled:
        pairs = grid_join(points, others, radius, keep=([pid], keep)).where(self_).select(*columns)
    else:
        every = done
        for some in settled:
            every = every.unionByName(some)
        every = stored(every, "reach")
        used = sorted(r[0] for r in every.select("level_").distinct().collect())
        pairs = _by_level(every, others, radius, used, pid, keep).where(self_).select(*columns)
    return pairs.withColumn("nth_", F.row_number().over(order)).where(F.col("nth_") <= k)


def knn(points: DataFrame, k: int, radius: float, pid: str = "pid", others: DataFrame | None = None) -> DataFrame:
    """(src, dst, d2, rank): the ``k`` nearest within ``radius``, ties to the smaller id. Without ``others`` a point is not its own neighbour."""
    pairs = nearest_few(points, points if others is None else others, k, radius, pid, own=others is not None)
    return pairs.select(F.col(f"a_{pid}").alias("src"), F.col(f"b_{pid}").alias("dst"), "d2", F.col("nth_").alias("rank"))


def radius_count(points: DataFrame, radius: float, pid: str = "pid", others: DataFrame | None = None) -> DataFrame:
    """(pid, n): how many of ``others`` (or of the other points) lie within ``radius``; points without any have 0."""
    right = points if others is None else others
    pairs = grid_join(points, right, radius, keep=([pid], [pid]))
    if others is None:
        pairs = pairs.where(F.col(f"a_{pid}") != F.col(f"b_{pid}"))
    counted = pairs.groupBy(F.col(f"a_{pid}").alias(pid)).agg(F.count(F.lit(1)).alias("n"))
    return points.select(pid).join(counted, pid, "left").select(pid, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def evidence_gate(points: DataFrame, voxel: float, factor: float = 2.5, least: int = 4, pid: str = "pid") -> DataFrame:
    """``points`` that have at least ``least`` others within ``factor`` voxels."""
    enough = radius_count(points, factor * voxel, pid).where(F.col("n") >= least).select(pid)
    return points.join(enough, pid, "left_semi")


def pairs_within(points: DataFrame, radius: float, pid: str = "pid") -> DataFrame:
    """(src, dst, d2) with src < dst: every unordered pair at most ``radius`` apart."""
    pairs = grid_join(points, points, radius, keep=([pid], [pid])).where(F.col(f"a_{pid}") < F.col(f"b_{pid}"))
    return pairs.select(F.col(f"a_{pid}").alias("src"), F.col(f"b_{pid}").alias("dst"), "d2")


def near(points: DataFrame, others: DataFrame, radius: float, pid: str = "pid", where=None) -> DataFrame:
    """(pid) of ``points`` with one of ``others`` within ``radius``; ``where`` is a further condition on a_* and b_*."""
    pairs = grid_join(points, others, radius)
    if where is not None:
        pairs = pairs.where(where)
    return pairs.select(F.col(f"a_{pid}").alias(pid)).distinct()


def nearest(points: DataFrame, others: DataFrame, first_radius: float, pid: str = "pid", axes: str = "xyz", max_radius: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """(pid, near_*, d2): the nearest of ``others`` to each point, ties to the smaller id of ``others``.

    Without ``max_radius`` there is no cap: points that meet nothing are tried again with
    the radius doubled, until none is left. Each round only holds the points still
    unmatched, and ends when the radius covers both sides' extent. Points get no row if
    ``others`` is empty or nothing is within ``max_radius``.
    """
    keep = keep or [pid]
    left = points.select(pid, *axes)
    if max_radius is None:
        extent = [F.max(c) for c in axes] + [F.min(c) for c in axes]
        low_high = left.unionByName(others.select(F.lit(None).cast(left.schema[pid].dataType).alias(pid), *axes)).agg(*(e.alias(f"e{i}") for i, e in enumerate(extent))).first()
        if low_high[0] is None:
            max_radius = first_radius
        else:
            n = len(axes)
            max_radius = sum((low_high[i] - low_high[n + i]) ** 2 for i in range(n)) ** 0.5 * 1.000001 + first_radius
    found, radius = [], float(first_radius)
    while True:
        radius = min(radius, max_radius)
        pairs = grid_join(left, others, radius, axes, keep=([pid], list(dict.fromkeys([*keep, pid]))))
        best = pairs.groupBy(F.col(f"a_{pid}").alias(pid)).agg(F.min(F.struct("d2", F.col(f"b_{pid}").alias("id"), *(F.col(f"b_{c}").alias(f"near_{c}") for c in keep))).alias("best"))
        best = best.select(pid, *(F.col(f"best.near_{c}") for c in keep), F.col("best.d2"))
        if radius >= max_radius:
            found.append(best)
            break
        best = stored(best, "nearest")
        found.append(best)
        left = stored(left.join(best.select(pid), pid, "left_anti"), "unmatched")
        if left.isEmpty():
            break
        radius *= 2
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def propagate_labels(points: DataFrame, reduced: DataFrame, first_radius: float, pid: str = "pid", label: str = "label") -> DataFrame:
    """(pid, label, d2): each full-resolution point takes the label of the nearest reduced point, however far."""
    got = nearest(points, reduced, first_radius, pid, keep=[label])
    return got.select(pid, F.col(f"near_{label}").alias(label), "d2")


def inside(box: tuple[float, ...], margin: float = 0.0) -> Column:
    """Whether a point lies in the closed box (x0, y0, z0, x1, y1, z1) widened by ``margin``."""
    x0, y0, z0, x1, y1, z1 = box
    keep = F.lit(True)
    for c, low, high in (("x", x0, x1), ("y", y0, y1), ("z", z0, z1)):
        keep = keep & F.col(c).between(low - margin, high + margin)
    return keep


def crop(points: DataFrame, box: tuple[float, ...], margin: float = 0.0) -> DataFrame:
    """Points :func:`inside` the box; the comparison reaches the scan."""
    return points.where(inside(box, margin))


def boxes_overlap(left: DataFrame, right: DataFrame, cell: float, margin: float = 0.0) -> DataFrame:
    """Pairs (a_*, b_*) whose xy boxes (x0, y0, x1, y1) meet once ``right``'s are widened by ``margin``.

    Boxes are dealt to the cells they cover, so the join is on cells; a pair is taken in
    the first cell that both cover.
    """
    a = _named(left, "a_", left.columns)
    b = _named(right, "b_", right.columns)
    c = F.lit(float(cell))

    def cells(df: DataFrame, p: str, m: float) -> DataFrame:
        for axis in "xy":
            df = df.withColumn(f"{p}c{axis}0", F.floor((F.col(f"{p}{axis}0") - m) / c)).withColumn(f"{p}c{axis}1", F.floor((F.col(f"{p}{axis}1") + m) / c))
        df = df.withColumn("cx", F.explode(F.sequence(f"{p}cx0", f"{p}cx1")))
        return df.withColumn("cy", F.explode(F.sequence(f"{p}cy0", f"{p}cy1")))

    met = cells(a, "a_", 0.0).join(cells(b, "b_", margin), ["cx", "cy"])
    first = (F.col("cx") == F.greatest("a_cx0", "b_cx0")) & (F.col("cy") == F.greatest("a_cy0", "b_cy0"))
    over = (F.col("a_x0") <= F.col("b_x1") + margin) & (F.col("a_x1") >= F.col("b_x0") - margin) & (F.col("a_y0") <= F.col("b_y1") + margin) & (F.col("a_y1") >= F.col("b_y0") - margin)
    return met.where(first & over).select(*a.columns, *b.columns)
