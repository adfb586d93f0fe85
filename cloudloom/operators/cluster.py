"""Clusters by surface continuity, and the splitting of clusters that hold several things."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import CLUSTER
from . import features, fits
from .graph import connected_components
from .spatial import nearest, nearest_few
from .tables import stored


def neighbour_edges(points: DataFrame, eps: float, t: dict = CLUSTER) -> DataFrame:
    """(src, dst, smooth, concave): edges to the nearest points that no jump along the normal and no change of colour cuts.

    smooth: normals within an angle. concave: the points lie in front of each other's surface. Points have pid, x, y, z, nx, ny, nz and perhaps r, g, b.
    """
    columns = ["pid", "x", "y", "z", "nx", "ny", "nz", *(c for c in "rgb" if c in points.columns)]
    pairs = nearest_few(points, points, t["neighbours"], eps, keep=columns)
    pairs = pairs.join(points.select(*(F.col(c).alias(f"a_{c}") for c in columns)), "a_pid")
    d = [F.col(f"b_{c}") - F.col(f"a_{c}") for c in "xyz"]
    na, nb = ([F.col(f"{p}_n{c}") for c in "xyz"] for p in "ab")
    dot = lambda u, v: sum((x * y for x, y in zip(u, v, strict=True)), F.lit(0.0))
    jump = F.greatest(F.abs(dot(d, na)), F.abs(dot(d, nb)))
    keep = F.coalesce(jump <= t["jump"], F.lit(True))
    if "r" in points.columns:
        c2 = sum(((F.col(f"a_{c}").cast("double") - F.col(f"b_{c}")) * (F.col(f"a_{c}").cast("double") - F.col(f"b_{c}")) for c in "rgb"), F.lit(0.0))
        keep = keep & F.coalesce(c2 <= t["colour"] ** 2, F.lit(True))
    smooth = F.coalesce(F.abs(dot(na, nb)) >= math.cos(math.radians(t["smooth_degrees"])), F.lit(False))
    size = F.sqrt(F.greatest(F.col("d2"), F.lit(1e-12)))
    concave = F.coalesce((dot(d, na) / size > t["concave"]) & (dot(d, nb) / size < -t["concave"]), F.lit(False))
    out = pairs.where(keep).select(F.least("a_pid", "b_pid").alias("src"), F.greatest("a_pid", "b_pid").alias("dst"), smooth.alias("smooth"), concave.alias("concave"))
    return out.groupBy("src", "dst").agg(F.max("smooth").alias("smooth"), F.max("concave").alias("concave"))


def outward_normals(points: DataFrame, t: dict = CLUSTER) -> DataFrame:
    """``points`` with normals turned to the freer side: where a probe at ``t['probe']`` is farther from the cloud."""
    probe = lambda s: points.where("nx is not null").select("pid", *((F.col(c) + s * t["probe"] * F.col(f"n{c}")).alias(c) for c in "xyz"))
    up = nearest(probe(1.0), points, t["probe"], max_radius=4 * t["probe"]).select("pid", F.col("d2").alias("up_"))
    down = nearest(probe(-1.0), points, t["probe"], max_radius=4 * t["probe"]).select("pid", F.col("d2").alias("down_"))
    met = points.join(up, "pid", "left").join(down, "pid", "left")
    far = lambda c: F.coalesce(c, F.lit(1e9))
    turn = F.when(far("down_") > far("up_"), -1.0).otherwise(1.0)
    return met.withColumns({f"n{c}": F.col(f"n{c}") * turn for c in "xyz"}).drop("up_", "down_")


def contact_votes(edges: DataFrame, patch: DataFrame, convex_share: float = 0.5) -> DataFrame:
    """(p, q, contacts, concave, merge): each pair of patches in contact, and whether enough of its contacts are not concave. ``patch`` has pid, patch."""
    a, b = patch.select(F.col("pid").alias("src"), F.col("patch").alias("pa")), patch.select(F.col("pid").alias("dst"), F.col("patch").alias("pb"))
    met = edges.join(a, "src").join(b, "dst").where("pa <> pb")
    votes = met.groupBy(F.least("pa", "pb").alias("p"), F.greatest("pa", "pb").alias("q")).agg(F.count(F.lit(1)).alias("contacts"), F.sum(F.col("concave").cast("int")).alias("concave"))
    return votes.withColumn("merge", 1 - F.col("concave") / F.col("contacts") >= convex_share)


def semantic_veto(votes: DataFrame, patches: DataFrame, area: float = 1.5) -> DataFrame:
    """``votes`` without pairs that cannot be one thing: a cylinder with a large plane or an irregular patch, an irregular patch with a large plane. ``patches`` has patch, family, area."""
    side = lambda k: patches.select(F.col("patch").alias(k), F.col("family").alias(f"{k}_family"), F.col("area").alias(f"{k}_area"))
    met = votes.join(side("p"), "p").join(side("q"), "q")
    plane = lambda k: F.col(f"{k}_family").isin("horizontal", "vertical") & (F.col(f"{k}_area") >= area)
    is_ = lambda k, f: F.col(f"{k}_family") == f
    odd = lambda k: is_(k, "irregular") & (F.col(f"{k}_area") >= area / 4)
    veto = F.lit(False)
    for a, b in (("p", "q"), ("q", "p")):
        veto = veto | (is_(a, "cylindrical") & (plane(b) | odd(b))) | (is_(a, "irregular") & plane(b))
    return met.where(~veto).select(*votes.columns)


def strongest_contact(votes: DataFrame, small: DataFrame) -> DataFrame:
    """(patch, into): each small patch's neighbour with the most contacts; of equal ones the largest number."""
    both = votes.select(F.col("p").alias("patch"), F.col("q").alias("into"), "contacts").unionByName(votes.select(F.col("q").alias("patch"), F.col("p").alias("into"), "contacts"))
    met = both.join(small.select("patch"), "patch", "left_semi").join(small.select(F.col("patch").alias("into")), "into", "left_anti")
    return met.groupBy("patch").agg(F.max_by("into", F.struct("contacts", "into")).alias("into"))


def grow(points: DataFrame, voxel: float, t: dict = CLUSTER) -> DataFrame:
    """(pid, cluster_id): clusters numbered from 0 by their least point, null for noise.

    Normals, graph, smooth patches, families, convexity votes, veto, small patches to their
    strongest neighbour, components, size.
    """
    eps = max(t["eps"], 2.5 * voxel)
    normals = features.local_normals(points, max(2 * voxel, 0.04), 20)
    points = stored(points.drop("nx", "ny", "nz").join(normals, "pid", "left"), "normals")
    points = stored(outward_normals(points, t), "outward")
    edges = stored(neighbour_edges(points, eps, t), "edges")
    patch = connected_components(edges.where("smooth")).select(F.col("node").alias("pid"), F.col("component").alias("patch"))
    patch = stored(points.select("pid").join(patch, "pid", "left").select("pid", F.coalesce("patch", "pid").alias("patch")), "patches")
    held = points.join(patch, "pid")
    family = features.patch_family(held, ["patch"], t["irregular"], t["cylindrical"])
    from .voxel import covered_area

    about = stored(family.join(covered_area(held, max(voxel, 0.05), ["patch"]), "patch"), "about")
    votes = stored(contact_votes(edges, patch, t["convex_share"]), "votes")
    large = about.where(F.col("n") >= t["patch"])
    merges = semantic_veto(votes.where("merge"), about, t["mixed_area"]).join(large.select(F.col("patch").alias("p")), "p").join(large.select(F.col("patch").alias("q")), "q").select("p", "q")
    small = about.where(F.col("n") < t["patch"])
    joined = merges.unionByName(strongest_contact(votes, small).select(F.col("patch").alias("p"), F.col("into").alias("q")))
    alone = about.select(F.col("patch").alias("p"), F.col("patch").alias("q"))
    groups = connected_components(joined.unionByName(alone), "p", "q")
    named = patch.join(groups, F.col("patch") == F.col("node")).select("pid", F.col("component").alias("root"))
    sizes = named.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= t["least"])
    number = sizes.withColumn("cluster_id", F.row_number().over(Window.orderBy("root")) - 1)  # a row a cluster
    return points.select("pid").join(named, "pid", "left").join(number.select("root", "cluster_id"), "root", "left").select("pid", F.col("cluster_id").cast("long").alias("cluster_id"))


def split_directions(points: DataFrame, t: dict = CLUSTER, by: str = "cluster_id") -> DataFrame:
    """(pid, by, part): R18 for each cluster of ``points`` with normals."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        n = pdf[["nx", "ny", "nz"]].to_numpy(float)
        part = fits.split_by_direction(pdf[["x", "y", "z"]].to_numpy(float), n, t["direction_degrees"], t["direction_points"], t["direction_share"], t["directions"], t["sphericity"], t["eps"])
        return pd.DataFrame({"pid": pdf["pid"].to_numpy(), by: pdf[by].to_numpy(), "part": part})

    return points.select("pid", by, "x", "y", "z", "nx", "ny", "nz").groupBy(by).applyInPandas(run, f"pid long, {by} long, part int")


def split_giants(points: DataFrame, ceiling: float, floors: list[float], t: dict = CLUSTER, by: str = "cluster_id") -> DataFrame:
    """(pid, by, part): clusters longer than ``giant`` in plan are cut: the band under the ceiling by distance, the rest by level and erosion. -1 is a scrap.

    Erosion is tried with its radius, and with twice and four times it, while one block stays larger than ``giant``.
    A task holds a cluster's places: points of the same coordinates are one, with their number.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_")
        many = pdf["n_"].to_numpy()
        p = pdf[["x", "y", "z"]].to_numpy(float)
        part = np.zeros(len(p), int)
        if len(p) and np.ptp(p[:, :2], axis=0).max() > t["giant"]:
            part[:] = -1
            level = np.searchsorted(np.array(sorted(floors)) + 0.15, p[:, 2])
            level[p[:, 2] >= ceiling - t["ceiling_band"]] = len(floors) + 1
            at = 0
            for k in np.unique(level):
                mine = np.flatnonzero(level == k)
                if k == len(floors) + 1:
                    sub = fits.components_within(p[mine], t["eps"] * 2)
                    small = np.bincount(sub, many[mine])[sub] < t["least"]
                else:
                    sub, radius = np.zeros(len(mine), int), t["erosion"]
                    if np.ptp(p[mine, :2], axis=0).max() >= t["erosion_side"]:
                        while radius <= 4 * t["erosion"]:
                            sub = fits.erosion_split(p[mine], radius, t["erosion_cell"], t["instance"], many[mine])
                            widest = max((np.ptp(p[mine[sub == s], :2], axis=0).max() for s in np.unique(sub[sub >= 0])), default=0)
                            if widest <= t["giant"]:
                                break
                            radius *= 2
                    small = sub < 0
                part[mine] = np.where(small, -1, sub + at)
                at += int(sub.max()) + 1 if len(sub) else 0
        return pdf[[by, "x", "y", "z"]].assign(part=part)

    kind = {f.name: f.dataType.simpleString() for f in points.schema}
    place = [by, "x", "y", "z"]
    places = points.groupBy(*place).agg(F.min("pid").alias("first_"), F.count(F.lit(1)).alias("n_"))
    cut = places.groupBy(by).applyInPandas(run, ", ".join([*(f"{c} {kind[c]}" for c in place), "part int"]))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in place]
    return points.alias("p").join(cut.alias("c"), same).select(F.col("p.pid").cast("long").alias("pid"), F.col(f"p.{by}").cast("long").alias(by), "c.part")
