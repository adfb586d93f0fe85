"""From a cloud to labelled points and an instance table: an ordered list of label transforms.

Structure goes before reflections, wall completion, evidence, rules, context, colour,
models, pins and a second labelling; each step is written to the shared folder where the
next ones read it more than once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import voxel_index
from ..operators import cluster, context, features, ordered, review, rules, spatial, structure, voxel
from ..operators.tables import stored
from .model import CODE, Config

GENERIC = CODE["MEP_GENERICO"]


@dataclass
class Result:
    """points: pid, label, instance_id of the full cloud. reduced: the voxelised cloud with the same. instances: the feature table with label and instance_id."""

    points: DataFrame
    reduced: DataFrame
    instances: DataFrame
    planes: DataFrame | None
    floor: float
    ceiling: float


def preprocess(points: DataFrame, config: Config) -> DataFrame:
    """The reduced cloud with normals: pid (the voxel's key), x, y, z, n, nx, ny, nz and colours."""
    size = config.preprocess["voxel"]
    reduced = stored(voxel.voxel_downsample(points, size).withColumnRenamed("rid", "pid"), "voxels")
    kept = stored(voxel.drop_outliers(reduced, 6 * max(size, 0.01), config.preprocess["neighbours"], config.preprocess["std"]), "kept")
    normals = features.local_normals(kept, max(4 * size, 0.06), 30)
    return stored(kept.join(normals, "pid", "left"), "reduced")


def split_clusters(points: DataFrame, ceiling: float, floors: list[float], config: Config) -> DataFrame:
    """(pid, cluster_id): giants, then runs between gaps, then directions; scraps and small runs lose their cluster."""
    t = config.cluster

    def renumber(df: DataFrame, part: str) -> DataFrame:
        every = df.where(F.col(part) >= 0).groupBy("cluster_id", part).agg(F.count(F.lit(1)).alias("size_"))
        number = every.withColumn("new_", F.row_number().over(Window.orderBy("cluster_id", part)).cast("long")).drop("size_")  # a row a part
        return df.join(number, ["cluster_id", part], "left").select("pid", F.col("new_").alias("cluster_id"))

    got = stored(renumber(cluster.split_giants(points, ceiling, floors, t), "part").where("cluster_id is not null"), "giants")
    held = points.drop("cluster_id").join(got, "pid")
    eigen = features.with_eigen(features.scatter_sums(held, ["cluster_id"]))
    sides = features.box_sides(held, eigen, ["cluster_id"]).where(F.element_at("dims", 1).between(0.8, 12.0) & (F.element_at("dims", 2) <= t["gap_section"]))
    along = held.join(eigen.join(sides.select("cluster_id"), "cluster_id", "left_semi").select("cluster_id", "eigen"), "cluster_id")
    along = along.withColumn("t_", sum((F.col(c) * F.element_at("eigen.e1", k) for k, c in zip((1, 2, 3), "xyz", strict=True)), F.lit(0.0)))
    cut = ordered.segments_by_gaps(along.select("pid", "cluster_id", "t_"), ["cluster_id"], "t_", 0.05, int(t["gap"] / 0.05 + 0.5), t["segments"], t["least"])
    whole = cut.groupBy("cluster_id").agg(F.count("segment").alias("in_runs"))
    cut = cut.join(whole, "cluster_id").select("pid", F.when(F.col("in_runs") > 0, F.coalesce("segment", F.lit(-1))).otherwise(0).alias("part"))
    gaps = held.select("pid", "cluster_id").join(cut, "pid", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    got = stored(renumber(gaps, "part").where("cluster_id is not null"), "gaps")
    return stored(renumber(cluster.split_directions(points.drop("cluster_id").join(got, "pid"), t), "part"), "parts")


def local_heights(feats: DataFrame, points: DataFrame, planes: DataFrame | None, floors: DataFrame | None, floor: float, ceiling: float, t: dict) -> DataFrame:
    """``feats`` with to_ceiling and to_floor of each cluster of ``points``.

    Over a cluster: the lowest accepted ceiling, else the lowest floor above it, else the
    scene's ceiling. Under it: the highest accepted floor, else what the map ``floors``
    (see :func:`structure.floor_map`) has for the cluster's place, of the highest level
    that is not above it, else the scene's floor.
    """
    if planes is None:
        return feats.withColumns({"to_ceiling": F.lit(ceiling) - F.col("top"), "to_floor": F.col("bottom") - F.lit(floor)})
    box = points.groupBy("cluster_id").agg(*(f(c).alias(f"{c}{e}") for c in "xy" for e, f in ((0, F.min), (1, F.max))), F.avg("x").alias("cx_"), F.avg("y").alias("cy_"))
    box = feats.select("cluster_id", "top", "bottom").join(box, "cluster_id")
    flat = planes.where("kind = 'horizontal'").select("z", "sort", "x0", "x1", "y0", "y1")
    met = spatial.boxes_overlap(box.drop("cx_", "cy_"), flat, 4.0, 0.5)
    over, under = F.col("b_z") >= F.col("a_top") - 0.3, (F.col("b_z") <= F.col("a_bottom") + 0.3) & (F.col("b_sort") == "floor")
    got = met.groupBy(F.col("a_cluster_id").alias("cluster_id")).agg(
        F.min(F.when(over & (F.col("b_sort") == "ceiling"), F.col("b_z"))).alias("c_"), F.min(F.when(over & (F.col("b_sort") == "floor"), F.col("b_z"))).alias("up_"),
        F.max(F.when(under, F.col("b_z"))).alias("f_"),
    )
    out = feats.join(got, "cluster_id", "left")
    mapped = F.lit(None).cast("double")
    if floors is not None:
        at = box.select("cluster_id", "bottom", voxel_index(F.col("cx_"), t["floor_cell"]).alias("i"), voxel_index(F.col("cy_"), t["floor_cell"]).alias("j"))
        held = at.join(structure.fill_map(floors, at, t["floor_cell"], t["fill_radius"]), ["i", "j"]).where(F.col("z") <= F.col("bottom") + 0.3)
        out = out.join(held.groupBy("cluster_id").agg(F.max_by("z", "level").alias("m_")), "cluster_id", "left")
        mapped = F.col("m_")
    out = out.withColumns({"to_ceiling": F.coalesce("c_", "up_", F.lit(ceiling)) - F.col("top"), "to_floor": F.col("bottom") - F.coalesce(F.col("f_"), mapped, F.lit(floor))})
    return out.drop("c_", "up_", "f_", "m_")


def detach_appendices(points: DataFrame, instances: DataFrame, config: Config, voxel_size: float, heights) -> DataFrame:
    """(pid, host, cluster_id): points off the surface of a fitted cylinder, in clusters of their own; noise has none.

    A cluster is tried whatever its class, if its fit is a pipe's or duct's and the points
    off it are a part of it; it counts only if what remains is a pipe or a round duct by
    the rules, else nothing is detached. ``heights`` gives features their local heights.
    New numbers follow the old.
    """
    from ..operators.fits import cylinder_residuals
    from ..operators.graph import dbscan

    t, c = config.rules, lambda name: F.col(f"cylinder.{name}")
    fits = instances.where(
        c("valid") & (c("inliers") >= 0.5) & (c("radial") >= 0.5) & (c("section") >= t["section"]) & (c("normals") <= t["normals"])
        & (c("length") >= t["cylinder_length"]) & (c("radius") <= t["duct_radius"])
    )
    off = cylinder_residuals(points, fits.select("cluster_id", "cylinder"), "cluster_id").join(fits.select("cluster_id", c("radius").alias("rad_"), F.col("n").alias("all_")), "cluster_id")
    off = off.where(F.col("residual") > F.greatest(F.lit(0.03), 0.5 * F.col("rad_")))
    least = max(config.cluster["least"], 10)
    enough = off.groupBy("cluster_id", "all_").agg(F.count(F.lit(1)).alias("out_")).where((F.col("out_") >= least) & (F.col("out_") < 0.5 * F.col("all_")))
    off = stored(off.join(enough.select("cluster_id"), "cluster_id", "left_semi").select("pid", "x", "y", "z", "cluster_id"), "off")
    if off.isEmpty():
        return off.select("pid", F.col("cluster_id").alias("host"), "cluster_id")
    core = points.join(off.select("cluster_id").distinct(), "cluster_id", "left_semi").join(off.select("pid"), "pid", "left_anti")
    core = stored(core, "cores")
    again = rules.classify(heights(features.build_features(core, voxel_size), core), config.rules, config.excluded, config.cluster["instance"])
    good = stored(again.where(F.col("label").isin(CODE["TUBAZIONE"], CODE["CONDOTTA_CIRCOLARE"])).select("cluster_id"), "true_cores")
    off = stored(off.join(good, "cluster_id", "left_semi"), "detached")
    parts = dbscan(off, max(config.cluster["eps"], 2.5 * voxel_size), least, within="cluster_id").withColumnRenamed("cluster_id", "part")
    base = instances.agg(F.max("cluster_id")).first()[0] or 0
    number = parts.where("part is not null").select("part").distinct().withColumn("new_", F.row_number().over(Window.orderBy("part")) + F.lit(base))  # a row a part
    return off.select("pid", F.col("cluster_id").alias("host")).join(parts, "pid").join(number, "part", "left").select("pid", "host", F.col("new_").cast("long").alias("cluster_id"))


def segment(points: DataFrame, config: Config | None = None, models: DataFrame | None = None, confirmations: DataFrame | None = None, rejections: DataFrame | None = None, guide=(), other_labels: DataFrame | None = None) -> Result:
    """Label every point of ``points`` (pid, x, y, z[, r, g, b]).

    ``models``, ``confirmations`` and ``rejections`` are signature tables (see
    :mod:`review`), ``guide`` the colour guide, ``other_labels`` (pid of the reduced cloud,
    dl_label) a second labelling that only fills generic points.
    """
    config = config or Config()
    size = config.preprocess["voxel"]
    cloud = preprocess(points, config).withColumn("label", F.lit(GENERIC).cast("smallint"))
    cloud, planes, floor, ceiling = structure.extract_structure(stored(cloud, "cloud"), config.structure, size or 0.03)
    t = config.structure
    ground = cloud.where(F.col("label") == CODE["PAVIMENTO"])
    levels = structure.level_medians(ground, t["level_gap"]).orderBy("low").collect()  # levels of a building
    floors = stored(structure.floor_map(ground, t["floor_cell"], t["level_gap"]), "floors") if levels else None
    if floors is not None:  # under the lowest floor of a place there are only reflections
        own = cloud.select(voxel_index(F.col("x"), t["floor_cell"]).alias("i"), voxel_index(F.col("y"), t["floor_cell"]).alias("j")).distinct()
        lowest = structure.fill_map(floors, own, t["floor_cell"], t["fill_radius"]).groupBy("i", "j").agg(F.min_by("z", "level").alias("z"))
        cloud = stored(rules.reflections(cloud, lowest, t["floor_cell"], t["below_floor"]), "reflections")
    heights = lambda feats, of: local_heights(feats, of, planes, floors, floor, ceiling, t)
    pool = cloud.where(F.col("label") == GENERIC)
    solid = spatial.radius_count(pool.select("pid", "x", "y", "z"), config.cluster["evidence_radius"] * size, others=cloud.select("pid", "x", "y", "z")).where(F.col("n") >= config.cluster["evidence"] + 1).select("pid")
    solid = stored(solid, "solid").withColumn("solid_", F.lit(True))
    thin = (F.col("label") == GENERIC) & F.col("solid_").isNull()
    cloud = stored(cloud.join(solid, "pid", "left").withColumn("label", F.when(thin, CODE["WASTE"]).otherwise(F.col("label")).cast("smallint")).drop("solid_"), "evidence")
    pool = cloud.where(F.col("label") == GENERIC)
    if planes is not None:  # what stands in an accepted wall's plane is wall
        rest = structure.wall_completion(pool, planes.where("kind = 'wall'"), t).withColumn("wall_", F.lit(True))
        cloud = cloud.join(rest, "pid", "left").withColumn("label", F.when(F.col("wall_"), CODE["PARETE"]).otherwise(F.col("label")).cast("smallint")).drop("wall_")
        cloud = stored(cloud, "walls")
        pool = cloud.where(F.col("label") == GENERIC)
    grown = cluster.grow(pool.drop("label"), size, config.cluster)
    held = stored(pool.drop("label").join(grown.where("cluster_id is not null"), "pid"), "grown")
    parts = split_clusters(held, ceiling, [r.low for r in levels] or [floor], config)
    held = stored(held.drop("cluster_id").join(parts.where("cluster_id is not null"), "pid"), "held")
    feats = stored(heights(features.build_features(held, size), held), "features")
    if planes is not None:  # thin clusters in an accepted plane are the rest of it
        thin = feats.select("cluster_id", F.element_at("dims", 3).alias("thickness"))
        rest = stored(structure.structural_residual(held, structure.residual_planes(planes), thin, t=t), "residues")
        of = held.select("pid", "cluster_id").join(rest, "cluster_id").select("pid", "code")
        cloud = stored(cloud.join(of, "pid", "left").withColumn("label", F.coalesce("code", "label").cast("smallint")).drop("code"), "residual")
        held, feats = (stored(df.join(rest.select("cluster_id"), "cluster_id", "left_anti"), "kept") for df in (held, feats))
    found = stored(rules.classify(feats, config.rules, config.excluded, config.cluster["instance"]), "classified")
    off = stored(detach_appendices(held, found, config, size, heights), "appendices")
    if not off.isEmpty():
        met = held.join(off.select("pid", "host", F.col("cluster_id").alias("off_")), "pid", "left")
        held = stored(met.where("host is null or off_ is not null").withColumn("cluster_id", F.coalesce("off_", "cluster_id")).drop("off_", "host"), "detached")
        feats = heights(features.build_features(held, size), held)
        feats = feats.join(off.select("cluster_id").distinct().withColumn("new_", F.lit(True)), "cluster_id", "left").withColumn("under_pipe", F.coalesce("new_", F.lit(False))).drop("new_")
        again = rules.classify(stored(feats, "features"), config.rules, config.excluded, 0)
        least = (F.col("n") >= config.cluster["instance"]) | F.col("under_pipe")
        found = stored(again.withColumn("label", F.when(least, F.col("label")).otherwise(GENERIC).cast("smallint")), "classified")
        # what is noise off a pipe has the pipe's class, but is no part of it
        noise = off.where("cluster_id is null").select("pid", F.col("host").alias("cluster_id")).join(found.select("cluster_id", F.col("label").alias("of_pipe_")), "cluster_id").select("pid", "of_pipe_")
        cloud = stored(cloud.join(noise, "pid", "left").withColumn("label", F.coalesce("of_pipe_", "label").cast("smallint")).drop("of_pipe_"), "noise")
    keep = found.where((F.col("n") >= config.cluster["instance"]) | F.col("under_pipe"))
    keep = keep.withColumn("instance_id", F.row_number().over(Window.orderBy("cluster_id")).cast("long"))  # a row a cluster
    instances = stored(keep.withColumn("axis", F.col("eigen.e1")), "instances")
    instances = stored(context.serial_lights(instances, config.context), "lights")
    labelled = label_points(cloud, held, instances)
    instances = stored(context.anchoring(instances, labelled, config.context), "anchored")
    instances = stored(context.unify_chains(instances, config.context), "chains")
    if guide and "colour" in instances.columns:
        instances = rules.colour_guide(instances, list(guide), config.rules)
    instances = review_labels(instances, models, confirmations, rejections, config)
    cloud = stored(label_points(cloud, held, instances), "labelled")
    if other_labels is not None:
        cloud = stored(rules.fuse(cloud.join(other_labels, "pid", "left")).drop("dl_label"), "fused")
    full = spatial.nearest(points.select("pid", "x", "y", "z"), cloud, 2 * max(size, 0.01), keep=["label", "instance_id"])
    out = points.join(full.select("pid", F.col("near_label").alias("label"), F.col("near_instance_id").alias("instance_id")), "pid", "left")
    return Result(out, cloud, instances, planes, floor, ceiling)


def label_points(cloud: DataFrame, held: DataFrame, instances: DataFrame) -> DataFrame:
    """``cloud`` with the labels and ids of its instances."""
    of = held.select("pid", "cluster_id").join(instances.select("cluster_id", "instance_id", F.col("label").alias("new_")), "cluster_id").select("pid", "instance_id", "new_")
    return cloud.drop("instance_id").join(of, "pid", "left").withColumn("label", F.coalesce("new_", "label").cast("smallint")).drop("new_")


def review_labels(instances: DataFrame, models, confirmations, rejections, config: Config) -> DataFrame:
    """Models, then pins."""
    if models is None and confirmations is None and rejections is None:
        return instances
    signs = stored(review.signature(instances), "signatures")
    if models is not None:
        signs = review.apply_models(signs, models, rejections, t=config.similar)
    if confirmations is not None or rejections is not None:
        none = signs.limit(0).withColumn("decision", F.lit(0).cast("long"))
        signs = review.apply_pins(signs, confirmations if confirmations is not None else none, rejections if rejections is not None else none, config.similar)
    return stored(instances.drop("label").join(signs.select("instance_id", "label"), "instance_id"), "reviewed")
