"""Class decisions as ordered lists of (condition, class): one CASE expression in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import CODE, RULES, UNCERTAIN, excluded_codes


def first_match(rules: list[tuple[Column, int]], otherwise: int) -> Column:
    out = F.lit(otherwise)
    for condition, code in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), code).otherwise(out)
    return out.cast("smallint")


def rule_list(rules: dict = RULES, excluded=()) -> list[tuple[Column, int]]:
    """The cascade over the columns of a feature table.

    Columns: n, dims (three, longest first), density, linearity, planarity, verticality,
    robust_z, band_share, top, bottom, to_ceiling, to_floor, under_pipe and the struct
    cylinder (valid, radius, inliers, radial, section, normals, length).
    """
    t, off = rules, excluded_codes(excluded)
    c = F.col
    a, b, h = (F.element_at("dims", k) for k in (1, 2, 3))
    volume, wide = a * b * h, F.greatest(b, F.lit(1e-6))
    cyl = lambda name: c(f"cylinder.{name}")
    level, hung, slender = c("verticality") <= t["level_axis"], c("to_ceiling") <= t["plant_ceiling"], a >= t["elongation"] * wide
    thin_pipe = F.coalesce(cyl("valid") & (cyl("radius") <= t["pipe_radius"]), F.lit(False))
    round_ = (
        cyl("valid") & (cyl("inliers") >= t["inliers"]) & (cyl("radial") >= t["radial"]) & (cyl("section") >= t["section"])
        & (cyl("normals") <= t["normals"]) & (c("linearity") >= t["linearity"]) & (cyl("length") >= t["cylinder_length"])
    )
    flat = (
        (h <= t["flat_thickness"]) & (h <= 0.5 * b) & ((c("robust_z") <= t["flat_z"]) | (c("band_share") >= t["flat_band"]))
        & (c("to_ceiling") <= t["flat_ceiling"]) & a.between(t["flat_min"], t["flat_max"]) & (c("density") >= t["light_density"])
    )
    tray = level & hung & b.between(t["tray_width_min"], t["tray_width_max"])
    listed = [
        ("WASTE", 0, (c("density") < t["least_density"]) & (volume >= t["waste_volume"])),
        ("MEP_GENERICO", 0, c("density") < t["least_density"]),
        ("WASTE", 0, c("to_floor") + (c("top") - c("bottom")) < t["below_floor"]),
        ("SPRINKLER", t["n_sprinkler"], (a <= t["sprinkler_side"]) & (c("under_pipe") | (c("to_ceiling") <= t["sprinkler_ceiling"]))),
        (
            "PILASTRO", 0,
            (c("verticality") >= t["column_verticality"]) & (c("to_ceiling") <= t["column_ceiling"]) & (c("to_floor") <= t["column_floor"])
            & (c("robust_z") >= t["column_height"]) & b.between(t["column_side_min"], t["column_side_max"]) & ~thin_pipe,
        ),
        ("TUBAZIONE", t["n_pipe"], round_ & (cyl("radius") <= t["pipe_radius"])),
        ("CONDOTTA_CIRCOLARE", t["n_duct"], round_ & (cyl("radius") <= t["duct_radius"]) & ~((cyl("radius") >= t["suspect_radius"]) & (c("to_floor") <= t["suspect_floor"]))),
        ("PASSERELLA_CAVI", t["n_tray"], tray & slender & (a >= t["tray_length"]) & (h <= t["tray_height"])),
        ("PASSERELLA_CAVI", t["n_tray"], tray & (a >= t["loaded_elongation"] * wide) & (a >= t["loaded_length"]) & (h <= t["loaded_height"]) & (b >= t["loaded_width"])),
        ("CONDOTTA_RETTANGOLARE", t["n_duct"], slender & level & hung & b.between(t["rect_width_min"], t["rect_width_max"]) & h.between(t["rect_height_min"], t["rect_height_max"])),
        ("TERMINALE_ARIA", t["n_terminal"], flat & (a / wide <= t["terminal_ratio"]) & (a <= t["terminal_side"])),
        ("LUCE", t["n_light"], flat),
        (
            "PARETE", 0,
            (level | (c("verticality") >= t["column_verticality"])) & (h <= t["slab_thickness"]) & (a >= t["slab_side"]) & (b >= t["slab_width"])
            & (c("robust_z") >= t["slab_height"]) & (c("planarity") + c("linearity") >= t["slab_shape"]) & (c("density") >= t["slab_density"]) & (a * b >= t["slab_area"]),
        ),
        (
            "APPARECCHIATURA", t["n_equipment"],
            (c("density") >= t["equipment_density"]) & (c("to_floor") <= t["equipment_floor"])
            & (((h >= t["equipment_side"]) & (a >= t["equipment_long"])) | (volume >= t["equipment_volume"])),
        ),
    ]
    return [(condition & (c("n") >= least) if least else condition, CODE[key]) for key, least, condition in listed if CODE[key] not in off]


def classify(features: DataFrame, rules: dict = RULES, excluded=(), least_points: int = 0) -> DataFrame:
    """``features`` with ``label``; clusters under ``least_points`` are generic."""
    label = first_match(rule_list(rules, excluded), CODE["MEP_GENERICO"])
    return features.withColumn("label", F.when(F.col("n") >= least_points, label).otherwise(F.lit(CODE["MEP_GENERICO"])).cast("smallint"))


def colour_guide(instances: DataFrame, guide: list[tuple[str, tuple[int, int, int], float | None]], rules: dict = RULES) -> DataFrame:
    """Generic instances of one uniform colour take the class of the first guide entry near it. ``guide`` has (class, rgb, distance or None)."""
    entries = []
    for key, rgb, distance in guide:
        far = float(distance if distance is not None else rules["guide_distance"])
        d2 = sum(((F.element_at("colour", i + 1) - v) * (F.element_at("colour", i + 1) - v) for i, v in enumerate(rgb)), F.lit(0.0))
        entries.append((d2 <= far * far, CODE[key.strip().upper()]))
    if not entries:
        return instances
    chosen = first_match(entries, CODE["MEP_GENERICO"])
    free = (F.col("label") == CODE["MEP_GENERICO"]) & F.col("colour").isNotNull() & (F.col("uniformity") >= rules["guide_uniformity"])
    return instances.withColumn("label", F.when(free, chosen).otherwise(F.col("label")).cast("smallint"))


def fuse(points: DataFrame, other: str = "dl_label") -> DataFrame:
    """Points that geometry left generic take the other label, where there is one."""
    generic = F.col("label") == CODE["MEP_GENERICO"]
    return points.withColumn("label", F.when(generic & F.col(other).isNotNull(), F.col(other)).otherwise(F.col("label")).cast("smallint"))


def fuse_labels(points: DataFrame, labels: DataFrame, pid: str = "pid", other: str = "dl_label") -> DataFrame:
    """:func:`fuse` of two labellings of the same points; a point that only one of them has is an error."""
    side = labels.select(F.col(pid).alias("pid_"), F.col(other).alias(other), F.lit(True).alias("there_"))
    met = points.withColumn("here_", F.lit(True)).join(side, F.col(pid) == F.col("pid_"), "full")
    both = F.col("here_").isNotNull() & F.col("there_").isNotNull()
    checked = F.when(both, F.col("label")).otherwise(F.raise_error(F.lit("the two labellings are not of the same points")).cast("smallint"))
    return fuse(met.withColumn("label", checked), other).select(*points.columns)


def confidence(label: Column) -> Column:
    """0 for labels that say little, else 1."""
    return F.when(label.isin(*UNCERTAIN), 0).otherwise(1).cast("smallint")


def reflections(points: DataFrame, floors: DataFrame, cell: float, below: float = 0.20) -> DataFrame:
    """Points below the lowest floor of their column become WASTE; floors and ceilings do not, nor do points over no known floor. ``floors`` has i, j, z."""
    low = floors.groupBy("i", "j").agg(F.min("z").alias("low_"))
    met = points.withColumns({"i_": F.floor(F.col("x") / cell), "j_": F.floor(F.col("y") / cell)}).join(low, (F.col("i_") == F.col("i")) & (F.col("j_") == F.col("j")), "left")
    under = F.coalesce(F.col("z") < F.col("low_") - below, F.lit(False)) & ~F.col("label").isin(CODE["PAVIMENTO"], CODE["SOFFITTO"])
    return met.withColumn("label", F.when(under, CODE["WASTE"]).otherwise(F.col("label")).cast("smallint")).select(*points.columns)
