"""Classes, schemas and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Code, key, name, red, green, blue, macro group, whether a user may exclude it.
CLASSES = (
    (0, "STRUTTURA", "Struttura / non-MEP", 128, 128, 128, "strutturale", False),
    (1, "CONDOTTA_CIRCOLARE", "Condotta circolare", 0, 150, 255, "mep", True),
    (2, "CONDOTTA_RETTANGOLARE", "Condotta rettangolare", 0, 60, 220, "mep", True),
    (3, "TUBAZIONE", "Tubazione", 0, 200, 80, "mep", True),
    (4, "PASSERELLA_CAVI", "Passerella cavi", 255, 140, 0, "mep", True),
    (5, "LUCE", "Luce", 255, 220, 0, "mep", True),
    (6, "SPRINKLER", "Sprinkler", 255, 0, 60, "mep", True),
    (7, "TERMINALE_ARIA", "Terminale aria", 0, 230, 230, "mep", True),
    (8, "APPARECCHIATURA", "Apparecchiatura", 170, 0, 255, "mep", True),
    (9, "MEP_GENERICO", "Elemento MEP generico", 255, 105, 180, "mep", False),
    (10, "NON_MEP_ARREDO", "Arredo", 139, 87, 42, "scarto", False),
    (11, "PAVIMENTO", "Pavimento", 105, 105, 105, "strutturale", False),
    (12, "SOFFITTO", "Soffitto", 210, 210, 210, "strutturale", False),
    (13, "PARETE", "Parete", 160, 160, 160, "strutturale", False),
    (14, "PILASTRO", "Pilastro", 80, 80, 80, "strutturale", False),
    (15, "TRAVE", "Trave", 110, 110, 140, "strutturale", False),
    (16, "WASTE", "Waste", 40, 40, 45, "scarto", False),
)
CODE = {key: code for code, key, *_ in CLASSES}
GROUPS = ("strutturale", "mep", "scarto")
UNCERTAIN = (0, 9, 10, 16)

POINT_SCHEMA = "pid long, x double, y double, z double, r smallint, g smallint, b smallint, intensity float, source string"

# Thresholds of the rules.
RULES: dict[str, Any] = {
    "least_density": 0.05, "waste_volume": 0.20, "below_floor": -0.05,
    "n_sprinkler": 20, "n_pipe": 30, "n_duct": 80, "n_tray": 80, "n_terminal": 25, "n_light": 30, "n_equipment": 200,
    "sprinkler_side": 0.35, "sprinkler_ceiling": 1.0,
    "column_verticality": 0.7, "column_ceiling": 0.4, "column_floor": 0.4, "column_height": 2.0, "column_side_min": 0.2, "column_side_max": 1.2,
    "inliers": 0.50, "radial": 0.50, "section": 0.75, "normals": 0.65, "linearity": 0.5, "cylinder_length": 0.4,
    "pipe_radius": 0.10, "duct_radius": 0.60, "suspect_radius": 0.35, "suspect_floor": 0.2,
    "level_axis": 0.35, "elongation": 2.0, "plant_ceiling": 1.5,
    "tray_length": 2.0, "tray_height": 0.15, "tray_width_min": 0.10, "tray_width_max": 0.70,
    "loaded_height": 0.30, "loaded_width": 0.20, "loaded_length": 2.5, "loaded_elongation": 3.0,
    "rect_width_min": 0.20, "rect_width_max": 1.50, "rect_height_min": 0.12, "rect_height_max": 1.20,
    "flat_thickness": 0.25, "flat_z": 0.30, "flat_band": 0.5, "flat_ceiling": 0.6, "flat_min": 0.15, "flat_max": 3.0, "light_density": 0.08,
    "terminal_ratio": 1.6, "terminal_side": 0.9,
    "slab_thickness": 0.15, "slab_side": 1.5, "slab_width": 0.5, "slab_height": 0.8, "slab_area": 2.0, "slab_density": 0.10, "slab_shape": 0.7,
    "equipment_side": 0.35, "equipment_long": 0.60, "equipment_volume": 0.40, "equipment_density": 0.10, "equipment_floor": 1.0,
    "guide_distance": 45.0, "guide_uniformity": 0.6,
}

# Thresholds of the other stages.
PREPROCESS = {"voxel": 0.03, "neighbours": 16, "std": 2.5}
STRUCTURE = {
    "floor_cell": 0.5, "fill_radius": 8.0, "level_gap": 0.5, "below_floor": 0.20, "plane_distance": 0.02, "plane_points": 1500, "part_points": 200, "planes": 60, "plane_cell": 1.0,
    "horizontal_side": 1.5, "horizontal_area": 2.0, "wall_height": 1.8, "wall_area": 3.0, "wall_share": 0.75, "meet": 0.6,
    "component_cell": 0.30, "column_cell": 0.15, "column_coverage": 0.85, "column_min": 0.2, "column_max": 1.2, "column_elongation": 2.5,
    "beam_cell": 0.15, "beam_min": 0.3, "beam_max": 1.0, "beam_length": 1.2, "beam_elongation": 2.5, "beam_depth": 0.6,
    "bump_min": 0.03, "bump_side": 3.0, "bump_window": 2.0, "wall_align": 0.95, "residual_distance": 0.05, "residual_share": 0.8, "residual_thickness": 0.12,
}
CLUSTER = {
    "eps": 0.08, "least": 10, "neighbours": 8, "smooth_degrees": 18.0, "jump": 0.04, "concave": 0.15, "convex_share": 0.5, "patch": 30, "contact": 2.5,
    "probe": 0.06, "evidence_radius": 2.5, "evidence": 4, "instance": 100, "cylindrical": 0.10, "irregular": 0.10, "mixed_area": 1.5, "colour": 60.0,
    "giant": 8.0, "ceiling_band": 1.2, "erosion_side": 4.0, "gap": 0.15, "segments": 3, "gap_section": 0.8, "erosion": 0.3, "erosion_cell": 0.15,
    "direction_degrees": 10.0, "direction_points": 150, "direction_share": 0.15, "directions": 4, "sphericity": 0.35,
}
CONTEXT = {
    "light_radius": 0.10, "light_section": 0.35, "light_min": 0.12, "light_max": 2.5, "light_ceiling": 1.2, "light_distance": 6.0, "repeats": 3,
    "light_z": 0.30, "light_density": 0.08, "light_band": 0.5, "anchor_radius": 0.4, "slice": 0.2, "samples": 25,
    "chain_gap": 0.6, "chain_offset": 0.35, "parallel": 0.9, "chain_ratio": 2.5, "chain_section": 0.8, "chain_reach": 4.0,
}
SIMILAR = {"relative": 0.4, "absolute": 0.08, "height": 0.6, "near_ceiling": 1.5, "near_floor": 0.3, "pin_centre": 0.3, "pin_relative": 0.20, "pin_absolute": 0.05}

# Classes that an environment cannot have.
PRESETS = {"terziario": (), "data_center": ("sprinkler",), "centrale_termica": ("terminale_aria",), "industriale": (), "personalizzato": ()}


@dataclass(frozen=True)
class Config:
    """All thresholds; ``with_values`` replaces some of one section."""

    preprocess: dict = field(default_factory=lambda: dict(PREPROCESS))
    structure: dict = field(default_factory=lambda: dict(STRUCTURE))
    cluster: dict = field(default_factory=lambda: dict(CLUSTER))
    rules: dict = field(default_factory=lambda: dict(RULES))
    context: dict = field(default_factory=lambda: dict(CONTEXT))
    similar: dict = field(default_factory=lambda: dict(SIMILAR))
    excluded: frozenset[str] = frozenset()

    def with_values(self, section: str, **values) -> Config:
        unknown = set(values) - set(getattr(self, section))
        if unknown:
            raise ValueError(f"unknown in {section}: {sorted(unknown)}")
        return replace(self, **{section: getattr(self, section) | values})


def load_config(path: str) -> Config:
    """A configuration from a YAML or JSON file of sections; what it omits keeps its value."""
    text = open(path, encoding="utf-8").read()
    try:
        import yaml

        found = yaml.safe_load(text)
    except ImportError:
        import json

        found = json.loads(text)
    out = Config()
    for section, values in (found or {}).items():
        out = replace(out, excluded=frozenset(values)) if section == "excluded" else out.with_values(section, **values)
    return out


def excluded_codes(names) -> frozenset[int]:
    """Codes of class names, in any case; an unknown name is an error that lists the valid ones."""
    valid = {key: code for code, key, *_, free in CLASSES if free}
    wanted = [str(n).strip().upper() for n in names]
    if unknown := [n for n in wanted if n not in valid]:
        raise ValueError(f"unknown classes {unknown}; valid are {sorted(valid)}")
    return frozenset(valid[n] for n in wanted)


def class_table(spark: SparkSession) -> DataFrame:
    """The 17 classes as a dimension."""
    return spark.createDataFrame(CLASSES, "code int, key string, name string, r int, g int, b int, macro_group string, excludable boolean")
