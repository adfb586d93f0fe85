"""Sinks: classified clouds, files by macro group, reports, training sets.

A cloud is written as one file a partition, where its points are; nothing is gathered.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dataset import class_counts
from ..operators.tables import qualified
from ..plans.model import GROUPS, class_table
from . import classified

REPORT_COLUMNS = (
    "id", "classe_codice", "classe", "n_punti", "centro_x", "centro_y", "centro_z", "dim_1", "dim_2", "dim_3", "quota_top", "quota_bottom", "estensione_z",
    "dist_soffitto", "dist_pavimento", "verticalita", "raggio_stimato", "diametro_stimato", "lunghezza_stimata", "asse_x", "asse_y", "asse_z", "uniformita_colore",
)


def with_class_colours(points: DataFrame) -> DataFrame:
    """``points`` with the colour of their class as r, g, b."""
    look = class_table(points.sparkSession).select(F.col("code").cast("smallint").alias("label"), "r", "g", "b")
    return points.drop("r", "g", "b").join(F.broadcast(look), "label")  # 17 rows


def _dressed(points: DataFrame) -> DataFrame:
    look = class_table(points.sparkSession).select(F.col("code").cast("smallint").alias("label"), "r", "g", "b", "macro_group")
    return points.select("x", "y", "z", "label").join(F.broadcast(look), "label").select(*(F.col(c).cast("double").alias(c) for c in "xyz"), *(F.col(c).cast("smallint").alias(c) for c in ("r", "g", "b", "label")), "macro_group")  # 17 rows


def write_classified(points: DataFrame, folder: str, kind: str = "ply", file_rows: int = classified.FILE_ROWS) -> DataFrame:
    """One PLY or LAS file a block of about ``file_rows`` rows of a partition in ``folder``; (path, n) of each. ``points`` has x, y, z and label."""
    listed = classified.save(_dressed(points), qualified(points.sparkSession, folder), kind, uuid.uuid4().hex[:12], file_rows=file_rows)
    return points.sparkSession.createDataFrame([(p, n) for p, _, n in listed], "path string, n long")


def with_group(points: DataFrame) -> DataFrame:
    look = class_table(points.sparkSession).select(F.col("code").cast("smallint").alias("label"), "macro_group")
    return points.join(F.broadcast(look), "label")


def write_grouped(points: DataFrame, folder: str, kind: str = "parquet", whole: bool = False) -> dict[str, str]:
    """Points by macro group, in one pass, the groups in order that have any: {group: folder}. Empty groups leave none.

    ``kind`` ply or las gives classified files in a folder each, and with ``whole`` those
    of all points in ``folder`` too.
    """
    if kind == "parquet":
        with_group(points).write.mode("overwrite").partitionBy("macro_group").parquet(folder)
        got = {r[0] for r in points.sparkSession.read.parquet(folder).select("macro_group").distinct().collect()}  # three at most
        return {g: f"{folder}/macro_group={g}" for g in GROUPS if g in got}
    listed = classified.save(_dressed(points), qualified(points.sparkSession, folder), kind, uuid.uuid4().hex[:12], "both" if whole else "groups")
    return {g: f"{folder}/{g}" for g in GROUPS if g in {x[1] for x in listed}}


def instance_rows(instances: DataFrame) -> DataFrame:
    """The report's columns: three decimals, four for a radius and an axis; cylinder columns only for pipes and round ducts with a fit; ``colore_rgb`` where instances have a colour."""
    look = class_table(instances.sparkSession).select(F.col("code").cast("smallint").alias("label"), F.col("name").alias("classe"))
    r3 = lambda c: F.bround(c, 3)
    fit = F.col("cylinder.valid") & F.col("label").isin(1, 3)
    met = instances.join(F.broadcast(look), "label")
    out = met.select(
        F.col("instance_id").alias("id"), F.col("label").cast("int").alias("classe_codice"), "classe", F.col("n").alias("n_punti"),
        *(r3(F.element_at("centre", k)).alias(f"centro_{c}") for k, c in zip((1, 2, 3), "xyz", strict=True)), *(r3(F.element_at("dims", k)).alias(f"dim_{k}") for k in (1, 2, 3)),
        r3(F.col("top")).alias("quota_top"), r3(F.col("bottom")).alias("quota_bottom"), r3(F.col("robust_z")).alias("estensione_z"), r3(F.col("to_ceiling")).alias("dist_soffitto"),
        r3(F.col("to_floor")).alias("dist_pavimento"), r3(F.col("verticality")).alias("verticalita"), F.when(fit, F.bround("cylinder.radius", 4)).alias("raggio_stimato"),
        F.when(fit, F.bround(2 * F.col("cylinder.radius"), 4)).alias("diametro_stimato"), F.when(fit, r3(F.col("cylinder.length"))).alias("lunghezza_stimata"),
        *(F.when(fit, F.bround(F.element_at("cylinder.axis", k), 4)).alias(f"asse_{c}") for k, c in zip((1, 2, 3), "xyz", strict=True)),
        *([F.col("colour").alias("colore_rgb")] if "colour" in instances.columns else []),
        (F.bround("uniformity", 3) if "uniformity" in instances.columns else F.lit(None).cast("double")).alias("uniformita_colore"),
    )
    return out.select(*REPORT_COLUMNS, *(["colore_rgb"] if "colour" in instances.columns else []))


def write_report(points: DataFrame, instances: DataFrame, folder: str, planes: DataFrame | None = None, ceiling: float | None = None, floor: float | None = None) -> dict:
    """The report as a JSON document (totals, counts of all classes, planes, instances), instances as CSV and Parquet, points of instances as Parquet. Returns the counts.

    ``planes`` is a table of a row a plane, in the document as it is.
    """
    rows = instance_rows(instances)
    rows.drop("colore_rgb").write.mode("overwrite").csv(f"{folder}/instances_csv", header=True)
    rows.write.mode("overwrite").parquet(f"{folder}/instances")
    rows = points.sparkSession.read.parquet(f"{folder}/instances")
    points.where(F.col("instance_id") > 0).select(*(F.col(c).cast("float").alias(c) for c in "xyz"), F.col("instance_id").cast("int").alias("id_istanza")).write.mode("overwrite").parquet(f"{folder}/instance_points")
    spark = points.sparkSession
    counts = class_counts(points, class_table(spark)).join(class_table(spark).select("code", "name"), "code").orderBy("code").collect()  # 17 rows
    doc = {"punti_totali": sum(r.n for r in counts), "quota_soffitto": ceiling and round(ceiling, 3), "quota_pavimento": floor and round(floor, 3), "punti_per_classe": {r.name: r.n for r in counts}}
    head = spark.createDataFrame([(json.dumps({k: v for k, v in doc.items() if v is not None}, ensure_ascii=False),)], "head string")
    lists = rows.orderBy("id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rows.columns)))).alias("istanze"), F.count(F.lit(1)).alias("n"))
    flat = planes.agg(F.to_json(F.collect_list(F.struct(*planes.columns))).alias("piani")) if planes is not None else spark.createDataFrame([("[]",)], "piani string")
    whole = head.crossJoin(lists).crossJoin(flat)  # one row each
    text = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(', "piani_strutturali": '), "piani", F.lit(', "n_istanze_mep": '), F.col("n").cast("string"), F.lit(', "istanze": '), "istanze", F.lit("}"))
    whole.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/report")
    return doc


def write_training(rows: DataFrame, folder: str) -> None:
    """x, y, z, label, confidence by split and cloud; a cloud that is written again replaces its own."""
    keep = rows.select(*(F.col(c).cast("float").alias(c) for c in "xyz"), F.col("label").cast("smallint").alias("label"), F.col("confidence").cast("smallint").alias("confidence"), "split", "cloud")
    keep.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cloud", "split").parquet(folder)


def family_colours(points: DataFrame) -> DataFrame:
    """``points`` with a colour of their surface family."""
    # Five colours.
    palette = {"none": (128, 128, 128), "horizontal": (0, 114, 178), "vertical": (0, 158, 115), "cylindrical": (230, 159, 0), "irregular": (213, 94, 0)}
    out = points
    for i, c in enumerate("rgb"):
        e = F.lit(128)
        for k, v in palette.items():
            e = F.when(F.col("family") == k, v[i]).otherwise(e)
        out = out.withColumn(c, e.cast("smallint"))
    return out


def viewer_payload(points: DataFrame, most: int = 1_500_000, seed: int = 0) -> bytes:
    """[count u32][xyz f4][rgb u1][class u1] of a seeded sample; ``most`` bounds what reaches the driver."""
    import numpy as np

    got = with_class_colours(points).orderBy(F.xxhash64(F.lit(seed), "pid"), "pid").limit(most).select("x", "y", "z", "r", "g", "b", "label").toPandas()
    parts = [np.uint32(len(got)).tobytes(), got[["x", "y", "z"]].to_numpy("<f4").tobytes(), got[["r", "g", "b"]].to_numpy("u1").tobytes(), got["label"].to_numpy("u1").tobytes()]
    return b"".join(parts)
