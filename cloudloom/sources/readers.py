"""Sources: a folder, file or glob of any format becomes the one point schema.

Text goes through Spark's own reader and is stored once with its ids. Binary formats come
through the source of :mod:`blocks`, a range of a file's records a task.
"""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import longest_prefix
from ..operators.tables import qualified, stored
from ..plans.model import CODE
from . import blocks
from .documents import DECISIONS_SCHEMA, exists

TEXT, BINARY, NEEDS_CODEC = ("xyz", "txt", "asc"), ("ply", "pcd", "las", "e57"), ("laz",)


def extension(path: str) -> str:
    return posixpath.splitext(path.rstrip("/*"))[1].lower().lstrip(".")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a file: pid, x, y, z, r, g, b, intensity, source. An unknown extension is an error that lists the known; a missing file is FileNotFoundError."""
    kind = extension(path)
    known = (*TEXT, *BINARY, *NEEDS_CODEC)
    if kind not in known:
        raise ValueError(f"unknown extension {kind!r}; known are {sorted(known)}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        raise FileNotFoundError(path)
    if kind in NEEDS_CODEC:
        raise NotImplementedError(f"{kind} needs a codec that is not installed")
    return read_text(spark, path) if kind in TEXT else read_binary(spark, path, blocks.COLUMNS[:-1])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """x y z [r g b | intensity]: six columns or more are colours (scaled in files where none exceeds 1), exactly four an intensity. Fewer than three are an error."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"))
    cut = lines.where(F.length(F.trim("value")) > 0).where(~F.col("value").startswith("#")).select("source", F.split(F.trim("value"), r"[\s,;]+").alias("v"))
    v = lambda k: F.get("v", F.lit(k)).try_cast("double")
    rows = cut.select(*(v(k).alias(c) for k, c in enumerate("xyz")), F.size("v").alias("n"), v(3).alias("c3"), v(4).alias("c4"), v(5).alias("c5"), "source")
    about = stored(rows.groupBy("source").agg(F.min("n").alias("few"), F.max(F.when(F.col("n") >= 6, F.greatest("c3", "c4", "c5"))).alias("top")), "files")
    if not about.where("few < 3").isEmpty():
        raise ValueError("a line has fewer than three columns")
    rows = rows.join(about, "source")  # a row a file
    factor = F.when(F.col("top") <= 1.0, 255.0).otherwise(1.0)
    colour = lambda c: F.when(F.col("n") >= 6, F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.bround(F.col(c) * factor)))).cast("smallint")
    out = rows.select(
        F.monotonically_increasing_id().alias("pid"), "x", "y", "z", colour("c3").alias("r"), colour("c4").alias("g"), colour("c5").alias("b"),
        F.when(F.col("n") == 4, F.col("c3")).cast("float").alias("intensity"), "source",
    )
    return stored(out, "points")  # parsed once, and the ids stay what they are


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The URIs of the files that a path or glob names, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(qualified(spark, str(f.getPath().toString())) for f in found or [] if f.isFile())


def read_binary(spark: SparkSession, path: str, columns: tuple[str, ...] = blocks.COLUMNS, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """The point schema and ``classe`` (of classified files) from PLY, PCD, LAS or E57 files; only ``columns`` are read.

    E57 scans are turned to their pose and lose invalid points; colours and intensity stay
    where every scan of a file has them. Colours of 16 bits (of a LAS or E57 file in which
    one exceeds 255) come down to bytes by 257.
    """
    paths = files_of(spark, path)
    if not paths:
        raise FileNotFoundError(path)
    spark.dataSource.register(blocks.PointBlocks)

    def scan(names) -> DataFrame:
        return spark.read.format("pointblocks").option("paths", json.dumps(paths)).option("columns", ",".join(names)).option("blockRows", block_rows).load()

    own = [c for c in blocks.COLUMNS if c in columns]
    colours = [c for c in own if c in "rgb"]
    wide = colours and any(extension(p) in ("las", "e57") for p in paths)
    out = scan([*own, *(["source"] if wide and "source" not in own else [])])
    if wide:  # whether colours have 16 bits is the file's, not a block's
        top = scan(["r", "g", "b", "source"]).groupBy("source").agg(F.max(F.greatest("r", "g", "b")).alias("top_"))
        known = stored(top.where("top_ > 255"), "colours")  # a row a file
        out = out.join(F.broadcast(known), "source", "left")
        out = out.withColumns({c: F.when(F.col("top_") > 255, F.bround(F.col(c) / 257)).otherwise(F.col(c)) for c in colours})
    return out.select(*(F.col(c).cast("smallint").alias(c) if c in colours else c for c in own))


def read_classified(spark: SparkSession, path: str) -> DataFrame:
    """(pid, x, y, z, r, g, b, label) of classified PLY or LAS files."""
    return read_binary(spark, path, ("pid", "x", "y", "z", "r", "g", "b", "classe")).select("pid", "x", "y", "z", "r", "g", "b", F.col("classe").alias("label"))


def count_points(spark: SparkSession, path: str) -> int:
    """Points by the headers alone; invalid points of E57 scans count."""
    return sum(blocks.header(p)[2] for p in files_of(spark, path))


def union_scans(scans: list[DataFrame]) -> DataFrame:
    """All scans together; colour and intensity stay only if every scan has them."""
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    for group in (("r", "g", "b"), ("intensity",)):
        if not all(set(group) <= set(s.columns) for s in scans):
            out = out.withColumns({c: F.lit(None).cast("smallint" if len(group) == 3 else "float") for c in group})
    return out


def transform_rigid(points: DataFrame, rotation: list[list[float]], shift: list[float]) -> DataFrame:
    """Points turned and moved; rows whose ``invalid`` is not 0 go, where there is such a column."""
    if "invalid" in points.columns:
        points = points.where(F.col("invalid") == 0).drop("invalid")
    new = {c: rotation[k][0] * F.col("x") + rotation[k][1] * F.col("y") + rotation[k][2] * F.col("z") + shift[k] for k, c in enumerate("xyz")}
    return points.withColumns(new)


def cached(spark: SparkSession, folder: str, name: str, voxel: float, make) -> DataFrame:
    """A reduced cloud from ``folder`` if it is there, else ``make()`` written there. The voxel in millimetres is part of the name."""
    path = f"{folder.rstrip('/')}/{name}_{round(voxel * 1000)}mm.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_public_dataset(spark: SparkSession, root: str, mapping: dict[str, str], voxel: float = 0.0, held_out: str | None = None) -> DataFrame:
    """Points of Area_*/Room_*/Annotations/*.txt with label, confidence 2, area and split.

    ``mapping`` takes the longest prefix of a file's name to a class key; other files are
    left out. With a voxel size one point of each voxel stays, first in its file, then in
    its area. ``held_out`` is the area of the validation split.
    """
    unknown = sorted({v for v in mapping.values() if v.upper() not in CODE})
    if unknown:
        raise ValueError(f"unknown classes {unknown}; valid are {sorted(CODE)}")
    keys = {k.lower(): CODE[v.upper()] for k, v in mapping.items()}
    rows = read_text(spark, f"{root.rstrip('/')}/Area_*/Room_*/Annotations/*.txt")
    prefix = longest_prefix(F.regexp_extract("source", r"([^/]+)\.txt$", 1), list(keys))
    label = F.lit(None).cast("smallint")
    for k, code in keys.items():
        label = F.when(F.col("prefix") == k, code).otherwise(label)
    out = rows.withColumns({"prefix": prefix, "area": F.regexp_extract("source", r"/(Area_[^/]+)/", 1)}).withColumn("label", label.cast("smallint")).where("label is not null")
    if voxel > 0:
        out = first_of_voxels(first_of_voxels(out, voxel, ["source"]), voxel, ["area"])
    split = F.when(F.col("area") == F.lit(held_out), "val").otherwise("train")
    return out.select("pid", "x", "y", "z", "r", "g", "b", "label", F.lit(2).cast("smallint").alias("confidence"), "area", split.alias("split"))


def first_of_voxels(points: DataFrame, size: float, by: list[str]) -> DataFrame:
    keys = [*by, *(F.floor(F.col(c) / size) for c in "xyz")]
    kept = points.groupBy(*keys).agg(F.min("pid").alias("pid")).select("pid")
    return stored(points.join(kept, "pid", "left_semi"), "voxels")


def read_confirmations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(confirmations, rejections) of a decisions file; a missing file has neither."""
    doc = spark.read.schema(DECISIONS_SCHEMA).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], DECISIONS_SCHEMA)
    flat = lambda c: doc.select(F.posexplode(c).alias("decision", "v")).select(
        F.col("decision").cast("long").alias("decision"), *(F.element_at("v.firma.dimensioni", k).alias(f"d{k}") for k in (1, 2, 3)),
        F.col("v.firma.estensione_z").alias("z_extent"), F.col("v.firma.dist_soffitto").alias("to_ceiling"), F.col("v.firma.dist_pavimento").alias("to_floor"),
        F.col("v.firma.verticalita").alias("verticality"), *(F.element_at("v.firma.centro", k).alias(f"c{c}") for k, c in zip((1, 2, 3), "xyz", strict=True)), "v",
    )
    code = lambda c: F.element_at(F.create_map(*(F.lit(x) for k, v in CODE.items() for x in (k, v))), F.upper(F.trim(c))).cast("smallint")
    yes = flat("conferme").withColumn("label", code(F.col("v.classe"))).drop("v")
    return yes, flat("rifiuti").drop("v")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The instances of a report (a document, or the folder that ``write_report`` wrote), one row each."""
    at = f"{path.rstrip('/')}/report"
    return spark.read.json(at if exists(spark, at) else path, multiLine=True).select(F.explode("istanze").alias("i")).select("i.*")
