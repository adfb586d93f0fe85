"""JSON documents beside the clouds: reports, decisions, models, data set listings.

A document is small (instances, decisions, classes, never points) and is one file, so it
is built by Spark as one row and written by one task.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.review import upsert
from ..plans.model import CODE, PRESETS

# The documents' versions and the fields of a signature.
VERSION = 1
SIGNATURE = "dimensioni: array<double>, estensione_z: double, dist_soffitto: double, dist_pavimento: double, verticalita: double, centro: array<double>"
CONFIRMATION = f"firma: struct<{SIGNATURE}>, classe: string, nome: string, origine: string, quando: string, classe_precedente: string"
REJECTION = f"firma: struct<{SIGNATURE}>, classe_rifiutata: string, quando: string"
MODEL = f"{SIGNATURE}, nome: string, classe: string, origine: struct<file: string, istanza: bigint, data: string>, bersagli: array<string>"
MODELS_SCHEMA = f"versione int, modelli array<struct<{MODEL}>>"
DECISIONS_SCHEMA = f"versione int, nuvola string, conferme array<struct<{CONFIRMATION}>>, rifiuti array<struct<{REJECTION}>>"
_SIGN = ("d1", "d2", "d3", "z_extent", "to_ceiling", "to_floor", "verticality", "cx", "cy", "cz")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_document(doc: DataFrame, folder: str) -> None:
    """The one row of ``doc`` as JSON in ``folder``."""
    doc.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "true").json(folder)


def key_of(code: Column) -> Column:
    """A class's key in lower case, from its code."""
    return F.element_at(F.create_map(*(F.lit(x) for k, v in CODE.items() for x in (v, k.lower()))), code.cast("int"))


def signature_struct():
    """The document's signature of the columns of :func:`review.signature`."""
    return F.struct(
        F.array("d1", "d2", "d3").alias("dimensioni"), F.col("z_extent").alias("estensione_z"), F.col("to_ceiling").alias("dist_soffitto"),
        F.col("to_floor").alias("dist_pavimento"), F.col("verticality").alias("verticalita"), F.array("cx", "cy", "cz").alias("centro"),
    )


def from_signature(prefix: str) -> list:
    """The columns of a document's signature under their names here."""
    at = lambda c: F.col(f"{prefix}{c}")
    return [
        *(F.element_at(at("dimensioni"), k).alias(f"d{k}") for k in (1, 2, 3)), at("estensione_z").alias("z_extent"), at("dist_soffitto").alias("to_ceiling"),
        at("dist_pavimento").alias("to_floor"), at("verticalita").alias("verticality"), *(F.element_at(at("centro"), k).alias(f"c{c}") for k, c in zip((1, 2, 3), "xyz", strict=True)),
    ]


def now():
    """This moment as ISO text, to the second."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def confirmations(signs: DataFrame, name: str = "", origin: str = "conferma") -> DataFrame:
    """Records of a user's confirmations of ``signs`` (signature columns, label and, where known, label_before)."""
    before = key_of(F.col("label_before")) if "label_before" in signs.columns else F.lit(None).cast("string")
    name_ = F.coalesce("name", F.lit(name)) if "name" in signs.columns else F.lit(name)
    return signs.select(F.struct(signature_struct().alias("firma"), key_of(F.col("label")).alias("classe"), name_.alias("nome"), F.lit(origin).alias("origine"), now().alias("quando"), before.alias("classe_precedente")).alias("v"))


def rejections(signs: DataFrame) -> DataFrame:
    """Records of a user's rejections of ``signs`` (signature columns and the label that is wrong)."""
    return signs.select(F.struct(signature_struct().alias("firma"), key_of(F.col("label")).alias("classe_rifiutata"), now().alias("quando")).alias("v"))


def write_decisions(yes: DataFrame, no: DataFrame, folder: str, cloud: str = "") -> None:
    """The decisions' document of records from :func:`confirmations` and :func:`rejections`; their number is what users have decided."""
    both = yes.agg(F.collect_list("v").alias("conferme")).crossJoin(no.agg(F.collect_list("v").alias("rifiuti")))  # one row and one row
    write_document(both.select(F.lit(VERSION).alias("versione"), F.lit(cloud).alias("nuvola"), "conferme", "rifiuti"), folder)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """(name, label, signature columns, targets) of a models' document; a missing one has none."""
    doc = spark.read.schema(MODELS_SCHEMA).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], MODELS_SCHEMA)
    code = F.element_at(F.create_map(*(F.lit(x) for k, v in CODE.items() for x in (k, v))), F.upper(F.trim(F.col("m.classe")))).cast("smallint")
    return doc.select(F.explode("modelli").alias("m")).select(F.col("m.nome").alias("name"), code.alias("label"), *from_signature("m."), F.col("m.origine").alias("origin"), F.col("m.bersagli").alias("targets"))


def save_models(spark: SparkSession, new: DataFrame, folder: str) -> None:
    """Models added to the document in ``folder``, or put in the place of those of their names. ``new`` is as :func:`read_models` gives."""
    held = read_models(spark, folder)
    kept = spark.createDataFrame(held.collect(), held.schema)  # read before it is overwritten: a user's models
    models = upsert(kept, new, "name")
    fields = ("dimensioni", "estensione_z", "dist_soffitto", "dist_pavimento", "verticalita", "centro")
    model = F.struct(*(signature_struct().getField(c).alias(c) for c in fields), F.col("name").alias("nome"), key_of(F.col("label")).alias("classe"), F.col("origin").alias("origine"), F.col("targets").alias("bersagli"))
    write_document(models.orderBy("name").agg(F.collect_list(model).alias("modelli")).select(F.lit(VERSION).alias("versione"), "modelli"), folder)


def model_request(text: str) -> tuple[int, str, str | None]:
    """(instance, name, class key or none) of ``ID:NAME[:CLASS]``."""
    got = re.fullmatch(r"\s*(\d+)\s*:([^:]+?)(?::([^:]+))?", text)
    if not got or not got[2].strip():
        raise ValueError(f"{text!r} is not ID:NAME[:CLASS]")
    key = got[3].strip().upper() if got[3] else None
    if key is not None and key not in CODE:
        raise ValueError(f"unknown class {got[3]!r}; valid are {sorted(CODE)}")
    return int(got[1]), got[2].strip(), key


def extract_models(signs: DataFrame, requests: list[str], source: str = "") -> DataFrame:
    """Models of the instances that ``requests`` (``ID:NAME[:CLASS]``) name, out of :func:`review.signature`; without a class the instance's own."""
    spark = signs.sparkSession
    asked = spark.createDataFrame([(i, n, CODE[k] if k else None) for i, n, k in map(model_request, requests)], "instance_id long, name string, wanted int")
    origin = F.struct(F.lit(source).alias("file"), F.col("instance_id").cast("long").alias("istanza"), F.date_format(F.current_date(), "yyyy-MM-dd").alias("data"))
    met = signs.join(F.broadcast(asked), "instance_id")  # a user's list
    return met.select("name", F.coalesce("wanted", "label").cast("smallint").alias("label"), *_SIGN, origin.alias("origin"), F.lit(None).cast("array<string>").alias("targets"))


def preset_classes(name: str) -> list[str]:
    """The classes that an environment excludes."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known are {sorted(PRESETS)}")
    return list(PRESETS[name])


def dataset_status(spark: SparkSession, folder: str) -> DataFrame:
    """(cloud, split, n, n_confirmed) of a training folder, by name; no rows where there is none."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "cloud string, split string, n long, n_confirmed long")
    rows = spark.read.parquet(folder)
    return rows.groupBy("cloud", "split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == 2).alias("n_confirmed")).orderBy("cloud", "split")


def write_dataset_meta(spark: SparkSession, folder: str, cloud: str, origin: str, confirmed_instances: int = 0) -> dict:
    """The entry of ``cloud`` in the data set's ``_meta`` document, which keeps those of other clouds."""
    path = f"{folder.rstrip('/')}/_meta"
    old = [json.loads(r[0]) for r in spark.read.text(path).collect()] if exists(spark, path) else []  # a row a cloud
    status = dataset_status(spark, folder).where(F.col("cloud") == cloud).collect()
    split = {r.split: {"punti": r.n, "confermati": r.n_confirmed} for r in status}
    made = spark.range(1).select(now()).first()[0]
    entry = {"nuvola": cloud, "origine": origin, "esportata": made, "punti": sum(s["punti"] for s in split.values()), "istanze_confermate": confirmed_instances, "punti_confermati": sum(s["confermati"] for s in split.values()), "split": split}
    docs = sorted([e for e in old if e["nuvola"] != cloud] + [entry], key=lambda e: e["nuvola"])
    spark.createDataFrame([(json.dumps(d, ensure_ascii=False),) for d in docs], "value string").coalesce(1).write.mode("overwrite").text(path)
    return entry
