"""Files of every format, there and back; routed groups; the stream; the registry."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import dataset, voxel
from cloudloom.plans.model import POINT_SCHEMA
from cloudloom.sources import documents, formats, readers, writers
from cloudloom.streaming import accumulator

COUNTS = {13: 50, 12: 30, 1: 40, 5: 20, 16: 15, 10: 10}


@pytest.fixture
def mixed(spark):
    draw = np.random.default_rng(0)
    label = np.repeat(list(COUNTS), list(COUNTS.values()))
    xyz = draw.uniform(-5, 5, (len(label), 3))
    return spark.createDataFrame(pd.DataFrame({"pid": range(len(label)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "label": label.astype("int16")}))


@pytest.mark.parametrize("kind", ["ply", "las"])
def test_classified_files_round_trip(spark, mixed, tmp_path, kind):
    folder = f"file://{tmp_path}/{kind}"
    listed = writers.write_classified(mixed.repartition(3), folder, kind)
    assert listed.agg(F.sum("n")).first()[0] == 165 == readers.count_points(spark, f"{folder}/*.{kind}")
    got = readers.read_classified(spark, f"{folder}/*.{kind}").toPandas()
    assert got.label.value_counts().to_dict() == COUNTS and got.pid.is_unique
    want = np.sort(mixed.toPandas()[["x", "y", "z"]].sum(axis=1))
    assert np.abs(np.sort(got[["x", "y", "z"]].sum(axis=1)) - want).max() < 2e-3
    assert set(map(tuple, got[got.label == 5][["r", "g", "b"]].to_numpy().tolist())) == {(255, 220, 0)}


def test_groups_are_routed(spark, mixed, tmp_path):
    assert list(writers.write_grouped(mixed, f"file://{tmp_path}/g")) == ["strutturale", "mep", "scarto"]
    got = {r[0]: r[1] for r in spark.read.parquet(f"file://{tmp_path}/g").groupBy("macro_group").count().collect()}
    assert got == {"strutturale": 80, "mep": 60, "scarto": 25}
    assert list(writers.write_grouped(mixed.where("label = 1"), f"file://{tmp_path}/one")) == ["mep"]


def test_text_and_errors(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("1 2 3 0.5 1 0\n4,5,6,0,0,1\n\n# note\n")
    got = readers.read_points(spark, f"file://{tmp_path}/a.xyz").orderBy("x").collect()
    assert [(r.x, r.r, r.g, r.b, r.intensity) for r in got] == [(1.0, 128, 255, 0, None), (4.0, 0, 0, 255, None)]
    (tmp_path / "b.txt").write_text("1 2 3 7.5\n")
    assert readers.read_points(spark, f"file://{tmp_path}/b.txt").first().intensity == 7.5
    (tmp_path / "c.asc").write_text("1 2\n")
    for path, error in (("c.asc", ValueError), ("none.ply", FileNotFoundError), ("d.doc", ValueError)):
        with pytest.raises(error):
            readers.read_points(spark, f"file://{tmp_path}/{path}")


def test_ascii_ply_and_pcd(spark, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n1 2 3 4 5 6\n7 8 9 1 2 3\n")
    assert sorted((r.x, r.g) for r in readers.read_points(spark, f"file://{tmp_path}/a.ply").collect()) == [(1.0, 5), (7.0, 2)]
    head = b"VERSION .7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA binary\n"
    (tmp_path / "b.pcd").write_bytes(head + np.arange(8, dtype="<f4").tobytes())
    assert sorted((r.x, r.intensity) for r in readers.read_points(spark, f"file://{tmp_path}/b.pcd").collect()) == [(0.0, 3.0), (4.0, 7.0)]
    with pytest.raises(ValueError):
        formats.ply_layout(b"nothing")


def test_public_dataset(spark, tmp_path):
    draw = np.random.default_rng(0)
    for area in (1, 2):
        at = tmp_path / f"Area_{area}/Room_1/Annotations"
        at.mkdir(parents=True)
        for name in ("pipe", "pump", "ibeam", "valve"):
            np.savetxt(at / f"{name}_{area}.txt", np.column_stack([draw.random((50, 3)) * 3, draw.integers(0, 256, (50, 3))]), fmt="%.6f")
    mapping = {"pipe": "TUBAZIONE", "pump": "APPARECCHIATURA", "i": "LUCE", "ibeam": "TRAVE"}
    got = readers.read_public_dataset(spark, f"file://{tmp_path}", mapping, 0.001, "Area_2")
    assert {(r.split, r.label): r["count"] for r in got.groupBy("split", "label").count().collect()} == {(s, c): 50 for s in ("train", "val") for c in (3, 8, 15)}
    assert got.where("confidence <> 2").count() == 0
    with pytest.raises(ValueError):
        readers.read_public_dataset(spark, f"file://{tmp_path}", {"x": "MURO"})


def test_scans_keep_what_all_have(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1, 2, 3, 0.5, "a")], POINT_SCHEMA)
    got = readers.union_scans([a, a.drop("intensity")])
    assert got.where("intensity is not null").count() == 0 and got.where("r = 1").count() == 2
    turned = readers.transform_rigid(a.withColumns({"x": F.lit(1.0), "invalid": F.lit(0)}), [[0, -1, 0], [1, 0, 0], [0, 0, 1]], [0, 0, 5]).first()
    assert (turned.x, turned.y, turned.z) == (0.0, 1.0, 5.0)


def test_decisions_file(spark, tmp_path):
    sign = '{"dimensioni": [1.0, 0.5, 0.1], "estensione_z": 0.1, "dist_soffitto": 0.2, "dist_pavimento": 2.0, "verticalita": 0.1, "centro": [1.0, 2.0, 3.0]}'
    (tmp_path / "c.json").write_text('{"versione": 1, "nuvola": "a", "conferme": [{"firma": %s, "classe": "luce", "nome": "x", "origine": "o", "quando": "t"}], "rifiuti": []}' % sign)
    yes, no = readers.read_confirmations(spark, f"file://{tmp_path}/c.json")
    assert (yes.first().label, yes.first().cy, no.count()) == (5, 2.0, 0)
    assert readers.read_confirmations(spark, f"file://{tmp_path}/none.json")[0].count() == 0


def signs_of(spark):
    rows = [(1, 3, 1.0, 0.5, 0.1, 0.1, 0.2, 2.0, 0.1, 1.0, 2.0, 3.0, 9), (2, 5, 2.0, 0.4, 0.2, 0.3, 0.1, 2.5, 0.9, 4.0, 5.0, 6.0, None)]
    return spark.createDataFrame(rows, "instance_id long, label smallint, d1 double, d2 double, d3 double, z_extent double, to_ceiling double, to_floor double, verticality double, cx double, cy double, cz double, label_before smallint")


def test_decisions_round_trip(spark, tmp_path):
    s, path = signs_of(spark), f"file://{tmp_path}/decisions"
    documents.write_decisions(documents.confirmations(s), documents.rejections(s.where("instance_id = 2")), path, "cloud a")
    yes, no = readers.read_confirmations(spark, path)
    assert sorted((r.label, r.d1, r.cz) for r in yes.collect()) == [(3, 1.0, 3.0), (5, 2.0, 6.0)] and no.first().verticality == 0.9
    doc = spark.read.json(path).first()
    assert doc.nuvola == "cloud a" and doc.conferme[0].classe_precedente == "mep_generico" and doc.rifiuti[0].classe_rifiutata == "luce" and len(doc.conferme[0].quando) == 19


def test_models_are_replaced_by_name(spark, tmp_path):
    s, path = signs_of(spark), f"file://{tmp_path}/models"
    assert documents.read_models(spark, path).count() == 0
    documents.save_models(spark, documents.extract_models(s, ["1:pump", "2: lamp :luce"], "a.las"), path)
    documents.save_models(spark, documents.extract_models(s, ["2:pump:Tubazione"], "b.las"), path)
    got = {r.name: (r.label, r.d1, r.origin.file, r.origin.istanza) for r in documents.read_models(spark, path).collect()}
    assert got == {"lamp": (5, 2.0, "a.las", 2), "pump": (3, 2.0, "b.las", 2)}
    for wrong in ("x:y", "1", "1:", "1:a:muro", "1:a:luce:b"):
        with pytest.raises(ValueError):
            documents.model_request(wrong)


def test_report_reads_back(spark, tmp_path):
    points = spark.createDataFrame([(0.0, 0.0, 0.0, 3, 7), (1.0, 0.0, 0.0, 9, 0)], "x double, y double, z double, label smallint, instance_id long")
    vector = lambda *v: F.array(*map(F.lit, v))
    instances = points.where("instance_id > 0").select("instance_id", "label").withColumns({
        "n": F.lit(1), "centre": vector(1.23456, 0.0, 0.0), "dims": vector(1.0, 0.5, 0.1), "top": F.lit(1.0), "bottom": F.lit(0.0), "robust_z": F.lit(1.0), "to_ceiling": F.lit(0.5), "to_floor": F.lit(1.0),
        "verticality": F.lit(0.0), "cylinder": F.struct(F.lit(True).alias("valid"), F.lit(0.05).alias("radius"), F.lit(1.0).alias("length"), vector(0.12346, 0.0, 1.0).alias("axis")), "colour": F.array(F.lit(1), F.lit(2), F.lit(3)), "uniformity": F.lit(0.9),
    })
    planes = spark.createDataFrame([(0, "horizontal")], "plane_id int, kind string")
    doc = writers.write_report(points, instances, f"file://{tmp_path}/r", planes, 3.0, 0.0)
    assert doc["punti_totali"] == 2 and len(doc["punti_per_classe"]) == 17 and doc["quota_soffitto"] == 3.0
    got = readers.read_report(spark, f"file://{tmp_path}/r").first()
    assert (got.id, got.centro_x, got.asse_x, got.raggio_stimato, list(got.colore_rgb)) == (7, 1.235, 0.1235, 0.05, [1, 2, 3])
    whole = spark.read.json(f"file://{tmp_path}/r/report").first()
    assert whole.piani_strutturali[0].kind == "horizontal" and whole.n_istanze_mep == 1
    writers.write_report(points, instances.limit(0), f"file://{tmp_path}/none")
    assert spark.read.json(f"file://{tmp_path}/none/report").first().n_istanze_mep == 0


def test_groups_as_las_files(spark, tmp_path):
    points = spark.createDataFrame([(float(i), 0.0, 0.0, (1, 9, 16)[i % 3]) for i in range(30)], "x double, y double, z double, label smallint")
    got = writers.write_grouped(points, f"file://{tmp_path}/g", "las")
    assert sum(readers.count_points(spark, f"{folder}/*.las") for folder in got.values()) == 30
    back = readers.read_classified(spark, f"{got['mep']}/*.las")
    assert {r.label for r in back.select("label").distinct().collect()} == {1, 9}


def test_each_file_has_its_own_colour_scale(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("0 0 0 1 0.5 0\n")
    (tmp_path / "b.xyz").write_text("1 0 0 255 128 0\n")
    got = sorted((r.x, r.r, r.g) for r in readers.read_text(spark, f"file://{tmp_path}/*.xyz").collect())
    assert got == [(0.0, 255, 128), (1.0, 255, 128)]


def test_dataset_status_and_meta(spark, tmp_path):
    folder = f"file://{tmp_path}/set"
    assert documents.dataset_status(spark, folder).count() == 0
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 3, 2, "train", "a"), (1.0, 0.0, 0.0, 3, 1, "val", "a")], "x double, y double, z double, label int, confidence int, split string, cloud string")
    writers.write_training(rows, folder)
    assert [tuple(r) for r in documents.dataset_status(spark, folder).collect()] == [("a", "train", 1, 1), ("a", "val", 1, 0)]
    for _ in range(2):
        entry = documents.write_dataset_meta(spark, folder, "a", "a.ply", 4)
    assert entry["punti"] == 2 and entry["punti_confermati"] == 1 and spark.read.text(f"{folder}/_meta").count() == 1
    assert documents.dataset_status(spark, folder).count() == 2


def test_command_line_rejects_what_it_cannot_do(capsys):
    from cloudloom.__main__ import main, parser

    for wrong in (["a.ply", "o", "--save-model", "1:x"], ["a.ply", "o", "--models", "m", "--save-model", "x"], ["a.ply", "o", "--preset", "moon"], ["a.ply", "o", "--exclude", "muro"], ["a.ply"], ["a.ply", "o", "--bbox", "0,0,1"], ["a.ply", "o", "--bbox", "0,0,0,1,1,x"], ["a.ply", "o", "--margin", "1"]):
        with pytest.raises(SystemExit):
            main(wrong)
    with pytest.raises(SystemExit) as end:
        main(["--check"])
    assert end.value.code == 0 and "pyarrow: " in capsys.readouterr().out
    assert parser().parse_args(["a.ply", "o", "--bbox", "0,0,0,1,2,3", "--margin", "0.5"]).bbox == (0, 0, 0, 1, 2, 3)
    assert parser().parse_args(["a.ply", "o", "--preset", "data_center"]).preset == "data_center"


def test_mean_iou_over_confident_rows(spark):
    rows = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 2, 1), (3, 1, 0)], "truth int, predicted int, confidence int")
    assert dataset.mean_iou(dataset.confusion(rows, confidence="confidence")).first()[0] == pytest.approx(0.5)


def test_stream_equals_batch(spark, tmp_path):
    draw = np.random.default_rng(1)
    rows = spark.createDataFrame(pd.DataFrame({"pid": range(300), **{c: draw.random(300) for c in "xyz"}}))
    for k in range(3):
        rows.where(F.col("pid") % 3 == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    blocks = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = accumulator.voxel_stream(blocks, 0.25).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.rid: (r.n, round(r.x, 9)) for r in voxel.voxel_centroids(spark.table("sums")).collect()}
    assert got == {r.rid: (r.n, round(r.x, 9)) for r in voxel.voxel_downsample(rows, 0.25).collect()}
    reduced = voxel.voxel_downsample(rows, 0.25).withColumnRenamed("rid", "pid").withColumn("label", F.when(F.col("x") < 0.5, 1).otherwise(16).cast("smallint"))
    accumulator.export_stream(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), reduced, f"file://{tmp_path}/out", f"file://{tmp_path}/ck2", 0.25).awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 300


def test_registry():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
