"""The partitioned source of binary clouds: E57 files there and back, and the same rows however a file is cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.sources import blocks, e57, formats, readers

from .e57_files import e57_file


def test_crc_of_known_bytes():
    assert e57.crc32c(np.frombuffer(b"123456789", np.uint8)[None]).tolist() == [0xE3069283]


@pytest.mark.parametrize("bits", [0, 1, 3, 7, 8, 13, 31, 32, 57, 58, 63])
def test_bit_packed_values(bits):
    draw = np.random.default_rng(bits)
    low = -5
    values = [low + int.from_bytes(draw.bytes(8), "little") % (1 << bits) for _ in range(50)]
    from .e57_files import packed

    f = e57.Field("v", "integer", bits, low, low + (1 << bits) - 1)
    data = packed(values, low, bits) if bits else b""
    assert f.values(data, 0, 50).tolist() == values
    assert f.values(data[7 * bits // 8 :], 7 * bits % 8, 20).tolist() == values[7:27]


def scan_of(draw, n, colour=True, intensity=True, most=255, pose=None, kind="double"):
    xyz = draw.uniform(-9, 9, (n, 3))
    fields = {}
    for k, c in enumerate("XYZ"):
        if kind == "scaled":
            fields[f"cartesian{c}"] = ("ScaledInteger", np.rint(xyz[:, k] * 1000).astype(int), {"minimum": -10_000, "maximum": 10_001, "scale": 0.001, "offset": 0})
        else:
            fields[f"cartesian{c}"] = (kind, xyz[:, k], {})
    fields["cartesianInvalidState"] = ("Integer", draw.integers(0, 5, n) // 4 * 2, {"minimum": 0, "maximum": 2})
    if colour:
        fields |= {f"color{c}": ("Integer", draw.integers(0, most + 1, n), {"minimum": 0, "maximum": most}) for c in ("Red", "Green", "Blue")}
    if intensity:
        fields["intensity"] = ("single", draw.random(n), {})
    return {"fields": fields, "pose": pose}


def expected(scans):
    out, row = [], 0
    for s in scans:
        f = {k: np.asarray(v[1], float) * v[2].get("scale", 1.0) for k, v in s["fields"].items()}
        xyz = np.stack([f[f"cartesian{c}"] for c in "XYZ"], axis=1)
        if s["pose"]:
            w, x, y, z = np.array(s["pose"][:4]) / np.linalg.norm(s["pose"][:4])
            q = np.array([x, y, z])
            xyz = xyz + 2 * np.cross(q, np.cross(q, xyz) + w * xyz) + np.array(s["pose"][4:])
        for i in np.flatnonzero(f["cartesianInvalidState"] == 0):
            out.append((row + int(i), *xyz[i]))
        row += len(xyz)
    return out


def test_e57_scans_round_trip(spark, tmp_path):
    draw = np.random.default_rng(1)
    scans = [scan_of(draw, 700, pose=(0.8, 0.1, -0.5, 0.3, 5.0, -2.0, 1.0)), scan_of(draw, 0), scan_of(draw, 333, kind="scaled"), scan_of(draw, 90, kind="single")]
    (tmp_path / "a.e57").write_bytes(e57_file(scans))
    path = f"file://{tmp_path}/a.e57"
    want = expected(scans)
    frames = [readers.read_binary(spark, path, block_rows=n).toPandas().sort_values("pid", ignore_index=True) for n in (10_000, 101, 8)]
    for got in frames:
        assert (got["pid"] - got["pid"].min() == np.array([w[0] for w in want]) - want[0][0]).all()
        assert np.abs(got[["x", "y", "z"]].to_numpy() - np.array([w[1:] for w in want])).max() < 1e-5
        assert got.equals(frames[0]) and got["intensity"].notna().all() and got["r"].between(0, 255).all()
    assert readers.count_points(spark, path) == 1123
    some = readers.read_binary(spark, path, ("z", "intensity"))
    assert some.columns == ["z", "intensity"] and np.allclose(np.sort(some.toPandas()["z"]), np.sort(frames[0]["z"]))


def test_e57_decoding_reads_the_streams_asked_for(tmp_path, monkeypatch):
    (tmp_path / "a.e57").write_bytes(e57_file([scan_of(np.random.default_rng(2), 50)]))
    seen = []
    values = e57.Field.values
    monkeypatch.setattr(e57.Field, "values", lambda self, *a: seen.append(self.name) or values(self, *a))
    (block,) = blocks.blocks_of(f"file://{tmp_path}/a.e57")
    assert set(blocks.columns_of(block, ["intensity"])) == {"row", "intensity"} and seen == ["intensity", "cartesianInvalidState"]


def test_e57_colours(spark, tmp_path):
    """16-bit colours come down to bytes by file; a file keeps what every scan has; a broken page is an error."""
    draw = np.random.default_rng(3)
    wide = scan_of(draw, 40, most=65535, intensity=False)
    wide["fields"]["colorRed"] = ("Integer", np.full(40, 65535), {"minimum": 0, "maximum": 65535})
    (tmp_path / "w.e57").write_bytes(e57_file([wide, scan_of(draw, 5)]))
    (tmp_path / "n.e57").write_bytes(e57_file([scan_of(draw, 40, most=65535 // 300), scan_of(draw, 5, colour=False)]))
    got = readers.read_points(spark, f"file://{tmp_path}/w.e57")
    assert got.agg(F.max("r"), F.max("g"), F.count("intensity")).first()[0::2] == (255, 0)
    assert got.where("intensity is not null or r is null").count() == 0
    assert readers.read_points(spark, f"file://{tmp_path}/n.e57").where("r is not null").count() == 0
    data = bytearray((tmp_path / "n.e57").read_bytes())
    data[200] ^= 1
    (tmp_path / "bad.e57").write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        readers.read_points(spark, f"file://{tmp_path}/bad.e57").count()
    spherical = {"fields": {"sphericalRange": ("double", [1.0], {})}, "pose": None}
    (tmp_path / "s.e57").write_bytes(e57_file([spherical]))
    with pytest.raises(Exception, match="cartesian"):
        readers.read_points(spark, f"file://{tmp_path}/s.e57").count()
    (tmp_path / "x.e57").write_bytes(b"nothing at all" * 100)
    with pytest.raises(ValueError, match="not an E57"):
        readers.count_points(spark, f"file://{tmp_path}/x.e57")


@pytest.mark.parametrize("kind", ["ply", "las", "pcd"])
def test_same_rows_however_a_file_is_cut(spark, tmp_path, kind):
    draw = np.random.default_rng(4)
    n = 5000
    xyz, rgb, classe = draw.uniform(-5, 5, (n, 3)), draw.integers(0, 256, (n, 3)), draw.integers(0, 17, n)
    if kind == "pcd":
        rec = np.zeros(n, [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("rgb", "<u4")])
        rec["x"], rec["y"], rec["z"] = xyz.T
        rec["rgb"] = rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]
        data = f"VERSION .7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA binary\n".encode() + rec.tobytes()
    else:
        data = (formats.classified_ply if kind == "ply" else formats.las_file)(*xyz.T, *rgb.T, classe)
    (tmp_path / f"a.{kind}").write_bytes(data)
    path = f"file://{tmp_path}/a.{kind}"
    whole, cut = (readers.read_binary(spark, path, block_rows=m) for m in (10_000, 777))
    assert len(blocks.blocks_of(path, 777)) == 7 and cut.rdd.getNumPartitions() >= 7
    a, b = (d.toPandas().sort_values("pid", ignore_index=True) for d in (whole, cut))
    assert a.equals(b) and len(a) == n and np.abs(a[["x", "y", "z"]].to_numpy() - xyz).max() < 1e-3
    assert (a[["r", "g", "b"]].to_numpy() == rgb).all() and (kind == "pcd" or (a["classe"] == classe).all())


def test_colour_scale_is_the_files_not_a_blocks(spark, tmp_path):
    """A LAS file with one wide colour in its last block scales all its blocks; one without scales none."""
    n = 3000
    data = bytearray(formats.las_file(*np.zeros((3, n)), *np.zeros((3, n), int), np.zeros(n, int)))
    record = np.frombuffer(data, np.uint8)[375:].reshape(n, 36).copy()
    record[:, 30:32] = np.array([200], "<u2").view(np.uint8)
    for name, last in (("narrow", 255), ("wide", 40000)):
        record[-1, 30:32] = np.array([last], "<u2").view(np.uint8)
        (tmp_path / f"{name}.las").write_bytes(bytes(data[:375]) + record.tobytes())
    got = readers.read_binary(spark, f"file://{tmp_path}/*.las", block_rows=1000).groupBy("source").agg(F.min("r").alias("low"), F.max("r").alias("high")).collect()
    assert {r.source.rpartition("/")[2]: (r.low, r.high) for r in got} == {"narrow.las": (200, 255), "wide.las": (1, 156)}
