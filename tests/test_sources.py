"""Files in, files out: layouts, settings, directories, images, detection, the whole batch."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from granulo.errors import EmptySourceError, LayoutError, ParticleCsvError, SettingsError
from granulo.functions import geometry, units, values
from granulo.operators import vision
from granulo.plans.batch import Batch
from granulo.sources import directory, images, legacy, particle_csv
from granulo.sources import settings as S


def tiff(image, sem: str | None = None) -> bytes:
    h, w = image.shape
    entries = [(256, 3, 1, w), (257, 3, 1, h), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, 0), (277, 3, 1, 1), (278, 3, 1, h), (279, 4, 1, h * w)]
    text = sem.encode("latin-1") + b"\0" if sem else b""
    if sem:
        entries.append((34118, 2, len(text), 0))
    start = 8 + 2 + 12 * len(entries) + 4
    out = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(entries))
    for tag, kind, n, v in entries:
        v = start if tag == 34118 else start + len(text) if tag == 273 else v
        out += struct.pack("<HHII", tag, kind, n, v)
    return out + struct.pack("<I", 0) + text + image.tobytes()


SEM = "0\r\n0\r\n0\r\n1e-09\r\n0\r\nAP_MAG\r\nMag = 25.00 K X\r\nAP_PIXEL_SIZE\r\nPixel Size = 500 nm\r\n"


def discs(circles, shape=(200, 260)):
    a = np.full(shape, 20, np.uint8)
    y, x = np.mgrid[: shape[0], : shape[1]]
    for p, q, r in circles:
        a[(x - p) ** 2 + (y - q) ** 2 <= r * r] = 220
    return a


def test_layouts(spark, tmp_path):
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "n.csv").write_text("ID,X,Y,R\n30  ,1,2,3  \n2,4,5,6\n")
    (tmp_path / "o.csv").write_text("ID,Radius (pixels),X (pixels),Y (pixels)\n1,3,1,2\n")
    (tmp_path / "i.csv").write_text(" ,Index,Name,Type,X,Y,Width,Height\n1,0,a,Oval,92,267,25,25\n2,1,b,Oval,1,1,2,3\n3,2,c,Rectangle,1,1,2,2\n")
    got = sorted(tuple(r[c] for c in ("ds_id", "ID", "X", "Y", "R")) for r in particle_csv.load(spark, str(tmp_path / "d1" / "n.csv")).collect())
    assert got == [("d1", 2, 4.0, 5.0, 6.0), ("d1", 30, 1.0, 2.0, 3.0)]
    assert [tuple(r) for r in particle_csv.load(spark, str(tmp_path / "i.csv"), "x").select("ID", "X", "Y", "D", "R").collect()] == [(0, 104.5, 279.5, 25.0, 12.5)]
    many = particle_csv.load_many(spark, {"a": str(tmp_path / "d1" / "n.csv"), "b": str(tmp_path / "o.csv"), "c": str(tmp_path / "i.csv")})
    assert sorted((r.ds_id, r.ID, r.R) for r in many.collect()) == [("a", 2, 6.0), ("a", 30, 3.0), ("b", 1, 3.0), ("c", 0, 12.5)]
    assert particle_csv.recognise(["R", "ID", "X", "Y", "Index", "Type", "Width", "Height"]) == "native"
    for bad in (["ID", "X"], ["ID", "X (pixels)", "Y (pixels)", "Radius (pixels)", "Index", "Type", "X", "Y", "Width", "Height"]):
        with pytest.raises(ParticleCsvError):
            particle_csv.recognise(bad)


def settings(images=("a",)):
    s = S.new([f"{x}.tif" for x in images])
    s["data"]["images"] = {k: {**S.IMAGE_DEFAULTS, **v} for k, v in s["data"]["images"].items()}
    return s


def test_settings(tmp_path):
    s = settings()
    assert S.validate(s)["data"]["images"]["a"]["img_file"] == "a.tif"
    s["data"]["images"]["b"] = None
    assert S.validate(s)["data"]["images"]["b"] == {**S.IMAGE_DEFAULTS, "img_file": "", "HCT_file": ""}
    named = S.name_files(S.validate(s))["data"]["images"]["b"]
    assert (named["img_file"], named["HCT_file"]) == ("b.tif", None)  # no particle file is looked for, even if b_HCT.csv is there
    for break_ in (lambda x: x["general"].pop("working_dir"), lambda x: x["analysis"].update(more=1), lambda x: x["data"].update(images=[]), lambda x: x["data"]["images"]["a"].update(d_min="x"), lambda x: x["metadata"]["conditions"].update(t=[1, 2])):
        bad = settings()
        break_(bad)
        assert not S.is_valid(bad)
    with pytest.raises(SettingsError, match="general.working_dir"):
        S.validate({**settings(), "general": {}})
    assert not S.is_valid([1])
    path = S.create(tmp_path, images=["x.tif", "y.tif"])
    loaded = S.load(path)
    assert loaded["data"]["images"]["y"] == {**S.resolve(S.IMAGE_DEFAULTS), "img_file": "y.tif", "HCT_file": "y_HCT.csv"}
    assert loaded["data"]["images"]["x"]["magnification"] is None
    with pytest.raises(FileExistsError):
        S.create(tmp_path, images=[])
    assert path.read_text().count("&default_img") == 1 and path.read_text().count("<<: *default_img") == 2
    assert S.DEFAULTS == S.new([]) and "'" not in S.dump(S.new(["a.tif"]))


def test_value_helpers():
    assert values.is_none("NaN") and values.is_default("Auto") and values.is_default_or_none("") and values.is_true("yes") and values.is_true("1") and not values.is_true("0") and values.is_number("1e3") and not values.is_number(None)
    assert values.to_length(3, 2) == [3, 3] and values.zip_parameters(a=[1, 2], b=3) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    with pytest.raises(ValueError):
        values.to_length([1, 2], 3)
    assert values.interpolate_colours([0, 10, 20], [0, 1, 3], 2) == 15


def test_colours_and_units(spark):
    c = lambda *x: F.array(*[F.lit(v) for v in x])
    one = lambda x: spark.range(1).select(x.alias("x")).first().x
    assert one(geometry.rgb_to_256(c(0.999, 0.5, 0.0, 1.0))) == [254, 127, 0, 255] and one(geometry.rgb_to_unit(c(51, 255))) == [0.2, 1.0]
    assert one(geometry.rgb_shade(c(200, 101, 7, 90), 0.5)) == [100, 50, 3, 90] and one(geometry.rgb_shade(c(200, 10, 0), -0.5)) == [255, 15, 0]
    tags = lambda **x: F.create_map(*[F.lit(v) for k in x.items() for v in k])
    assert one(units.pixel_size(tags(ap_pixel_size="Pixel|500|nm"))) == pytest.approx(5e-7)
    old = F.create_map(F.lit(""), F.lit("0|0|0|1e-09"))
    assert one(units.pixel_size(old)) == 1e-9 and one(units.old_format(old)) and not one(units.old_format(tags(ap_pixel_size="Pixel|500|nm")))
    assert one(units.pixel_size(tags(ap_pixel_size="Pixel|5|ft"), strict=False)) is None
    with pytest.raises(Exception, match="unknown unit of pixel size: ft"):
        one(units.pixel_size(tags(ap_pixel_size="Pixel|5|ft")))


def test_legacy(spark, tmp_path):
    (tmp_path / "s.csv").write_text("img_name;a.tif\nmagnification;25000\nDmin;3;px\nDmax;50;px\n")
    assert tuple(legacy.image_settings(spark, str(tmp_path / "s.csv")).first())[1:] == ("a.tif", 25000.0, 3.0, 50.0)
    sets, ignore = spark.createDataFrame([("D1",), ("D2",)], "ds_id string"), spark.createDataFrame([("x/D1.tif",)], "name string")
    assert [r[0] for r in legacy.not_ignored(sets, ignore).collect()] == ["D2"]
    more = legacy.deactivate(ignore, spark.createDataFrame([("D2",)], "name string"))
    assert more.count() == 2 and legacy.activate(more, ignore).count() == 1


def test_legacy_folders(tmp_path):
    for name in ("A-1", "A-2", "B-1"):
        (tmp_path / "x" / name).mkdir(parents=True)
        (tmp_path / "x" / name / f"{name}.tif").write_bytes(b"")
        (tmp_path / "x" / name / f"{name}_names.csv").write_text("img_name;x")
    (tmp_path / "x" / "empty").mkdir()
    (tmp_path / "ignore.csv").write_text("images/A-2.tif\n")
    assert [p.name for p in legacy.find_datasets(tmp_path)] == ["A-1", "B-1"] and len(legacy.find_datasets(tmp_path, ignore=False)) == 3


def test_tiff_and_vision():
    a = discs([(60, 60, 20), (150, 80, 35), (210, 150, 12)])
    assert (images.pixels(tiff(a)) == a).all()
    t = images.tags(tiff(a, SEM))
    assert t["ap_pixel_size"] == "Pixel Size|500|nm" and t["ap_mag"] == "Mag|25.00 K X" and t[""].split("|")[3] == "1e-09"
    found = vision.hough_circles(vision.median_blur(a, 3), 20, 80, 0.5, 200, 15)
    for x, y, r in ((60, 60, 20), (150, 80, 35), (210, 150, 12)):
        assert min(abs(f - [x, y, r]).max() for f in found) < 3
    assert len(found) <= 4 and vision.hough_circles(np.zeros((50, 50), np.uint8), 4, 20).shape == (0, 3)
    assert vision.crop(a, 0.25).shape == (150, 260)
    with pytest.raises(ValueError):
        vision.crop(a, 1.0)


def test_batch_from_directory(spark, tmp_path):
    s = S.new(["p.tif", "q.tif"])
    text = S.dump(s).replace("PSD_space: null", "PSD_space: {start: 0.0, end: 1.0e-4, periods: 10, log: false, step: false}").replace("d_min: &", "d_min: &").replace("- 3\n    - 50\n", "- 20\n    - 20\n", 1).replace("- 50\n    - 140\n", "- 90\n    - 90\n", 1)
    (tmp_path / "settings.yml").write_text(text)
    for name in ("p", "q"):
        (tmp_path / f"{name}.tif").write_bytes(tiff(discs([(60, 60, 20), (90, 60, 15), (200, 150, 20)]), SEM))
    with pytest.raises(LayoutError):
        directory.validate(tmp_path)
    directory.initialise(tmp_path)
    assert directory.is_valid(tmp_path) and len(directory.find_images(tmp_path)) == 2
    (tmp_path / "images" / "p" / "p_HCT.csv").write_text("ID,X,Y,R\n0,60,60,20\n1,90,60,15\n2,200,150,20\n")
    b = Batch.open(spark, str(tmp_path))
    d = {r.ds_id: r for r in b.dataset_summary().collect()}
    assert d.keys() == {"p", "q"} and (d["p"].N_primary_particle, d["p"].N_agl) == (3, 1)
    assert d["q"].N_primary_particle >= 3
    one = {r.ID: r for r in b.particle_table(True).filter("`DS ID` = 'p'").collect()}
    assert one[0].D == pytest.approx(40 * 5e-7) and one[0].X == pytest.approx(60 * 5e-7) and one[0].type == "similar" and one[2].type == "separate"
    assert b.psd().count() == 10
    assert repr(b).startswith("Batch(path=") and b.described().filter("`DS ID` = 'p' and ID = 0").first().text.startswith("P0: D=")
    assert 'cx="60.0" cy="60.0" r="20.0"' in b.pictures().filter("ds_id = 'p'").first().svg
    b.export(str(tmp_path / "out"), [0.0, 1.0, 2.0, 5.0], form="csv")
    assert len([p for p in (tmp_path / "out").iterdir()]) == 9
    assert sum(r.counts for r in b.agl_pcd([0.0, 1.0, 100.0]).collect()) == b.agglomerates.count()
    with pytest.raises(EmptySourceError):
        Batch(spark.createDataFrame([], "ds_id string, ID long, X double, Y double, R double"))
    source = spark.createDataFrame([("a", 1, 0.0, 0.0, 1.0), ("b", 1, 0.0, 0.0, 1.0)], "ds_id string, ID long, X double, Y double, R double")
    for size in (0.0, None):
        with pytest.raises(EmptySourceError, match="'b'"):
            Batch(source, spark.createDataFrame([("a", 1.0), ("b", size)], "ds_id string, px_size double"))
