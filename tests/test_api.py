import struct
import zlib

import numpy as np
import pytest

from roiforge.operators import output
from roiforge.plans.api import ImageQuality, NestedRois, SlideFeatures, VolumeFeatures, featurize, resampled
from roiforge.plans.registry import FAMILIES, PROVIDER, USER, ordered_families, register_feature, resolve
from roiforge.sources import formats
from roiforge.sources.arrays import montage
from roiforge.sources.images import files, image_pixels, quantised, stacked_pixels, zarr_pixels


def small_tiff(image: np.ndarray, tiled: bool = False) -> bytes:
    h, w = image.shape
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    block = np.zeros((16, 16), image.dtype)
    block[:h, :w] = image
    data = zlib.compress((block if tiled else image).tobytes())
    tags = [(256, w), (257, h), (258, image.dtype.itemsize * 8), (259, 8)]
    tags += [(322, 16), (323, 16), (324, 8), (325, len(data))] if tiled else [(273, 8), (278, h), (279, len(data))]
    tags = sorted([*tags, (339, kind)])
    body = b"II" + struct.pack("<HI", 42, 8 + len(data)) + data + struct.pack("<H", len(tags))
    return body + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + struct.pack("<I", 0)


def small_nifti(values: np.ndarray, slope: float, intercept: float) -> bytes:
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *values.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, 4, 16)
    struct.pack_into("<3f", head, 108, 352, slope, intercept)
    return bytes(head) + values.astype("<i2").tobytes()


def small_dicom(values: np.ndarray) -> bytes:
    us = lambda g, e, v: struct.pack("<HH2sHH", g, e, b"US", 2, v)
    text = lambda g, e, vr, v: struct.pack("<HH2sH", g, e, vr, len(v)) + v
    raw = values.astype("<i2").tobytes()
    return b"\0" * 128 + b"DICM" + text(2, 0x10, b"UI", b"1.2.840.10008.1.2.1\0") + us(0x28, 0x10, values.shape[0]) + us(0x28, 0x11, values.shape[1]) + us(0x28, 0x100, 16) + us(0x28, 0x103, 1) + text(0x28, 0x1052, b"DS", b"-1024 ") + text(0x28, 0x1053, b"DS", b"2 ") + struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OW", 0, len(raw)) + raw


def test_selection():
    assert len(PROVIDER) > 690 and resolve("mean, ,-mean") == [] and resolve("*ALL_INTENSITY*,-COV")[0] == "COVERED_IMAGE_INTENSITY_RANGE"
    assert "IH_MEAN_VAL" not in resolve(["*ALL*", "IH_MEAN_VAL"]) and "IH_MEAN_VAL" in resolve("IH_MEAN_VAL", ibsi=True)
    assert "GABOR" not in resolve("*ALL_BUT_GABOR*") and "GLCM_ASM" not in resolve("*ALL_BUT_GLCM*")
    with pytest.raises(ValueError, match="unknown"):
        resolve("NO_SUCH")
    order = ordered_families(["POLYGONALITY_AVE"])
    assert order.index("contour") < order.index("polygons") and order.index("morphology") < order.index("neighbours")


def test_decoders():
    image = np.arange(35, dtype=np.uint16).reshape(5, 7)
    for tiled in (False, True):
        assert np.array_equal(formats.decode("a.tif", small_tiff(image, tiled))[0, 0], image)
    assert np.array_equal(formats.decode("a.ome.tif", small_tiff(image.astype(np.float32)))[0, 0], image)
    cube = np.arange(24).reshape(2, 3, 4) - 5
    assert np.allclose(formats.decode("v.nii", small_nifti(cube, 2, -1024))[0], cube * 2 - 1024)
    assert np.allclose(formats.decode("d.dcm", small_dicom(cube[0]))[0, 0], cube[0] * 2 - 1024)
    with pytest.raises(ValueError, match="no decoder"):
        formats.decode("a.bmp", b"")


def test_folders(spark, tmp_path):
    image = (np.arange(48, dtype=np.uint16).reshape(6, 8) % 9) + 1
    mask = np.zeros((6, 8), np.uint8)
    mask[1:3, 1:4], mask[4:6, 5:8] = 1, 2
    for folder, data in (("int", image), ("seg", mask)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "p0_y1.tif").write_bytes(small_tiff(data))
    assert files(spark, str(tmp_path / "int"), r"p\d.*").count() == 1
    px = image_pixels(spark, str(tmp_path / "int"), str(tmp_path / "seg"))
    assert px.count() == 12 and {r[0] for r in px.select("label").distinct().collect()} == {1, 2}
    found = SlideFeatures("*ALL_INTENSITY*,AREA_PIXELS_COUNT", spark, histogram_bins=4).featurize_directory(str(tmp_path / "int"), str(tmp_path / "seg"))
    assert found.count() == 2 and "HISTOGRAM_3" in found.columns
    (tmp_path / "st").mkdir()
    for z in (1, 2):
        (tmp_path / "st" / f"v_z{z}.tif").write_bytes(small_tiff(image))
    assert stacked_pixels(spark, str(tmp_path / "st")).groupBy("z").count().count() == 2


def test_zarr(spark, tmp_path):
    store = tmp_path / "a.zarr" / "0"
    store.mkdir(parents=True)
    (store / ".zarray").write_text('{"chunks":[1,1,1,4,4],"shape":[1,1,1,6,5],"dtype":"<u2","compressor":{"id":"zlib"},"order":"C"}')
    whole = np.add.outer(np.arange(8), np.arange(8)).astype("<u2")
    for r in (0, 1):
        for c in (0, 1):
            (store / f"0.0.0.{r}.{c}").write_bytes(zlib.compress(whole[4 * r : 4 * r + 4, 4 * c : 4 * c + 4].tobytes()))
    px = zarr_pixels(spark, str(tmp_path / "a.zarr"))
    assert px.count() == 30 and px.agg({"value": "sum"}).first()[0] == whole[:6, :5].sum()


def test_featurize_and_classes(spark, tmp_path):
    rng = np.random.default_rng(1)
    image = rng.integers(1, 60, (2, 12, 12))
    mask = np.zeros((2, 12, 12), int)
    mask[:, 1:7, 1:7], mask[:, 8:11, 6:11] = 1, 2
    engine = SlideFeatures("MEAN,GLCM_ASM,GLSZM_ZP,PERIMETER,ZERNIKE2D,GLRLM_SRE_AVE,NUM_NEIGHBORS", spark, coarse_gray_depth=8)
    found = engine.featurize(image, mask, ["a", "b"]).cache()
    assert found.count() == 4 and {"GLCM_ASM_0", "GLCM_ASM_135", "ZERNIKE2D_Z29", "MEAN"} <= set(found.columns) and "CIRCULARITY" not in found.columns
    row = found.where("slide_id = 'a' and label = 1").first()
    assert row["MEAN"] == pytest.approx(image[0, 1:7, 1:7].mean())
    engine.blacklist_roi("1")
    assert engine.featurize(image, mask).count() == 2
    engine.set_metaparam("glcm/offset=2")
    assert engine.get_metaparam("glcm/offset") == 2 and engine.get_params("ibsi") == {"ibsi": False}
    engine.set_metaparam("3gldm/greydepth=12")
    assert engine.get_metaparam("3gldm/greydepth") == 12 and engine.get_metaparam("glcm/greydepth") == 8 and engine.get_metaparam("3ngtdm/radius") == 1
    assert engine.roi_blacklist_summary() == "global: 1"
    for wrong in ({"neighbor_distance": 0}, {"anisotropy_x": -1.0}, {"gabor_freqs": (1.0,)}):
        with pytest.raises(ValueError):
            engine.set_params(**wrong)
    with pytest.raises(ValueError, match="no such"):
        engine.set_metaparam("glcm/colour=1")
    engine.set_metaparam("3glcm/numang=4")
    engine.set_metaparam("3glcm/sparseintensities=true")
    assert engine.get_metaparam("3glcm/numang") == 4 and engine.get_metaparam("3glcm/sparseintensities") is True
    with pytest.raises(ValueError, match="true or false"):
        engine.set_metaparam("3glcm/sparseintensities=2")
    assert ImageQuality("FOCUS_SCORE,MAX_SATURATION", spark).featurize(image, np.ones_like(image)).count() == 2
    assert VolumeFeatures("3MEAN,3AREA", spark).featurize(image, mask).count() == 2
    for name in ("f.csv", "f.parquet", "f.arrow"):
        output.write(found, str(tmp_path / name), single=True)
    assert spark.read.parquet(str(tmp_path / "f.parquet")).count() == 4 and spark.read.option("header", True).csv(str(tmp_path / "f.csv")).count() == 4
    import pyarrow as pa

    assert pa.ipc.open_file(str(tmp_path / "f.arrow")).read_all().num_rows == 4
    nested = NestedRois("MEAN")
    px = montage(spark, mask, mask)
    assert nested.find_relations(px.where("label = 1"), px.where("label = 1")).count() == 2


def test_user_family(spark):
    @register_feature("spread", ["MY_SPREAD"])
    def spread(pixels):
        return pixels.groupBy("slide_id", "t", "label").agg({"inten": "max"}).withColumnRenamed("max(inten)", "MY_SPREAD").selectExpr("slide_id", "t", "label", "cast(MY_SPREAD as double) MY_SPREAD")

    try:
        assert featurize(montage(spark, np.full((3, 3), 4)), "MY_SPREAD").first()["MY_SPREAD"] == 4
        with pytest.raises(ValueError, match="already"):
            register_feature("spread", ["MY_SPREAD"])(spread)
    finally:
        FAMILIES.pop("spread"), PROVIDER.pop("MY_SPREAD"), USER.functions.pop("spread")


def test_quantising_and_resampling(spark):
    raw = spark.createDataFrame([(v, real, -10.5, 20.0) for real in (True, False) for v in (-10.5, 0.0, 20.0)], "value double, real boolean, lo double, hi double")
    found = lambda *a, **k: [r[0] for r in quantised(raw, *a, **k).collect()]
    assert found("hounsfield")[:3] == [1, 11, 31] and found("float", dynamic_range=100)[:3] == [0, 34, 100] and found("integer")[:3] == [0, 0, 20]
    assert found("auto", dynamic_range=100) == [0, 34, 100, 0, 0, 20] and found("float", 0.0, 10.0, 10)[:3] == [0, 0, 10]
    assert quantised(raw).columns == ["inten"]
    with pytest.raises(ValueError, match="mode"):
        quantised(raw, "percent")
    px = montage(spark, np.arange(1, 5).reshape(2, 2))
    assert resampled(px, (2.0, 1.0, 1.0)).count() == 8 and resampled(px, (0.5, 1.0, 1.0)).count() == 2


def test_streaming(spark, tmp_path):
    from roiforge.streaming.slides import windowed_intensity

    src = spark.createDataFrame([("s", 1, 5, "2024-01-01 00:10:00"), ("s", 1, 7, "2024-01-01 00:20:00"), ("s", 1, 9, "2024-01-01 03:00:00")], "slide_id string, label long, inten long, ts string").selectExpr("slide_id", "label", "inten", "cast(ts as timestamp) ts")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = windowed_intensity(stream).writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select n, mean from windows").collect() == [(2, 6.0)]


def test_command_line(spark, tmp_path):
    from roiforge.__main__ import main

    image = (np.arange(48, dtype=np.uint16).reshape(6, 8) % 9) + 1
    mask = np.zeros((6, 8), np.uint8)
    mask[1:3, 1:4], mask[4:6, 5:8] = 1, 2
    for folder, data in (("int", image), ("seg", mask)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.tif").write_bytes(small_tiff(data))
    base = [f"--intDir={tmp_path}/int", f"--segDir={tmp_path}/seg", "--features=AREA_PIXELS_COUNT,MEAN"]
    main([*base, f"--outDir={tmp_path}/o.parquet"])
    assert sorted(r["AREA_PIXELS_COUNT"] for r in spark.read.parquet(f"{tmp_path}/o.parquet").collect()) == [6, 6]
    main([*base, f"--outDir={tmp_path}/m.parquet", "--aggr", "--skiproi=2"])
    assert [(r["label"], r["AREA_PIXELS_COUNT"]) for r in spark.read.parquet(f"{tmp_path}/m.parquet").collect()] == [(-1, 6)]
