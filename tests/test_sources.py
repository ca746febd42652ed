"""Image files: decoders, intensity modes, stacks, one image for many masks, names and the options of the command line."""

import json
import struct
import zlib

import numpy as np
import pytest

from roiforge.functions.sqltext import run
from roiforge.operators import geometry, spatial, texture
from roiforge.operators.zones import zone_features
from roiforge.plans.api import NestedRois, SlideFeatures, VolumeFeatures, featurize
from roiforge.plans.registry import FAMILIES, PROVIDER, USER, register_feature
from roiforge.sources import formats
from roiforge.sources.arrays import montage
from tests.test_api import small_nifti, small_tiff


def packed_lzw(data: bytes) -> bytes:
    """An encoder by the book: codes from 9 bits on, widened as entry 511 (1023, 2047) is added, a new table before it is full."""
    bits, table, word, width, n = "", {bytes((k,)): k for k in range(256)}, b"", 9, 258
    put = lambda code: format(code, f"0{width}b")
    bits += put(256)
    for c in data:
        if word + bytes((c,)) in table:
            word += bytes((c,))
            continue
        bits += put(table[word])
        table[word + bytes((c,))] = n
        if n in (511, 1023, 2047):
            width += 1
        n += 1
        word = bytes((c,))
        if n == 4095:
            bits += put(table[word]) + put(256)
            table, width, n, word = {bytes((k,)): k for k in range(256)}, 9, 258, b""
    bits += (put(table[word]) if word else "") + put(257)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def packed_bits(data: bytes) -> bytes:
    out = b""
    for k in range(0, len(data), 100):
        part = data[k : k + 100]
        out += bytes((257 - len(part), part[0])) if len(set(part)) == 1 and len(part) > 1 else bytes((len(part) - 1,)) + part
    return out


def any_tiff(image: np.ndarray, how: int = 1, big: bool = False) -> bytes:
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    data = {1: bytes, 5: packed_lzw, 8: zlib.compress, 32773: packed_bits}[how](image.tobytes())
    start = 16 if big else 8
    tags = [(256, image.shape[1]), (257, image.shape[0]), (258, image.dtype.itemsize * 8), (259, how), (273, start), (278, image.shape[0]), (279, len(data)), (339, kind)]
    if big:
        return b"II" + struct.pack("<HHHQ", 43, 8, 0, 16 + len(data)) + data + struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", t, 16, 1, v) for t, v in tags) + struct.pack("<Q", 0)
    return b"II" + struct.pack("<HI", 42, 8 + len(data)) + data + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + struct.pack("<I", 0)


def test_compressed_and_big_tiff():
    rng = np.random.default_rng(1)
    for image in (rng.integers(0, 60000, (70, 90)).astype("<u2"), np.zeros((40, 50), np.uint8), (np.arange(6000) % 7).reshape(60, 100).astype("<u2")):
        for how in (1, 5, 8, 32773):
            for big in (False, True):
                assert np.array_equal(formats.decode("a.tif", any_tiff(image, how, big))[0, 0], image), (how, big)


def test_nested_dicom_is_skipped():
    us = lambda g, e, v: struct.pack("<HH2sHH", g, e, b"US", 2, v)
    item = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + us(0x28, 0x10, 99) + struct.pack("<HH2sHI", 8, 0x1140, b"SQ", 0, 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0) + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    nested = struct.pack("<HH2sHI", 8, 0x1111, b"SQ", 0, 0xFFFFFFFF) + item + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    values = np.arange(6, dtype="<u2").reshape(2, 3)
    syntax = b"1.2.840.10008.1.2.1\0"
    data = b"\0" * 128 + b"DICM" + struct.pack("<HH2sH", 2, 0x10, b"UI", len(syntax)) + syntax + nested + us(0x28, 0x10, 2) + us(0x28, 0x11, 3) + us(0x28, 0x100, 16) + us(0x28, 0x103, 0) + struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OW", 0, 12) + values.tobytes()
    assert np.array_equal(formats.decode("a.dcm", data)[0, 0], values)


def folder(tmp_path, name, **images):
    (tmp_path / name).mkdir()
    for n, data in images.items():
        (tmp_path / name / f"{n}.tif").write_bytes(small_tiff(data) if isinstance(data, np.ndarray) else data)
    return str(tmp_path / name)


def test_real_and_hounsfield_images(spark, tmp_path):
    """A field of Hounsfield units as whole and as real numbers, and an image of shares."""
    field = (-1024 + 8 * np.arange(256)).reshape(16, 16)
    for name, data in (("whole", field.astype("<i2")), ("real", field.astype("<f4"))):
        images = folder(tmp_path, name, a=data)
        found = SlideFeatures("MEAN,MIN,MAX", spark, intensity_mode="hounsfield").featurize_directory(images).first()
        assert (found["MIN"], found["MAX"], found["MEAN"]) == (0, 2040, 1020)
    shares = folder(tmp_path, "shares", a=np.linspace(0, 1, 256).reshape(16, 16).astype("<f4"))
    found = SlideFeatures("MEAN,MAX", spark).featurize_directory(shares).first()
    assert found["MAX"] == 10_000 and found["MEAN"] == pytest.approx(5000, rel=0.01)
    assert SlideFeatures("MAX", spark, min_intensity=0.0, max_intensity=2.0, dynamic_range=100).featurize_directory(shares).first()["MAX"] == 50
    assert SlideFeatures("MIN", spark).featurize_directory(str(tmp_path / "whole")).first()["MIN"] == 0


def test_volume_of_a_scanner(spark, tmp_path):
    """8x8x8 stored as index - 200, slope 2 and intercept -1024; one image for two masks."""
    (tmp_path / "int").mkdir(), (tmp_path / "seg").mkdir()
    (tmp_path / "int" / "ct.nii").write_bytes(small_nifti(np.arange(512).reshape(8, 8, 8) - 200, 2, -1024))
    for k in (1, 2):
        mask = np.zeros((8, 8, 8), int)
        mask[:k] = k
        (tmp_path / "seg" / f"m{k}.nii").write_bytes(small_nifti(mask, 1, 0))
    engine = VolumeFeatures("3MEAN,3MIN,3MAX", spark, intensity_mode="hounsfield")
    found = {r["slide_id"].rsplit("/", 1)[1]: r for r in engine.featurize_directory(str(tmp_path / "int"), str(tmp_path / "seg")).collect()}
    assert found["m1.nii"]["3MAX"] == 126 and found["m2.nii"]["3MAX"] == 254 and found["m2.nii"]["3MIN"] == 0 and found["m2.nii"]["label"] == 2
    assert engine.featurize_files([str(tmp_path / "int" / "ct.nii")], single_roi=True).first()["3MEAN"] == 511


def test_stacks_by_pattern(spark, tmp_path):
    planes = {f"B_001_z{z:03d}_t002": np.full((4, 4), 10 * z, np.uint16) for z in (1, 2, 3)}
    masks = {n: np.ones((4, 4), np.uint8) for n in planes}
    images, labels = folder(tmp_path, "int", **planes), folder(tmp_path, "seg", **masks)
    pattern = "B_{d+}_z{set d+}_t{d+}.tif"
    found = VolumeFeatures("3MEAN,3VOXEL_VOLUME", spark).featurize_directory(images, labels, pattern).first()
    assert found["slide_id"] == "B_001_z*_t002.tif" and found["3MEAN"] == 20
    assert spatial.stack_pattern(".*") is None
    with pytest.raises(ValueError, match="only"):
        spatial.stack_pattern("a{x}_z{set d+}")
    (tmp_path / "seg" / "B_001_z003_t002.tif").unlink()
    with pytest.raises(ValueError, match="differ"):
        VolumeFeatures("3MEAN", spark).featurize_directory(images, labels, pattern)


def test_names_sizes_and_mapping(spark, tmp_path):
    image, mask = np.arange(1, 49, dtype=np.uint16).reshape(6, 8), np.zeros((6, 8), np.uint8)
    mask[1:3, 1:4], mask[4:6, 5:8] = 1, 2
    images, labels = folder(tmp_path, "int", p0_y1_c0=image), folder(tmp_path, "seg", p0_y1_c0=mask)
    found = SlideFeatures("AREA_PIXELS_COUNT", spark).featurize_directory(images, labels, header=True)
    assert found.columns == ["intensity_image", "mask_image", "anno0", "anno1", "anno2", "ROI_label", "t_index", "AREA_PIXELS_COUNT"]
    assert {(r["anno2"], r["ROI_label"], r["AREA_PIXELS_COUNT"]) for r in found.collect()} == {("c0", 1, 6), ("c0", 2, 6)}
    merged = SlideFeatures("AREA_PIXELS_COUNT", spark, merge_labels=True).featurize_directory(images, labels).collect()
    assert [(r["label"], r["AREA_PIXELS_COUNT"]) for r in merged] == [(1, 12)]
    lines = spark.createDataFrame([("p0_y1_c0.tif p0_y1_c0.tif",), ("",)], "value string")
    assert SlideFeatures("MEAN", spark).featurize_mapping(lines, images, labels).count() == 2
    small = folder(tmp_path, "small", p0_y1_c0=mask[:5])
    with pytest.raises(Exception, match="differ in size"):
        SlideFeatures("MEAN", spark).featurize_directory(images, small).collect()


def test_channels_of_nested_regions(spark, tmp_path):
    outer, inner = np.zeros((9, 9), np.uint8), np.zeros((9, 9), np.uint8)
    outer[1:8, 1:8], inner[2:4, 2:4], inner[5:7, 5:7] = 1, 3, 4
    labels = folder(tmp_path, "seg", p0_c1_r2=outer, p0_c0_r2=inner)
    found = NestedRois().find_file_relations(spark, labels, "_c", 1, 0).collect()
    assert {(r["slide_id"], r["parent_label"], r["child_label"]) for r in found} == {("p0_r2.tif", 1, 3), ("p0_r2.tif", 1, 4)}
    with pytest.raises(ValueError, match="channel"):
        spatial.pair_by_channel(["a/b.tif"], "_c", 1, 0)
    from pyspark.sql import functions as F

    parents, children = montage(spark, outer.astype(int), outer.astype(int)), montage(spark, inner.astype(int), inner.astype(int))
    size = lambda df: df.groupBy("slide_id", "t", "label").agg(F.max("x").cast("double").alias("right"))
    nested = NestedRois({"right": lambda c: F.max(c) - F.min(c)})
    assert nested.featurize(nested.find_relations(parents, children), size(parents), size(children), ["right"]).first()["child_right"] == 3


def test_large_zarr_images(spark, tmp_path):
    """(7 row + 3 column) modulo 65536 on 1500 x 1200 in chunks of 1024."""
    store = tmp_path / "a.zarr" / "0"
    store.mkdir(parents=True)
    (store / ".zarray").write_text(json.dumps({"chunks": [1, 1, 1, 1024, 1024], "shape": [1, 1, 1, 1500, 1200], "dtype": "<u2", "compressor": None, "order": "C"}))
    whole = np.zeros((2048, 2048), "<u2")
    whole[:1500, :1200] = np.add.outer(7 * np.arange(1500), 3 * np.arange(1200)) % 65536
    for r in (0, 1):
        for c in (0, 1):
            (store / f"0.0.0.{r}.{c}").write_bytes(whole[1024 * r : 1024 * r + 1024, 1024 * c : 1024 * c + 1024].tobytes())
    found = SlideFeatures("INTEGRATED_INTENSITY,AREA_PIXELS_COUNT", spark).featurize_zarr(str(tmp_path / "a.zarr")).first()
    assert found["AREA_PIXELS_COUNT"] == 1_800_000 and found["INTEGRATED_INTENSITY"] == 12_681_000_000
    again = SlideFeatures("MAX", spark).featurize_zarr(str(tmp_path / "a.zarr"), str(tmp_path / "a.zarr"))
    assert again.count() == len(np.unique(whole[:1500, :1200])) - 1


def test_texture_options(spark):
    image = np.array([[1, 1, 9, 4], [1, 9, 9, 4], [2, 2, 4, 1]])
    px = montage(spark, image)
    # levels by their numbers: 1, 2, 4, 9 are the first to the fourth
    plain = featurize(px, "GLCM_JVAR_AVE,GLCM_JAVE_AVE", SlideFeatures("MEAN", spark, coarse_gray_depth=-8, level_index=False).settings).first()
    index = featurize(px, "GLCM_JVAR_AVE,GLCM_JAVE_AVE,GLCM_DIFVAR_AVE", SlideFeatures("MEAN", spark, coarse_gray_depth=-8).settings).first()
    assert plain["GLCM_JAVE_AVE"] == pytest.approx(index["GLCM_JAVE_AVE"]) and plain["GLCM_JVAR_AVE"] != index["GLCM_JVAR_AVE"]
    dense = run(px, texture.glcm_sql(4, averaged=True)).first(), run(px, texture.glcm_sql(4, averaged=True, by_index=True)).first()
    assert dense[0]["GLCM_ASM_AVE"] == pytest.approx(dense[1]["GLCM_ASM_AVE"])
    # straight zones are more and smaller ones
    cross = montage(spark, np.array([[2, 1, 2], [1, 2, 1], [2, 1, 2]]))
    zp = lambda straight: zone_features(cross, "GLDZM", 0, straight=straight).first()["GLDZM_ZP"]
    assert zp(False) == pytest.approx(2 / 9) and zp(True) == pytest.approx(1)
    # background of the box as level 1
    corner = np.array([[5, 0], [5, 5]])
    lone = montage(spark, corner, (corner > 0).astype(int))
    cells = run(lone, texture.background_sql())
    assert cells.count() == 4 and cells.where("inten = 0").count() == 1
    zones = lambda **k: featurize(lone, "GLSZM_ZP,GLCM_ASM_AVE", SlideFeatures("MEAN", spark, coarse_gray_depth=4, **k).settings).first()
    assert zones()["GLSZM_ZP"] == pytest.approx(1 / 3) and zones(background=True)["GLSZM_ZP"] == pytest.approx(2 / 4) and zones()["GLCM_ASM_AVE"] == pytest.approx(zones(background=True)["GLCM_ASM_AVE"])
    # a depth of its own
    own = featurize(px, "GLCM_ASM_AVE,GLSZM_ZP", SlideFeatures("MEAN", spark, depths=(("glszm", 1),)).settings).first()
    assert own["GLSZM_ZP"] == pytest.approx(1 / 12)
    cube = montage(spark, np.random.default_rng(2).integers(1, 9, (5, 5, 5)), volumes=True)
    near, far = (featurize(cube, "3NGTDM_CONTRAST", VolumeFeatures("3MEAN", spark, ngtdm3_radius=r).settings).first()[3] for r in (1, 2))
    assert near > 0 and far > 0 and near != far and len(texture.around_cube(2)) == 124


def test_gabor_parameters_and_one_geometry_pass(spark):
    px = montage(spark, np.random.default_rng(3).integers(1, 60, (12, 12)))
    engine = SlideFeatures("GABOR,PERIMETER,ZERNIKE2D,SOLIDITY", spark)
    engine.set_gabor_feature_params(thetas=[0, 90], freqs=[4, 8], kersize=8)
    found = engine.featurize_pixels(px)
    assert [c for c in found.columns if c.startswith("GABOR")] == ["GABOR_0", "GABOR_1"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    want = geometry.gabor_features(geometry.Region(*(np.array([r[c] for r in px.collect()]) for c in ("x", "y", "inten"))), pairs=((0.0, 4.0), (90.0, 8.0)), n=8)
    assert [found.first()[f"GABOR_{k}"] for k in (0, 1)] == pytest.approx(want)
    with pytest.raises(ValueError, match="Gabor"):
        engine.set_gabor_feature_params(colour=1)


def test_user_family_gets_what_it_requires(spark):
    @register_feature("density", ["MY_DENSITY"], requires=["morphology"])
    def density(pixels, done):
        return done["morphology"].selectExpr("slide_id", "t", "label", "AREA_PIXELS_COUNT / (BBOX_WIDTH * BBOX_HEIGHT) as MY_DENSITY")

    try:
        assert featurize(montage(spark, np.eye(4, dtype=int), np.eye(4, dtype=int)), "MY_DENSITY").first()["MY_DENSITY"] == 0.25
    finally:
        FAMILIES.pop("density"), PROVIDER.pop("MY_DENSITY"), USER.functions.pop("density")


def test_more_of_the_command_line(spark, tmp_path):
    from roiforge.__main__ import main

    image, mask = np.arange(1, 49, dtype=np.uint16).reshape(6, 8), np.zeros((6, 8), np.uint8)
    mask[1:3, 1:4], mask[4:6, 5:8] = 1, 2
    images, labels = folder(tmp_path, "int", p0_c1=image), folder(tmp_path, "seg", p0_c1=mask, p0_c0=mask)
    (tmp_path / "map.txt").write_text("p0_c1.tif p0_c0.tif\n")
    (tmp_path / "list.txt").write_text("AREA_PIXELS_COUNT\nGABOR\n")
    main([f"--intDir={images}", f"--segDir={labels}", f"--outDir={tmp_path}", "--outputType=parquet", f"--features={tmp_path}/list.txt", f"--intSegMapDir={tmp_path}", "--intSegMapFile=map.txt", "--annot", "--mergerois", "--gaborfreqs=4,8", "--gabortheta=0,90", "--metaparam=glcm/greydepth=8"])
    found = spark.read.parquet(f"{tmp_path}/features.parquet").first()
    assert found["mask_image"] == "p0_c0.tif" and found["anno1"] == "c0" and found["AREA_PIXELS_COUNT"] == 12 and "GABOR_1" in found
    main([f"--intDir={images}", f"--segDir={labels}", f"--outDir={tmp_path}/r.parquet", "--hsig=_c", "--hpar=1", "--hchi=0"])
    assert spark.read.parquet(f"{tmp_path}/r.parquet").count() == 2


def test_nested_features_angles_and_separators(spark, tmp_path):
    from roiforge.__main__ import main

    image, outer, inner = np.arange(1, 82, dtype=np.uint16).reshape(9, 9), np.zeros((9, 9), np.uint8), np.zeros((9, 9), np.uint8)
    outer[1:8, 1:8], inner[2:4, 2:4], inner[5:7, 5:7] = 1, 3, 4
    images, labels = folder(tmp_path, "int", p0_c1=image, p0_c0=image), folder(tmp_path, "seg", p0_c1=outer, p0_c0=inner)
    common = [f"--intDir={images}", f"--segDir={labels}", "--features=AREA_PIXELS_COUNT,MAX", "--hsig=_c", "--hpar=1", "--hchi=0"]
    main([*common, f"--outDir={tmp_path}/n.parquet", "--hag=sum"])
    row = spark.read.parquet(f"{tmp_path}/n.parquet").first()
    assert (row["slide_id"], row["parent_label"], row["AREA_PIXELS_COUNT"], row["child_AREA_PIXELS_COUNT"], row["child_MAX"]) == ("p0.tif", 1, 49, 8, 31 + 61)
    main([*common, f"--outDir={tmp_path}/w.parquet", "--hag=none"])
    row = spark.read.parquet(f"{tmp_path}/w.parquet").first()
    assert (row["child1_MAX"], row["child2_MAX"]) == (31, 61)
    engine = SlideFeatures("GLCM_ASM,GLCM_ASM_AVE", spark, coarse_gray_depth=8, glcm_angles=(0, 90))
    found = engine.featurize_pixels(montage(spark, image.astype(int), outer.astype(int)))
    row = found.first()
    assert [c for c in found.columns if c.startswith("GLCM_ASM_") and c != "GLCM_ASM_AVE"] == ["GLCM_ASM_0", "GLCM_ASM_90"]
    assert row["GLCM_ASM_AVE"] == pytest.approx((row["GLCM_ASM_0"] + row["GLCM_ASM_90"]) / 2)
    assert spatial.annotations("/a/x-y-z_1.ome.tif", "-") == ["x", "y", "z_1"]
    with pytest.raises(ValueError, match="glcm_angles"):
        SlideFeatures("MEAN", spark, glcm_angles=(30,))
