"""Images read by blocks: grids of tiles and strips, masks of other grids, boxes, files above 2 GB, and the data source."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roiforge.plans.api import SlideFeatures
from roiforge.sources import tiles
from roiforge.sources.formats import decode
from roiforge.sources.images import image_pixels, paired_pixels
from tests.test_api import small_nifti


def gridded(pages: list[np.ndarray], bh: int, bw: int, tiled: bool, big: bool = False, packed: bool = True) -> bytes:
    """A TIFF of pages in tiles or strips (bw is the width then), deflated unless packed is false."""
    wide, word, entry = (8, "Q", 20) if big else (4, "I", 12)
    out = bytearray(b"II" + (struct.pack("<HHHQ", 43, 8, 0, 0) if big else struct.pack("<HI", 42, 0)))
    link = 8 if big else 4
    for image in pages:
        h, w = image.shape
        places, sizes = [], []
        for y in range(0, h, bh):
            for x in range(0, w, bw if tiled else w):
                cells = image[y : y + bh, x : x + (bw if tiled else w)]
                if tiled:
                    whole = np.zeros((bh, bw), image.dtype)
                    whole[: cells.shape[0], : cells.shape[1]] = cells
                    cells = whole
                data = zlib.compress(cells.tobytes()) if packed else cells.tobytes()
                places.append(len(out))
                sizes.append(len(data))
                out += data
        tags = [(256, [w]), (257, [h]), (258, [image.dtype.itemsize * 8]), (259, [8 if packed else 1]), (339, [{"u": 1, "i": 2, "f": 3}[image.dtype.kind]])]
        tags += [(322, [bw]), (323, [bh]), (324, places), (325, sizes)] if tiled else [(273, places), (278, [bh]), (279, sizes)]
        rows = []
        for tag, values in sorted(tags):
            raw = struct.pack("<" + word * len(values), *values)
            if len(raw) > wide:
                at = len(out)
                out += raw
                raw = struct.pack("<" + word, at)
            rows.append(struct.pack("<HH" + word, tag, 16 if big else 4, len(values)) + raw.ljust(wide, b"\0"))
        out[link : link + wide] = struct.pack("<" + word, len(out))
        out += struct.pack("<Q" if big else "<H", len(rows)) + b"".join(rows)
        link = len(out)
        out += bytes(wide)
    return bytes(out)


def shapes(rng, h, w):
    mask = np.zeros((h, w), np.uint8)
    for k in range(1, 5):
        y, x = rng.integers(0, h - 5), rng.integers(0, w - 5)
        mask[y : y + rng.integers(2, 40), x : x + rng.integers(2, 40)] = k
    return mask


def rows_of(df):
    return sorted(tuple(r) for r in df.select("label", "x", "y", "z", "value").collect())


def expected(image, mask):
    return sorted((int(mask[i]), i[2], i[1], i[0], float(image[i])) for i in map(tuple, np.argwhere(mask != 0).tolist()))


@pytest.mark.parametrize("image_grid, mask_grid", [((16, 32, True), (16, 32, True)), ((16, 32, True), (7, 0, False)), ((5, 0, False), (48, 16, True))])
def test_masks_of_any_grid(spark, tmp_path, image_grid, mask_grid):
    rng = np.random.default_rng(image_grid[0])
    image = rng.integers(0, 60_000, (2, 90, 110)).astype("<u2")
    mask = np.stack([shapes(rng, 90, 110) for _ in range(2)])
    for name, data, (bh, bw, tiled) in (("int", image, image_grid), ("seg", mask, mask_grid)):
        (tmp_path / name).mkdir()
        for big in (False, True):
            (tmp_path / name / f"{'big' if big else 'classic'}.tif").write_bytes(data_ := gridded(list(data), bh, bw, tiled, big))
            assert np.array_equal(decode("a.tif", data_)[0], data)
    found = image_pixels(spark, str(tmp_path / "int"), str(tmp_path / "seg"))
    for name in ("classic", "big"):
        assert rows_of(found.where(F.col("slide_id").endswith(f"{name}.tif"))) == expected(image, mask)
    ends = found.select("lo", "hi", "real").distinct().collect()
    assert [tuple(r) for r in ends] == [(float(image.min()), float(image.max()), False)]


def test_boxes_read_fewer_blocks(spark, tmp_path):
    rng = np.random.default_rng(3)
    image, mask = rng.integers(0, 255, (200, 300)).astype(np.uint8), np.ones((200, 300), np.uint8)
    paths = [str(tmp_path / "a.tif"), str(tmp_path / "m.tif")]
    for p, data, grid in zip(paths, (image, mask), ((32, 32, True), (10, 0, False)), strict=True):
        with open(p, "wb") as f:
            f.write(gridded([data], *grid))
    pairs = spark.createDataFrame([(paths[0], paths[0], paths[1], paths[1], 0)], "slide_id string, intensity_image string, mask_image string, mask_name string, shift long")
    box = (40, 50, 70, 90)
    units = tiles.paired_blocks(pairs, box)
    assert tiles.paired_blocks(pairs).count() == 70 and units.count() == 4
    assert units.select(F.explode("masks")).distinct().count() == 7  # strips of ten rows between 32 and 96
    found = paired_pixels(spark, pairs, box=box)
    assert rows_of(found) == sorted((1, x, y, 0, float(image[y, x])) for y in range(50, 90) for x in range(40, 70))


def test_volumes_by_runs_of_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tiles, "RUN_BYTES", 3 * 24)
    volume = np.arange(7 * 3 * 4).reshape(7, 3, 4) - 30
    mask = (np.arange(7 * 3 * 4).reshape(7, 3, 4) % 5 == 0).astype(int)
    (tmp_path / "v.nii").write_bytes(small_nifti(volume, 2, 1))
    (tmp_path / "m.nii").write_bytes(small_nifti(mask, 1, 0))
    assert [b["depth"] for b in tiles.blocks_of(str(tmp_path / "v.nii"))] == [3, 3, 1]
    pairs = spark.createDataFrame([(str(tmp_path / "v.nii"), str(tmp_path / "m.nii"))], "intensity_image string, mask_image string")
    assert rows_of(paired_pixels(spark, pairs)) == expected(volume * 2.0 + 1, mask)


def sparse_tiff(path, side_blocks: int, block: int, filled: dict[int, bytes]):
    """An uncompressed big TIFF of zeros but for some tiles; the file has holes."""
    n, size = side_blocks**2, block * block
    start = 16
    table = start + n * size
    with open(path, "wb") as f:
        f.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, table + 16 * n))
        for k, data in filled.items():
            f.seek(start + k * size)
            f.write(data)
        f.seek(table)
        f.write(struct.pack(f"<{n}Q", *(start + k * size for k in range(n))) + struct.pack(f"<{n}Q", *[size] * n))
        tags = [(256, 1, block * side_blocks), (257, 1, block * side_blocks), (258, 1, 8), (259, 1, 1), (322, 1, block), (323, 1, block), (324, n, table), (325, n, table + 8 * n), (339, 1, 1)]
        f.write(struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", t, 16, c, v) for t, c, v in tags) + struct.pack("<Q", 0))


def test_a_file_above_two_gigabytes(spark, tmp_path):
    block, side = 3072, 16
    rng = np.random.default_rng(5)
    image, mask = rng.integers(1, 255, (block, block)).astype(np.uint8), np.zeros((block, block), np.uint8)
    mask[3000:, 100:130] = 7
    for name, data in (("slide", image), ("mask", mask)):
        sparse_tiff(tmp_path / f"{name}.tif", side, block, {0: data.tobytes(), side * side - 1: data.tobytes()})
    assert os.path.getsize(tmp_path / "slide.tif") > 1 << 31
    pairs = spark.createDataFrame([(str(tmp_path / "slide.tif"), str(tmp_path / "mask.tif"))], "intensity_image string, mask_image string")
    plain = pairs.selectExpr("intensity_image slide_id", "intensity_image", "mask_image", "mask_image mask_name", "0L shift")
    whole = tiles.labelled_pixels(tiles.paired_blocks(plain))
    assert whole.rdd.getNumPartitions() >= 32
    far = block * (side - 1)
    want = expected(image[None], mask[None])
    want = sorted([*want, *((n, x + far, y + far, z, v) for n, x, y, z, v in want)])
    found = paired_pixels(spark, pairs).cache()
    assert rows_of(found) == want
    # one region of two parts, far apart
    assert found.agg(F.min("lo"), F.max("hi")).first() == (0.0, float(image.max()))
    found.unpersist()


def test_an_image_is_decoded_once(spark, tmp_path):
    rng = np.random.default_rng(6)
    for name, data in (("int", rng.integers(1, 255, (40, 40)).astype(np.uint8)), ("seg", shapes(rng, 40, 40))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.tif").write_bytes(gridded([data], 16, 16, True))
    found = SlideFeatures("MEAN,PERIMETER,GLCM_ASM", spark, coarse_gray_depth=8).featurize_directory(str(tmp_path / "int"), str(tmp_path / "seg"))
    plan = found._jdf.queryExecution().toString()
    # what was decoded is written; the features' plan reads the written pixels and holds no reader of images
    assert "MapInArrow" not in plan and "parquet" in plan
    assert found.count() == 4


def test_data_source(spark, tmp_path):
    image = np.random.default_rng(7).integers(0, 255, (100, 120)).astype(np.uint8)
    path = str(tmp_path / "a.tif")
    with open(path, "wb") as f:
        f.write(gridded([image], 32, 32, True, packed=False))
    tiles.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        every = spark.read.format("image_tiles").option("taskBytes", 1).load(path)
        assert every.rdd.getNumPartitions() == 16 and every.agg(F.sum("value")).first()[0] == image.sum()
        some = every.where("x >= 40 and x < 60 and y = 70")
        assert some.rdd.getNumPartitions() == 1
        assert sorted(tuple(r) for r in some.select("x", "y", "value").collect()) == [(x, 70, float(image[70, x])) for x in range(40, 60)]
        assert every.where("path = 'elsewhere'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
