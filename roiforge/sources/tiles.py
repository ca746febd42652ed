"""Images by blocks: tiles, strips and runs of slices, each read by its byte range and decoded by the task that needs it.

Headers make a table of blocks, one slim row each; what is asked of slides and places filters that table before any pixel is read. An image's
block and the blocks of its mask that it overlaps are found by equi-joins on the mask's grid and decoded together, so pixels are born with their
labels and no pixel is shuffled for it. Files of any size are read by as many tasks as their blocks fill.

Ranges are read by Python from local or mounted folders, and from other file systems by pyarrow (S3, GCS, HDFS, ABFS).
"""

from __future__ import annotations

import gzip
import io
import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from roiforge.functions.store import stored
from roiforge.session import ship
from roiforge.sources.formats import NiftiLayout, TiffLayout, decode, dicom_shape, scaled, tiff_cells, tiff_pages

#: Bytes that a task reads (about), and those of a run of slices.
TASK_BYTES, RUN_BYTES = 32 << 20, 4 << 20
#: Rows of a batch of pixels.
BATCH_PIXELS = 500_000

#: A block: its place in the file, its box, its place in the file's grid of blocks (page and tile, or run of slices), and how it is coded.
BLOCK = "path string, t long, z long, y long, x long, depth long, height long, width long, gz long, gy long, gx long, grid_depth long, grid_height long, grid_width long, at long, size long, coding string, frame string"
BLOCK_NAMES = [f.split()[0] for f in BLOCK.split(", ")]
_BOX = ("t", "z", "y", "x", "depth", "height", "width")
PIXELS = "slide_id string, mask_image string, t long, label long, x long, y long, z long, value double, real boolean"


# --- reading ---------------------------------------------------------------------------------------------------------


class Ranged:
    """A file read by byte ranges."""

    def __init__(self, path: str) -> None:
        local = re.sub("^file:/+", "/", path)
        if "://" in local:
            from pyarrow import fs

            system, place = fs.FileSystem.from_uri(local)
            self._file = system.open_input_file(place)
            self.size = self._file.size()
        else:
            self._file = open(local, "rb")  # noqa: SIM115
            self.size = os.fstat(self._file.fileno()).st_size

    def read(self, at: int, size: int) -> bytes:
        self._file.seek(at)
        return self._file.read(size)

    def close(self) -> None:
        self._file.close()


def blocks_of(path: str) -> list[dict]:
    """The blocks of a file, by its headers alone."""
    file, name = Ranged(path), path.lower()
    try:
        if name.endswith((".tif", ".tiff")):
            return list(_tiff_blocks(path, file))
        if name.endswith(".nii"):
            return list(_nifti_blocks(path, NiftiLayout.of(file.read(0, 352))))
        if name.endswith(".nii.gz"):
            shape = NiftiLayout.of(gzip.GzipFile(fileobj=io.BytesIO(file.read(0, 1 << 16))).read(352)).shape
        elif name.endswith((".dcm", ".dicom")):
            shape = dicom_shape(file.read(0, file.size))
        else:
            raise ValueError(f"no decoder for {path}")
        t, z, y, x = shape
        # a file that is only decoded as a whole: one block for each time
        return [_block(path, (k, 0, 0, 0), (z, y, x), (0, 0, 0), (z, y, x), 0, file.size, ("whole",), shape) for k in range(t)]
    finally:
        file.close()


def _block(path: str, place: Sequence[int], box: Sequence[int], cell: Sequence[int], grid: Sequence[int], at: int, size: int, coding: Sequence, frame: Sequence[int]) -> dict:
    return dict(zip(BLOCK_NAMES, (path, *place, *box, *cell, *grid, at, size, json.dumps(coding), "x".join(map(str, frame))), strict=True))


def _tiff_blocks(path: str, file: Ranged) -> Iterator[dict]:
    pages = [TiffLayout.of(*p) for p in tiff_pages(file.read)]
    pages = [p for p in pages if (p.height, p.width) == (pages[0].height, pages[0].width)]
    for z, p in enumerate(pages):
        across = -(-p.width // p.block_width)
        for k, (at, size) in enumerate(zip(p.places, p.sizes, strict=True)):
            y, x, rows, columns = p.box(k)
            # pages may differ in their grids: the mask's grid is that of the page
            yield _block(path, (0, z, y, x), (1, rows, columns), (z, k // across, k % across), (1, p.block_height, p.block_width), at, size, ("tiff", p.dtype, p.packing, p.predictor, p.block_width), (1, len(pages), p.height, p.width))


def _nifti_blocks(path: str, v: NiftiLayout) -> Iterator[dict]:
    t, z, y, x = v.shape
    slice_bytes = y * x * np.dtype(v.dtype).itemsize
    run = max(1, RUN_BYTES // slice_bytes)
    for k in range(t):
        for first in range(0, z, run):
            n = min(run, z - first)
            yield _block(path, (k, first, 0, 0), (n, y, x), (first // run, 0, 0), (run, y, x), v.start + (k * z + first) * slice_bytes, n * slice_bytes, ("raw", v.dtype, v.slope, v.intercept), v.shape)


def cells_of(block: dict, file: Ranged) -> np.ndarray:
    """A block's cells (z, y, x)."""
    how, *told = json.loads(block["coding"])
    shape = (block["depth"], block["height"], block["width"])
    data = file.read(block["at"], block["size"])
    if how == "tiff":
        return tiff_cells(data, *told, shape[1], shape[2])[None]
    if how == "raw":
        return scaled(np.frombuffer(data, dtype=told[0]).reshape(shape), *told[1:])
    return decode(block["path"], data)[block["t"]]


# --- tables of blocks ------------------------------------------------------------------------------------------------


def block_table(files: DataFrame) -> DataFrame:
    """Blocks of the files (path; different ones), headers read where the paths lie."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64() if f.endswith(" long") else pa.string() for f in BLOCK.split(", ")]
        for b in batches:
            for path in b.column(0).to_pylist():
                found = blocks_of(path)
                for k in range(0, len(found), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found[k : k + 20_000]], kind) for n, kind in zip(BLOCK_NAMES, types, strict=True)], names=BLOCK_NAMES)

    return files.select("path").mapInArrow(run, BLOCK)


def paired_blocks(pairs: DataFrame, box: Sequence[int] | None = None) -> DataFrame:
    """Blocks of images (slide_id, mask_name, shift, block) with those of their masks that they overlap (masks, an array; null where a pair has no mask).

    pairs: slide_id, intensity_image, mask_image (may be null), mask_name and shift, which is added to z. box: x0, y0, x1, y1 with the ends
    exclusive; blocks outside it are not read. Masks of another size are an error. A block meets its mask's by the numbers of the mask's grid, one row for each overlap.
    """
    pairs = pairs.select("slide_id", F.col("intensity_image").alias("path"), "mask_image", "mask_name", F.coalesce("shift", F.lit(0)).cast("long").alias("shift"))
    images = block_table(_spread(pairs.select("path").distinct())).where(_inside(box)).join(pairs, "path")
    units = images.select("slide_id", "mask_name", "mask_image", "shift", F.struct(*BLOCK_NAMES).alias("block"))
    masks = stored(block_table(_spread(pairs.where("mask_image is not null").select(F.col("mask_image").alias("path")).distinct())), "mask-blocks")
    # the mask's grid at the block's time; TIFF pages have a grid each
    grids = masks.groupBy(F.col("path").alias("mask_image"), F.col("t").alias("mt")).agg(F.first("frame").alias("mask_frame"), F.max("grid_depth").alias("gd"))
    block = F.col("block")
    told = units.join(grids, (units["mask_image"] == grids["mask_image"]) & (F.col("block.t") == grids["mt"]), "left").drop(grids["mask_image"], grids["mt"])
    differ = F.raise_error(F.concat(F.lit("masks differ in size from "), F.col("slide_id"))).cast("long")
    span = lambda at, n, step: F.sequence(F.floor(at / step), F.floor((at + n - 1) / step))
    checked = told.withColumn("gd", F.when(F.col("mask_image").isNull() | (F.col("mask_frame") == block["frame"]), F.col("gd")).otherwise(differ))
    # first the runs of slices or pages, then the tiles of each one's grid
    deep = checked.where("mask_image is not null").withColumn("gz", F.explode(span(block["z"], block["depth"], F.col("gd"))))
    pages = masks.groupBy(F.col("path").alias("mask_image"), F.col("t").alias("mt"), "gz").agg(F.max("grid_height").alias("gh"), F.max("grid_width").alias("gw"))
    wide = deep.withColumn("mt", block["t"]).join(pages, ["mask_image", "mt", "gz"]).withColumn("gy", F.explode(span(block["y"], block["height"], F.col("gh")))).withColumn("gx", F.explode(span(block["x"], block["width"], F.col("gw"))))
    found = masks.select(F.struct(*BLOCK_NAMES).alias("mask"), F.col("path").alias("mask_image"), F.col("t").alias("mt"), "gz", "gy", "gx")
    met = wide.join(found, ["mask_image", "mt", "gz", "gy", "gx"]).groupBy("slide_id", "mask_name", "mask_image", "shift", "block").agg(F.collect_list("mask").alias("masks"))
    alone = checked.where("mask_image is null").select("slide_id", "mask_name", "mask_image", "shift", "block", F.lit(None).cast(met.schema["masks"].dataType).alias("masks"))
    return met.union(alone)


def _spread(files: DataFrame) -> DataFrame:
    """Paths dealt to as many tasks as the session shuffles to, so that headers are read side by side."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def _inside(box: Sequence[int] | None) -> Column:
    if box is None:
        return F.lit(True)
    x0, y0, x1, y1 = (F.lit(int(v)) for v in box)
    return (F.col("x") < x1) & (F.col("x") + F.col("width") > x0) & (F.col("y") < y1) & (F.col("y") + F.col("height") > y0)


# --- pixels ----------------------------------------------------------------------------------------------------------


def _constant(value: object, kind: pa.DataType, n: int) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, dtype=np.int32)), pa.array([value], kind)).dictionary_decode()


def _labels(block: dict, masks: list[dict], opened: dict[str, Ranged]) -> np.ndarray:
    """Labels of a block's cells, pasted from the mask's blocks."""
    out = np.zeros((block["depth"], block["height"], block["width"]), dtype=np.int64)
    for m in masks:
        cells = cells_of(m, _open(opened, m["path"]))
        low = [max(block[c], m[c]) for c in "zyx"]
        high = [min(block[c] + block[n], m[c] + m[n]) for c, n in zip("zyx", ("depth", "height", "width"), strict=True)]
        into, of = (tuple(slice(a - r[c], b - r[c]) for c, a, b in zip("zyx", low, high, strict=True)) for r in (block, m))
        out[into] = cells[of]
    return out


def _open(opened: dict[str, Ranged], path: str) -> Ranged:
    if opened.get(path) is None:
        opened[path] = Ranged(path)
    return opened[path]


def labelled_pixels(units: DataFrame, box: Sequence[int] | None = None) -> DataFrame:
    """Raw pixels (slide_id, mask_image, t, label, x, y, z, value, real) of paired blocks, decoded image and mask together; label 1 without a mask.

    Background is left out but for each block's least and greatest value, which stay with label 0, so that an image's extremes can be told
    from its rows. A block is one row's work; tasks get blocks of about TASK_BYTES.
    """
    spark = units.sparkSession
    ship(spark)
    units = stored(units, "blocks")
    total, n = units.agg(F.sum("block.size"), F.count(F.lit(1))).first()
    tasks = int(max(1, min(n, max((total or 0) // TASK_BYTES, spark.sparkContext.defaultParallelism))))
    dealt = units.repartition(tasks, "block.path", "block.t", "block.z", "block.y", "block.x", "mask_name")
    names = [f.split()[0] for f in PIXELS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, Ranged] = {}
        for b in batches:
            for row in b.to_pylist():
                block = row["block"]
                cells = cells_of(block, _open(opened, block["path"]))
                labels = np.ones(cells.shape, dtype=np.int64) if row["masks"] is None else _labels(block, row["masks"], opened)
                ends = np.unravel_index([int(cells.argmin()), int(cells.argmax())], cells.shape)
                z, y, x = np.nonzero(labels)
                z, y, x = (np.concatenate([v, e]) for v, e in zip((z, y, x), ends, strict=True))
                label = labels[z, y, x]
                label[-2:] = 0
                value = cells[z, y, x].astype(float)
                x, y = x + block["x"], y + block["y"]
                if box is not None:
                    kept = (x >= box[0]) & (y >= box[1]) & (x < box[2]) & (y < box[3])
                    kept[-2:] = True
                    x, y, z, label, value = (v[kept] for v in (x, y, z, label, value))
                z = z + block["z"] + row["shift"]
                for k in range(0, len(x), BATCH_PIXELS):
                    part = slice(k, k + BATCH_PIXELS)
                    m = len(x[part])
                    whole = (_constant(row["slide_id"], pa.string(), m), _constant(row["mask_name"], pa.string(), m), _constant(block["t"], pa.int64(), m))
                    yield pa.RecordBatch.from_arrays([*whole, *(pa.array(v[part].astype(np.int64)) for v in (label, x, y, z)), pa.array(value[part]), _constant(cells.dtype.kind == "f", pa.bool_(), m)], names=names)
            while len(opened) > 64:
                opened.pop(next(iter(opened))).close()
        for f in opened.values():
            f.close()

    return dealt.mapInArrow(run, PIXELS)


# --- as a data source ------------------------------------------------------------------------------------------------


class _Blocks(InputPartition):
    def __init__(self, blocks: list[dict]) -> None:
        self.blocks = blocks


class TileSource(DataSource):
    """spark.read.format("image_tiles").load("/a.tif,/b.tif"): pixels path, t, z, y, x, value.

    Partitions are blocks of about TASK_BYTES (option taskBytes). Comparisons of path, t, z, y and x with constants prune blocks where the session has
    spark.sql.python.filterPushdown.enabled. Headers are read when a query is planned, so this is for few and large files; many files go by block_table().
    """

    @classmethod
    def name(cls) -> str:
        return "image_tiles"

    def schema(self) -> str:
        return "path string, t long, z long, y long, x long, value double"

    def reader(self, schema: object) -> TileReader:
        return TileReader(self.options["path"].split(","), int(self.options.get("taskBytes", TASK_BYTES)))


class TileReader(DataSourceReader):
    def __init__(self, paths: list[str], task_bytes: int) -> None:
        self.paths, self.task_bytes = paths, task_bytes
        # least and greatest value of each coordinate, both included
        self.least: dict[str, int] = {}
        self.most: dict[str, int] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes note of what prunes blocks; Spark applies every filter to the rows as well."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = [p for p in self.paths if p in wanted]
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in ("t", "z", "y", "x") and f.value is not None:
                c = f.attribute[0]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.least[c] = max(self.least.get(c, f.value), f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.most[c] = min(self.most.get(c, f.value), f.value - isinstance(f, LessThan))
            yield f

    def wanted(self, block: dict) -> bool:
        extent = {"t": 1, "z": block["depth"], "y": block["height"], "x": block["width"]}
        return all(block[c] + extent[c] > v for c, v in self.least.items()) and all(block[c] <= v for c, v in self.most.items())

    def partitions(self) -> list[_Blocks]:
        found: list[_Blocks] = []
        held = self.task_bytes
        for path in self.paths:
            for block in filter(self.wanted, blocks_of(path)):
                if not found or held + block["size"] > self.task_bytes:
                    found.append(_Blocks([]))
                    held = 0
                found[-1].blocks.append(block)
                held += block["size"]
        return found

    def read(self, partition: _Blocks | None) -> Iterator[pa.RecordBatch]:
        opened: dict[str, Ranged] = {}
        for block in partition.blocks if partition else []:
            cells = cells_of(block, _open(opened, block["path"]))
            z, y, x = (v.ravel() for v in np.indices(cells.shape))
            for k in range(0, cells.size, BATCH_PIXELS):
                part = slice(k, k + BATCH_PIXELS)
                n = len(x[part])
                yield pa.RecordBatch.from_arrays([_constant(block["path"], pa.string(), n), _constant(block["t"], pa.int64(), n), pa.array(z[part] + block["z"]), pa.array(y[part] + block["y"]), pa.array(x[part] + block["x"]), pa.array(cells.ravel()[part].astype(float))], names=["path", "t", "z", "y", "x", "value"])
        for f in opened.values():
            f.close()


def register(spark: SparkSession) -> None:
    """Makes the format image_tiles known to the session."""
    ship(spark)
    spark.dataSource.register(TileSource)
