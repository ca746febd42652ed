"""Image files as tables of pixels: folders, pairs, z-stacks and Zarr stores.

Files are listed by Spark and read by blocks (see tiles); what is decoded is written once to the folder that the cluster shares, so a file is decoded
once however many features draw on it. Intensities stay raw (double) in `value`, beside whether the file holds real numbers, and its extremes; quantised()
turns them into `inten`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roiforge.functions.store import stored
from roiforge.operators.spatial import pair_by_name, stack_key, stack_pattern
from roiforge.session import ship
from roiforge.sources.formats import zarr_chunk
from roiforge.sources.tiles import labelled_pixels, paired_blocks

_PIXELS = "path string, t long, x long, y long, z long, value double, real boolean, lo double, hi double, extent string"
_NAMES = [f.split()[0] for f in _PIXELS.split(", ")]
#: What quantised() reads beside value.
_RAW = ("value", "real", "lo", "hi")


def files(spark: SparkSession, folder: str, pattern: str = ".*") -> DataFrame:
    """Files (path, length) of a folder whose whole names match pattern; those starting with a dot are skipped."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(folder).select("path", "length").where(name.rlike(f"^(?:{pattern})$") & ~name.startswith("."))


def _batch(path: str, t: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, value: np.ndarray, real: bool, lo: float, hi: float, extent: str) -> pa.RecordBatch:
    n = len(value)
    same = lambda v, kind: pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, dtype=np.int32)), pa.array([v], kind)).dictionary_decode()
    return pa.RecordBatch.from_arrays([same(path, pa.string()), *(pa.array(v.astype(np.int64)) for v in (t, x, y, z)), pa.array(value.astype(float)), same(real, pa.bool_()), same(lo, pa.float64()), same(hi, pa.float64()), same(extent, pa.string())], names=_NAMES)


def quantised(raw: DataFrame, mode: str = "auto", low: float | None = None, high: float | None = None, dynamic_range: int = 10_000) -> DataFrame:
    """Raw values (value, real, lo, hi: the image's extremes) as whole intensities inten.

    integer: whole parts, negative ones as 0. float: [low, high] (by default the image's extremes) stretched to the dynamic range, values beyond
    clamped. hounsfield: counted from the floor of the image's minimum, so that a level is a unit. auto: float for images of real numbers,
    integer for others.
    """
    if mode not in ("auto", "integer", "float", "hounsfield"):
        raise ValueError(f"no such intensity mode: {mode}")
    value = F.col("value")
    whole = F.greatest(value, F.lit(0.0)).cast("long")
    lo, hi = F.col("lo") if low is None else F.lit(float(low)), F.col("hi") if high is None else F.lit(float(high))
    share = F.coalesce(F.try_divide(F.least(F.greatest(value, lo), hi) - lo, hi - lo), F.lit(0.0))
    stretched = F.floor(share * dynamic_range).cast("long")
    offset = F.round(F.greatest(value - F.floor("lo"), F.lit(0.0))).cast("long")
    inten = {"integer": whole, "float": stretched, "hounsfield": offset, "auto": F.when(F.col("real"), stretched).otherwise(whole)}[mode]
    return raw.withColumn("inten", inten).drop(*_RAW)


def _plain(path: str) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def paired_pixels(spark: SparkSession, pairs: DataFrame, single_roi: bool = False, box: Sequence[int] | None = None) -> DataFrame:
    """Raw pixels of pairs (intensity_image, mask_image): slide_id is the image's path, label the mask's value (1 throughout with single_roi).

    An image that has several masks makes a slide of each, named by the mask. Masks of another size are an error. With box (x0, y0, x1, y1,
    ends exclusive) only blocks that it touches are read, and only its pixels are given.
    """
    told = pairs.select(_plain("intensity_image").alias("intensity_image"), _plain("mask_image").alias("mask_image")).distinct()
    often = told.groupBy("intensity_image").agg((F.count(F.lit(1)) > 1).alias("often"))
    named = told.join(often, "intensity_image").withColumn("slide_id", F.when(F.col("often"), F.col("mask_image")).otherwise(F.col("intensity_image"))).withColumn("mask_name", F.col("mask_image"))
    return stored_pixels(named.withColumn("shift", F.lit(0)).withColumn("mask_image", F.lit(None).cast("string") if single_roi else F.col("mask_image")), box)


def stored_pixels(pairs: DataFrame, box: Sequence[int] | None = None) -> DataFrame:
    """Raw pixels of pairs as tiles.paired_blocks() takes them, decoded once and written, with the extremes of each slide."""
    pixels = stored(labelled_pixels(paired_blocks(pairs, box), box), "pixels")
    return with_extremes(pixels).where("label <> 0")


def with_extremes(pixels: DataFrame) -> DataFrame:
    """lo and hi of each slide beside its rows. A left join, which the optimizer drops where neither is used."""
    return pixels.join(pixels.groupBy("slide_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi")), "slide_id", "left")


def _labelled(values: DataFrame, masks: DataFrame | None) -> DataFrame:
    """Values with the labels of their masks (matched by mask_key and place), background left out."""
    shown = ("slide_id", F.col("mask_key").alias("mask_image"), "t", "label", "x", "y", "z", *_RAW)
    if masks is None:
        return values.withColumn("label", F.lit(1).cast("long")).select(*shown)
    held = masks.select("mask_key", "t", "x", "y", "z", F.col("value").cast("long").alias("found"), F.col("extent").alias("mask_extent"))
    differ = F.raise_error(F.concat(F.lit("masks differ in size from "), F.col("slide_id"))).cast("long")
    both = values.join(held, ["mask_key", "t", "x", "y", "z"]).withColumn("label", F.when(F.col("extent") == F.col("mask_extent"), F.col("found")).otherwise(differ))
    return both.where("label <> 0").select(*shown)


def image_pixels(spark: SparkSession, intensity_dir: str, label_dir: str | None = None, pattern: str = ".*", volumes: bool = False, box: Sequence[int] | None = None) -> DataFrame:
    """Raw pixels of a folder's images, with the masks of the same names in another folder; without one, whole images.

    A pattern with {set d+} names z-stacks, see stacked_pixels(). With volumes a single image goes with all masks. For box see paired_pixels().
    """
    if stack_pattern(pattern):
        return stacked_pixels(spark, intensity_dir, label_dir, pattern, box)
    images = files(spark, intensity_dir, pattern)
    if label_dir is None:
        return paired_pixels(spark, images.select(F.col("path").alias("intensity_image"), F.col("path").alias("mask_image")), True, box)
    masks = files(spark, label_dir, pattern)
    if volumes and len(images.select("path").take(2)) == 1:
        return paired_pixels(spark, images.select(F.col("path").alias("intensity_image")).crossJoin(F.broadcast(masks.select(F.col("path").alias("mask_image")))), box=box)
    return paired_pixels(spark, pair_by_name(images, masks, pattern), box=box)


def _planes(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Planes of z-stacks: path, stack (name with * for its index) and z. Names that don't match a pattern of stacks are an error."""
    named = stack_pattern(pattern)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                name = path.rsplit("/", 1)[-1]
                if named:
                    m = named.fullmatch(name)
                    if not m:
                        raise ValueError(f"{name} doesn't match the pattern {pattern}")
                    rows.append((path, name[: m.start("z")] + "*" + name[m.end("z") :], int(m["z"])))
                elif re.fullmatch(pattern, name) and (key := stack_key(name)):
                    rows.append((path, *key))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["path", "stack", "plane"])

    ship(spark)
    return files(spark, folder).select(_plain("path").alias("path")).mapInArrow(keyed, "path string, stack string, plane long")


def stacked_pixels(spark: SparkSession, folder: str, label_dir: str | None = None, pattern: str = ".*", box: Sequence[int] | None = None) -> DataFrame:
    """Raw voxels of z-stacks, one file a plane: slide_id is the name with * for its index, z the index, and extremes are those of the stack.

    The pattern says where the index stands ({set d+}); without that, names are ..._z<digits>.... Stacks and masks must agree in names and indices.
    """
    planes = _planes(spark, folder, pattern).select("stack", "plane", F.col("path").alias("intensity_image"))
    if label_dir is None:
        both = planes.withColumn("mask_image", F.lit(None).cast("string"))
    else:
        both = stored(planes.join(_planes(spark, label_dir, pattern).select("stack", "plane", F.col("path").alias("mask_image")), ["stack", "plane"], "full"), "planes")
        alone = [f"{r[0]} {r[1]}" for r in both.where("intensity_image is null or mask_image is null").select("stack", "plane").limit(3).collect()]
        if alone:
            raise ValueError(f"stacks and masks differ: {', '.join(alone)}")
    return stored_pixels(both.select(F.col("stack").alias("slide_id"), "intensity_image", "mask_image", F.col("stack").alias("mask_name"), F.col("plane").alias("shift")), box)


def _small_text(spark: SparkSession, path: str) -> str:
    """A small file's text, through Spark's file systems; its readers skip names that start with a dot."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def zarr_pixels(spark: SparkSession, store: str, array: str = "0", channel: int = 0) -> DataFrame:
    """Pixels of a channel of an OME-Zarr v2 image (t, c, z, y, x): each chunk file is decoded where it is read; lo and hi are the chunk's."""
    ship(spark)
    meta = _small_text(spark, f"{store}/{array}/.zarray")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        m = json.loads(meta)
        split = m.get("dimension_separator", ".")
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                index = path.rsplit("/", 5 if split == "/" else 1)[1:] if split == "/" else path.rsplit("/", 1)[1].split(split)
                index = [int(i) for i in index]
                chunk = zarr_chunk(data, meta)
                begin = [i * c for i, c in zip(index, m["chunks"], strict=True)]
                keep = tuple(slice(0, min(c, s - f)) for c, s, f in zip(m["chunks"], m["shape"], begin, strict=True))
                cells = chunk[keep]
                if not begin[1] <= channel < begin[1] + cells.shape[1]:
                    continue
                plane = cells[:, channel - begin[1]]
                t, z, y, x = (v.ravel() for v in np.indices(plane.shape, dtype=np.int64))
                told = (plane.dtype.kind == "f", float(plane.min()), float(plane.max()), "x".join(str(m["shape"][k]) for k in (0, 2, 3, 4)))
                yield _batch(store, t + begin[0], x + begin[4], y + begin[3], z + begin[2], plane.ravel(), *told)

    chunks = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{store}/{array}").where(~F.element_at(F.split("path", "/"), -1).startswith("."))
    return chunks.select("path", "content").mapInArrow(run, _PIXELS)


def zarr_image_pixels(spark: SparkSession, store: str, label_store: str | None = None, array: str = "0", channel: int = 0) -> DataFrame:
    """Raw pixels of an OME-Zarr image with the labels of another one, chunk by chunk; without labels it is one region."""
    values = zarr_pixels(spark, store, array, channel).withColumn("slide_id", F.lit(store)).withColumn("mask_key", F.lit(label_store or store))
    real = _zarr_dtype(spark, store, array).kind == "f"
    if real:
        # chunks' extremes make up the image's
        ends = values.groupBy("slide_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        values = values.drop("lo", "hi").join(F.broadcast(ends), "slide_id")
    masks = zarr_pixels(spark, label_store, array).withColumn("mask_key", F.lit(label_store)) if label_store else None
    return _labelled(values, masks)


def _zarr_dtype(spark: SparkSession, store: str, array: str) -> np.dtype:
    import json

    return np.dtype(json.loads(_small_text(spark, f"{store}/{array}/.zarray"))["dtype"])
