"""Sinks: final values, slide rows, CSV, Parquet and Arrow IPC."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roiforge.functions.sqltext import KEYS


#: What rows are ordered by, as far as it is there: regions' keys, or the leading columns that stand for them.
_ORDER = ("slide_id", "intensity_image", "mask_image", "t", "t_index", "label", "ROI_label", "parent_label", "child_label")


def without_nan(features: DataFrame, noval: float = 0.0) -> DataFrame:
    """Nulls, NaN and infinities of double columns replaced by noval, in one projection."""
    value = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(noval)).otherwise(F.col(c)).alias(c.strip("`"))
    return features.select(*[value(f"`{n}`") if t == "double" else F.col(f"`{n}`") for n, t in features.dtypes])


def slide_means(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row for each slide and time: means over regions, with label -1."""
    return features.groupBy("slide_id", "t").agg(*[F.avg(f"`{n}`").alias(n) for n in names]).select("slide_id", "t", F.lit(-1).cast("bigint").alias("label"), *(F.col(f"`{n}`") for n in names))


def with_header_columns(features: DataFrame, slides: DataFrame) -> DataFrame:
    """Leading columns intensity_image, mask_image, anno0.., ROI_label, t_index; slides has slide_id, both names and annots."""
    n = slides.agg(F.max(F.size("annots"))).first()[0] or 0
    rest = [c for c in features.columns if c not in KEYS]
    joined = features.join(F.broadcast(slides) if slides.count() < 100_000 else slides, "slide_id", "left")
    return joined.select("intensity_image", "mask_image", *[F.get("annots", k).alias(f"anno{k}") for k in range(n)], F.col("label").cast("int").alias("ROI_label"), F.col("t").cast("double").alias("t_index"), *(F.col(f"`{c}`") for c in rest))


def roi_metrics(pixels: DataFrame, large: int = 1 << 22) -> DataFrame:
    """A row a region: area, box, extremes, bytes of its dense image, and OVERSIZE where its box has more than large cells, so that geometry takes the way for large regions."""
    found = pixels.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"),
        (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), F.min("inten").alias("min_intens"), F.max("inten").alias("max_intens"),
    )
    cells = F.col("width") * F.col("height")
    return found.withColumn("size_bytes", cells * 8).withColumn("size_class", F.when(cells > large, "OVERSIZE").otherwise("TRIVIAL"))


def _stem(column: str) -> Column:
    return F.regexp_replace(F.element_at(F.split(column, "/"), -1), r"\.[^.]*$", "")


def write_files(rows: DataFrame, folder: str, name: str = "file_name", how: str = "csv") -> list[str]:
    """One file for each value of the column name, below folder, which driver and executors share; gives the names, sorted.

    Rows of a name must lie together in one partition. The task that holds them writes them batch by batch under a name of its own attempt and
    moves the file when it is whole, so a lost or doubled task leaves no partial file. Files that are there already are replaced. No rows, no files.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import csv, fs

        base = re.sub("^file:/+", "/", folder).rstrip("/")
        system, base = fs.FileSystem.from_uri(base if ":" in base else str(Path(base).absolute()))
        system.create_dir(base, recursive=True)
        attempt, now, sink, writer = TaskContext.get().taskAttemptId(), None, None, None

        def finish() -> pa.RecordBatch:
            writer.close()
            sink.close()
            if system.get_file_info(f"{base}/{now}").type != fs.FileType.NotFound:
                system.delete_file(f"{base}/{now}")
            system.move(f"{base}/.{now}.{attempt}", f"{base}/{now}")
            return pa.RecordBatch.from_pydict({name: [now]})

        for batch in batches:
            names = batch.column(name).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else []
            for at, end in zip(begins, [*begins[1:], len(names)], strict=True):
                part = batch.slice(at, end - at).drop_columns([name])
                if names[at] != now:
                    if now is not None:
                        yield finish()
                    now = names[at]
                    sink = system.open_output_stream(f"{base}/.{now}.{attempt}")
                    writer = csv.CSVWriter(sink, part.schema) if how == "csv" else pa.ipc.new_file(sink, part.schema)
                writer.write_batch(part if how != "arrow empty" else part.slice(0, 0))
        if now is not None:
            yield finish()

    return sorted(r[0] for r in rows.mapInArrow(task, f"`{name}` string").toLocalIterator())


def write_by_pair(features: DataFrame, folder: str, noval: float = 0.0) -> list[str]:
    """A CSV for each pair of an image and its mask, _INT_image_SEG_mask.csv; features lead with both names, as with_header_columns gives them."""
    named = without_nan(features, noval).withColumn("file_name", F.concat(F.lit("_INT_"), _stem("intensity_image"), F.lit("_SEG_"), _stem("mask_image"), F.lit(".csv")))
    return write_files(named.repartition("file_name").sortWithinPartitions("file_name", *[c for c in _ORDER if c in features.columns]), folder)


def write_roi_metrics(pixels: DataFrame, folder: str) -> list[str]:
    """A CSV of roi_metrics for each mask, roi_metrics_mask.csv; pixels have mask_image, else slides' names stand for it."""
    mask = "mask_image" if "mask_image" in pixels.columns else "slide_id"
    names = pixels.select("slide_id", F.concat(F.lit("roi_metrics_"), _stem(mask), F.lit(".csv")).alias("file_name")).distinct()
    named = roi_metrics(pixels).join(names, "slide_id")
    return write_files(named.repartition("file_name").sortWithinPartitions("file_name", *KEYS).select("file_name", "t", *(c for c in named.columns if c not in ("file_name", "slide_id", "t"))), folder)


def write(features: DataFrame, path: str, single: bool = False, per_slide: bool = False, noval: float = 0.0) -> str:
    """Writes features as the path's extension says: .csv (one folder a slide with per_slide, one file with single), .parquet, .arrow or .feather.

    Rows are ordered by slide, time and label within each file. Arrow IPC and a single CSV are one file, which one task writes batch by batch; no rows pass the driver.
    """
    kind = Path(path).suffix.lower()
    final = without_nan(features, noval)
    by = [c for c in _ORDER if c in final.columns]
    ordered = final if not by else final.orderBy(*by) if single else final.sortWithinPartitions(*by)
    if kind == ".parquet":
        ordered.write.mode("overwrite").option("compression", "snappy").parquet(path)
    elif kind in (".arrow", ".feather", ".ipc"):
        where, file = path.rstrip("/").rsplit("/", 1) if "/" in path else (".", path)
        rows = (final.orderBy(*by) if by else final).coalesce(1)
        if not write_files(rows.withColumn("file_name", F.lit(file)), where, how="arrow"):
            one = final.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in final.schema])
            write_files(one.withColumn("file_name", F.lit(file)), where, how="arrow empty")
    elif kind == ".csv":
        one = ordered.coalesce(1) if single else ordered
        writer = one.write.mode("overwrite").option("header", True)
        (writer.partitionBy("slide_id") if per_slide else writer).csv(path)
    else:
        raise ValueError(f"no writer for {kind or path}")
    return path
