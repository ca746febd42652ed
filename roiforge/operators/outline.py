"""Geometry of regions too large for one task: from rows' ends, border pixels and blocks of rows instead of all pixels.

A hull needs the ends of each row only; blocks of rows give the corners of partial hulls, and a region's hull is that of its corners. Contours are walked over
border pixels, which windows along rows and columns find. Distances to the contour are exact: a block of rows takes, for each column, the
targets in it and the nearest ones above and below, and computes its own pixels. Values equal those of one pass over the region.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roiforge.functions.sqltext import KEYS
from roiforge.functions.store import stored
from roiforge.operators import geometry as g

#: Cells of a box beyond which a region is large; rows of a block of partial hulls, and of distances.
LARGE, HULL_ROWS, DISTANCE_ROWS = 1 << 22, 4096, 64
#: Groups of features that need no pass over all of a large region's pixels.
OUTLINED = ("contour", "hull", "fractal", "caliper", "circles", "geodetic", "radius")
_KEYS = list(KEYS)


class Outline:
    """What of a region its border tells: contour and hull, with the number of pixels and the mean place given. Stands in for geometry.Region."""

    def __init__(self, n: int, box: tuple[int, int, int, int], centre: tuple[float, float], x: np.ndarray, y: np.ndarray, inten: np.ndarray, corners: np.ndarray) -> None:
        self.n, (self.x0, self.y0, self.w, self.h) = n, box
        order = np.lexsort((x, y))
        self.x, self.y, self.inten = x[order] - self.x0, y[order] - self.y0, inten[order].astype(float)
        self.centre = np.array(centre) - (self.x0, self.y0)
        self._corners = corners - (self.x0, self.y0)

    def values(self, points: np.ndarray) -> np.ndarray:
        return self.inten[np.searchsorted(self.x + self.w * self.y, points[:, 0] + self.w * points[:, 1])]

    @cached_property
    def contours(self) -> list[np.ndarray]:
        return g.walks(self.x, self.y, self.w)

    contour, perimeter = g.Region.contour, g.Region.perimeter

    @cached_property
    def hull(self) -> np.ndarray:
        return g.hull(self._corners)


def _schema(df: DataFrame, columns: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([*(f"{k} {kinds[k]}" for k in KEYS), columns])


def _named(key: tuple, **columns: object) -> pa.Table:
    """A table of columns (arrays of one length) with a group's region repeated in front."""
    n = len(next(iter(columns.values())))
    return pa.table({**{k: [v.as_py()] * n for k, v in zip(KEYS, key, strict=False)}, **columns})


def _apart(df: DataFrame) -> DataFrame:
    """df with columns of its own, so that it can be grouped beside another table that comes from the same pixels."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])


def hull_corners(pixels: DataFrame) -> DataFrame:
    """(region, n, corners): number of places and the corners x0, y0, x1, y1, ... of the hull.

    Rows' ends are aggregated before they move. Those of a block of rows make a list, of which Python keeps the corners, and so do a region's blocks.
    """
    rows = pixels.groupBy(*KEYS, "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_distinct("x").alias("n"))
    ends = F.collect_list(F.array(F.col("lo").cast("long"), F.col("y").cast("long"), F.col("hi").cast("long"), F.col("y").cast("long")))
    blocks = rows.groupBy(*KEYS, F.floor(F.col("y") / HULL_ROWS).alias("block")).agg(F.sum("n").alias("n"), F.flatten(ends).alias("corners")).drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            at, places = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            found = [g.hull(places[i - at[0] : k - at[0]].reshape(-1, 2)).astype(np.int64).ravel() for i, k in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, pa.list_(pa.int64()))], names=[*KEYS, "n", "corners"])

    schema = _schema(pixels, "n long, corners array<long>")
    regions = blocks.mapInArrow(run, schema).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.flatten(F.collect_list("corners")).alias("corners"))
    return regions.mapInArrow(run, schema)


def hull_features(pixels: DataFrame, groups: Sequence[str], noval: float = 0.0) -> DataFrame:
    """Features of the groups hull and caliper, from corners alone."""
    names = [n for k in groups for n in g.GROUPS[k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, corners in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                c = np.array(corners, dtype=np.int64).reshape(-1, 2)
                low, high = c.min(0), c.max(0)
                r = Outline(n, (*low, *(high - low + 1)), (0.0, 0.0), *np.zeros((3, 0), dtype=np.int64), c)
                rows.append([float(v) for k in groups for v in g.COMPUTE[k](r)])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([r[k] if math.isfinite(r[k]) else noval for r in rows], pa.float64()) for k in range(len(names)))], names=[*KEYS, *names])

    return hull_corners(pixels).mapInArrow(run, _schema(pixels, ", ".join(f"`{n}` double" for n in names)))


def border_pixels(pixels: DataFrame) -> DataFrame:
    """Places (region, x, y, inten) of which a 4-neighbour lies outside the region; of repeated ones the one of least intensity."""
    places = pixels.groupBy(*KEYS, "x", "y").agg(F.min("inten").alias("inten"))
    row, column = Window.partitionBy(*KEYS, "y").orderBy("x"), Window.partitionBy(*KEYS, "x").orderBy("y")
    inner = reduce(lambda a, b: a & b, (F.coalesce(f(c).over(w) == F.col(c) + d, F.lit(False)) for c, w in (("x", row), ("y", column)) for f, d in ((F.lag, -1), (F.lead, 1))))
    return places.select(*KEYS, "x", "y", "inten", inner.alias("inner")).where("not inner").drop("inner")


def outlines(pixels: DataFrame, groups: Sequence[str], noval: float = 0.0, contours: bool = False) -> DataFrame:
    """Features of groups that border and hull tell; with contours the contour's places in a column contour (x0, y0, x1, y1, ...) instead."""
    names = [n for k in groups for n in g.GROUPS[k]]
    told = hull_corners(pixels).join(pixels.groupBy(*KEYS, "x", "y").agg(F.lit(1)).groupBy(*KEYS).agg(F.struct(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy")).alias("box")), _KEYS)

    def one(key: tuple, border: pa.Table, scalars: pa.Table) -> pa.Table:
        row = scalars.to_pylist()[0]
        b = row["box"]
        r = Outline(row["n"], (b["x0"], b["y0"], b["x1"] - b["x0"] + 1, b["y1"] - b["y0"] + 1), (b["cx"], b["cy"]), *(border.column(c).to_numpy() for c in ("x", "y", "inten")), np.array(row["corners"], dtype=np.int64).reshape(-1, 2))
        if contours:
            return _named(key, contour=[(r.contour + (r.x0, r.y0)).ravel().tolist()])
        values = [float(v) for k in groups for v in g.COMPUTE[k](r)]
        return _named(key, **{n: [v if math.isfinite(v) else noval] for n, v in zip(names, values, strict=True)})

    schema = _schema(pixels, "contour array<long>" if contours else ", ".join(f"`{n}` double" for n in names))
    return border_pixels(pixels).groupBy(*KEYS).cogroup(_apart(told).groupBy(*KEYS)).applyInArrow(one, schema)


def block_distances(inside: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Squared distances of a block's cells: targets in it, and for each column how far above its first and below its last row the nearest others lie."""
    h, w = inside.shape
    rows = np.arange(h)[:, None]
    last = np.maximum.accumulate(np.where(inside, rows, -above[None]), axis=0)
    following = np.minimum.accumulate(np.where(inside, rows, (h - 1 + below)[None])[::-1], axis=0)[::-1]
    column = np.minimum(rows - last, following - rows).astype(np.int64) ** 2
    best = column.copy()
    for d in range(1, w):
        if d * d >= best.max():
            break
        np.minimum(best[:, d:], column[:, :-d] + d * d, out=best[:, d:])
        np.minimum(best[:, :-d], column[:, d:] + d * d, out=best[:, :-d])
    return best


def distance_counts(pixels: DataFrame, targets: DataFrame) -> DataFrame:
    """(region, d2, n): how many places of a region have which squared distance to the nearest target (region, x, y); regions without targets are left out."""
    block = F.floor(F.col("y") / DISTANCE_ROWS)
    box = pixels.groupBy(*KEYS).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min(block).alias("b0"), F.max(block).alias("b1"))
    cells = box.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("block", F.explode(F.sequence("b0", "b1")))
    met = targets.withColumn("block", block).groupBy(*KEYS, "x", "block").agg(F.collect_set("y").alias("inside"), F.min("y").alias("first"), F.max("y").alias("last"))
    column = Window.partitionBy(*KEYS, "x").orderBy("block")
    near = cells.join(met, [*KEYS, "x", "block"], "left").select(*KEYS, "x", "block", "inside", F.max("last").over(column.rowsBetween(Window.unboundedPreceding, -1)).alias("above"), F.min("first").over(column.rowsBetween(1, Window.unboundedFollowing)).alias("below"))

    def one(key: tuple, mine: pa.Table, columns: pa.Table) -> pa.Table:
        if not mine.num_rows or not columns.num_rows:
            return _named(key, d2=pa.array([], pa.int64()), n=pa.array([], pa.int64()))
        columns = columns.sort_by("x")
        start, x0 = key[3].as_py() * DISTANCE_ROWS, columns.column("x")[0].as_py()
        far = 1 << 30
        inside = np.zeros((DISTANCE_ROWS, columns.num_rows), dtype=bool)
        for k, ys in enumerate(columns.column("inside").to_pylist()):
            if ys:
                inside[np.array(ys) - start, k] = True
        above, below = (columns.column(c).to_numpy().astype(float) for c in ("above", "below"))
        above = np.where(np.isnan(above), far, start - above).astype(np.int64)
        below = np.where(np.isnan(below), far, below - (start + DISTANCE_ROWS - 1)).astype(np.int64)
        d2, n = np.unique(block_distances(inside, above, below)[mine.column("y").to_numpy() - start, mine.column("x").to_numpy() - x0], return_counts=True)
        return _named(key, d2=d2, n=n)

    grouped = pixels.groupBy(*KEYS, "x", "y").agg(F.lit(1)).select(*KEYS, "x", "y", block.alias("block")).groupBy(*KEYS, "block")
    found = grouped.cogroup(_apart(near).groupBy(*KEYS, "block")).applyInArrow(one, _schema(pixels, "d2 long, n long"))
    return found.join(targets.select(*KEYS).distinct(), _KEYS, "left_semi").groupBy(*KEYS, "d2").agg(F.sum("n").alias("n"))


def radii(pixels: DataFrame) -> DataFrame:
    """ROI_RADIUS_MEAN, _MAX and _MEDIAN: of squared distances to the contour; 0 without one."""
    contour = stored(outlines(pixels, (), contours=True), "contours")
    targets = contour.select(*KEYS, F.posexplode("contour").alias("k", "v"), "contour").where("k % 2 = 0").select(*KEYS, F.col("v").alias("x"), F.get("contour", F.col("k") + 1).alias("y"))
    counts = distance_counts(pixels, targets)
    stats = counts.groupBy(*KEYS).agg((F.sum(F.col("d2") * F.col("n")) / F.sum("n")).alias("mean"), F.max("d2").cast("double").alias("max"), F.expr("percentile(d2, 0.5, n)").alias("median"))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(f"ROI_RADIUS_{name}")
    return contour.select(*KEYS).join(stats, _KEYS, "left").select(*KEYS, zero("mean", "MEAN"), zero("max", "MAX"), zero("median", "MEDIAN"))


def geometry(pixels: DataFrame, groups: Sequence[str], noval: float = 0.0, options: Mapping[str, Mapping] | None = None, large: int = LARGE, cells: int | None = None) -> DataFrame:
    """The features of the given groups, one row a region; see geometry.whole_regions().

    Regions whose box has more than `large` cells take the way of this module in groups that have one (OUTLINED). Others' pixels still meet in one task. cells: the
    most cells that a box can have, where that is known; it spares a pass over the pixels.
    """
    if cells is not None and cells <= min(large, g.SMALL):
        return g.whole_regions(pixels, groups, noval, options, small=True)
    outlined = [k for k in groups if k in OUTLINED]
    size = pixels.groupBy(*KEYS).agg(((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).alias("cells"))
    if not outlined or (most := size.agg(F.max("cells")).first()[0] or 0) <= large:
        return g.whole_regions(pixels, groups, noval, options, small=bool(outlined) and most <= g.SMALL)
    wide = stored(size.where(F.col("cells") > large).select(*KEYS), "large-regions")
    big, rest = pixels.join(wide, _KEYS, "left_semi"), pixels.join(wide, _KEYS, "left_anti")
    parts = []
    if by_hull := [k for k in outlined if k in ("hull", "caliper")]:
        parts.append(hull_features(big, by_hull, noval))
    if by_border := [k for k in outlined if k not in ("hull", "caliper", "radius")]:
        parts.append(outlines(big, by_border, noval))
    if "radius" in outlined:
        parts.append(radii(big))
    others = [k for k in groups if k not in OUTLINED]
    if others:
        parts.append(g.whole_regions(big, others, noval, options))
    joined = reduce(lambda a, b: a.join(b, _KEYS), parts)
    small = g.whole_regions(rest, groups, noval, options)
    return small.unionByName(joined.select(*[F.col(f"`{c}`") for c in small.columns]))
