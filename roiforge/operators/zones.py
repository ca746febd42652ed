"""Zones: connected pixels of equal level, labelled by grouped numpy passes.

A region that fits in a tile is labelled by one pass. A larger one is cut into tiles: each is labelled by itself, pixels of equal level that touch
across a seam link their zones, and the links' connected components merge them. Sizes and distances are added up by tile before they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roiforge.functions.sqltext import KEYS, K, of, on, run, with_rows
from roiforge.functions.store import stored
from roiforge.operators.texture import levels_sql, zone_features_sql, zone_neighbours

#: Sides of a tile, in 2D and in 3D: about a million pixels.
TILE, TILE_3D = 1024, 96
#: Cells of a tile up to which it is a row, and cells that are labelled at once then.
FEW_CELLS, BATCH_CELLS = 1024, 1 << 16
#: Links between parts of a region up to which one row holds them.
FEW_LINKS = 1024


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that links (a, b) connect it to: roots hang on lesser roots, then all point at their root again."""
    label = np.arange(n)
    while len(a):
        u, v = label[a], label[b]
        apart = u != v
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def zone_roots(x: np.ndarray, y: np.ndarray, z: np.ndarray, g: np.ndarray, around: tuple, box: np.ndarray | int = 0) -> np.ndarray:
    """For each pixel the rank (by box, z, y, x) of its zone's first pixel. Rows fall into runs of equal levels, and runs that touch are linked.

    box: the number of the box that a pixel is in, of several that don't touch.
    """
    n = len(x)
    order = np.lexsort((x, y, z, np.broadcast_to(box, n)))
    w, h, d = int(x.max() - x.min()) + 3, int(y.max() - y.min()) + 3, int(z.max() - z.min()) + 2
    cell = ((x - x.min() + 1) + w * ((y - y.min() + 1) + h * (z - z.min() + d * box)))[order]
    level = g[order]
    begins = np.concatenate([[True], (cell[1:] != cell[:-1] + 1) | (level[1:] != level[:-1])])
    run_of = np.cumsum(begins) - 1
    links = []
    for dx, dy, dz in around:
        shift = dx + w * (dy + h * dz)
        if shift <= 1:
            continue
        near = np.minimum(np.searchsorted(cell, cell + shift), n - 1)
        hit = (cell[near] == cell + shift) & (level[near] == level)
        pair = np.stack([run_of[hit], run_of[near[hit]]])
        # two runs touch at many pixels, one after the other
        links.append(pair[:, np.concatenate([[True], (pair[:, 1:] != pair[:, :-1]).any(0)])[: pair.shape[1]]])
    a, b = np.concatenate(links, axis=1) if links else np.zeros((2, 0), dtype=np.int64)
    first = np.flatnonzero(begins)
    out = np.empty(n, dtype=np.int64)
    out[order] = first[least_labels(len(first), a, b)][run_of]
    return out


def zones(levels: DataFrame, three_d: bool = False, straight: bool = False) -> DataFrame:
    """Pixels (region, x, y, z, g: their level) with root, the number of their zone in the region."""
    around = zone_neighbours(three_d, straight)

    def label(table: pa.Table) -> pa.Table:
        x, y, z, g = (table.column(c).to_numpy() for c in ("x", "y", "z", "g"))
        return table.append_column("root", pa.array(zone_roots(x, y, z, g, around)))

    return levels.groupBy(*KEYS).applyInArrow(label, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in levels.schema.fields) + ", root bigint")


def extent(pixels: DataFrame) -> int:
    """The longest side of any region's box; 0 without regions."""
    sides = pixels.groupBy(*KEYS).agg(F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("side"))
    return int((sides.agg(F.max("side")).first()[0] or -1) + 1)


def tiled_zones(levels: DataFrame, tile: int, three_d: bool = False, straight: bool = False) -> DataFrame:
    """Pixels with root (the number of their zone's part in the tile's box, counted over the region's box) and the seams that they lie at. Tiles begin at the region's corner.

    seam: a bit for each side of the tile beyond which the region may go on, x, y and z, the lower side first. Small tiles are rows, and many of them are labelled at once.
    """
    around, step = zone_neighbours(three_d, straight), max(1, BATCH_CELLS // tile**3)

    def label(table: pa.Table) -> pa.Table:
        x, y, z, g, cell = (table.column(c).to_numpy() for c in ("x", "y", "z", "g", "cell"))
        order = np.lexsort((x, y, z))
        # a zone is named by its first pixel's number in the region
        return table.drop_columns(["cell"]).append_column("root", pa.array(cell[order][zone_roots(x, y, z, g, around)]))

    def label_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), step):
                rows = batch.slice(first, step)
                n, pixels = np.diff(rows.column(len(KEYS)).offsets.to_numpy()), rows.column(len(KEYS)).flatten()
                owner, begins = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
                x, y, z, g, cell = (pixels.field(c).to_numpy() for c in ("x", "y", "z", "g", "cell"))
                order = np.lexsort((x, y, z, owner))
                inner_ = (v - np.minimum.reduceat(v, begins)[owner] for v in (x, y, z))
                root = cell[order][zone_roots(*inner_, g, around, owner)]
                yield pa.RecordBatch.from_arrays([*rows.select(list(KEYS)).take(pa.array(owner)).columns, *(pixels.field(c) for c in values), pa.array(root)], names=[*KEYS, *values, "root"])

    box = levels.groupBy(*KEYS).agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    at = {c: F.col(c) - F.col(f"lo_{c}") for c in "xyz"}
    wide = {c: F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1 for c in "xyz"}
    inner = {c: F.pmod(at[c], F.lit(tile)) for c in "xyz"}
    sides = [s for c in "xyz" for s in ((inner[c] == 0) & (at[c] > 0), (inner[c] == tile - 1) & (at[c] < wide[c] - 1))]
    seam = sum((s.cast("int") * (1 << k) for k, s in enumerate(sides)), F.lit(0))
    placed = levels.join(box, list(KEYS)).select(*levels.columns, (at["x"] + wide["x"] * (at["y"] + wide["y"] * at["z"])).alias("cell"), seam.alias("seam"), *(F.floor(at[c] / tile).cast("int").alias(f"tile_{c}") for c in "xyz"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields if f.name not in ("cell",)]
    tiles = placed.groupBy(*KEYS, "tile_x", "tile_y", "tile_z")
    if tile**3 > FEW_CELLS:
        return tiles.applyInArrow(label, ", ".join([*kinds, "root bigint"])).drop("tile_x", "tile_y", "tile_z")
    values = [c for c in (*levels.columns, "seam") if c not in KEYS]
    rows = tiles.agg(F.collect_list(F.struct("cell", *values)).alias("pixels")).select(*KEYS, "pixels")
    return rows.mapInArrow(label_many, placed.select(*KEYS, *values).withColumn("root", F.lit(0).cast("bigint")).schema)


def seams(zoned: DataFrame, three_d: bool = False, straight: bool = False) -> DataFrame:
    """Links (region, a, b) between parts of zones that touch across seams; zoned: tiled_zones(). Only pixels at seams are joined, with what lies beyond their own.

    Neither side is broadcast: a written table of zones is small on disk and has many rows.
    """
    half = tuple(d for d in zone_neighbours(three_d, straight) if (d[2], d[1], d[0]) > (0, 0, 0))
    beyond = tuple((*d, sum((1 if v < 0 else 2) << 2 * k for k, v in enumerate(d) if v)) for d in half)
    text = f"""WITH e AS (SELECT {K}, x, y, z, g, root, seam FROM {{pixels}} WHERE seam <> 0),
s AS (SELECT {K}, x + dx AS x, y + dy AS y, z + dz AS z, g, root AS from_ FROM {with_rows("e", "p", beyond, ("dx", "dy", "dz", "sides"), "spark")} WHERE seam & sides <> 0)
SELECT /*+ MERGE(s, e) */ DISTINCT {of("e")}, least(root, from_) AS a, greatest(root, from_) AS b FROM s JOIN e ON {on("s", "e", ["x", "y", "z", "g"])} WHERE root <> from_"""
    return run(zoned, text)


def near_parts(links: DataFrame) -> DataFrame:
    """merged_parts() of regions with few links: each is a row, and a batch of rows is solved at once."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(3), batch.column(4)
            row = np.repeat(np.arange(len(batch)), np.diff(a.offsets.to_numpy()))
            part, owner = np.concatenate([a.flatten().to_numpy(), b.flatten().to_numpy()]), np.concatenate([row, row])
            order = np.lexsort((part, owner))
            part, owner = part[order], owner[order]
            first = np.concatenate([[True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])])[: len(part)]
            node = np.empty(len(order), dtype=np.int64)
            node[order] = np.cumsum(first) - 1
            part, owner = part[first], owner[first]
            least = least_labels(len(part), node[: len(row)], node[len(row) :])
            moved = np.flatnonzero(least != np.arange(len(part)))
            keys = batch.select(list(KEYS)).take(pa.array(owner[moved]))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(part[moved]), pa.array(part[least[moved]])], names=[*KEYS, "part", "root"])

    kinds = {f.name: f.dataType.simpleString() for f in links.schema.fields}
    rows = links.groupBy(*KEYS).agg(F.collect_list(F.struct("a", "b")).alias("l")).select(*KEYS, F.col("l.a").alias("a"), F.col("l.b").alias("b"))
    return rows.mapInArrow(solve, ", ".join([*(f"{k} {kinds[k]}" for k in KEYS), "part bigint, root bigint"]))


def merged_parts(links: DataFrame, most_rounds: int = 60, few: int = FEW_LINKS) -> DataFrame:
    """(region, part, root): connected components of links (region, a, b) within regions, named by their least part; parts without links are left out.

    Regions of at most `few` links take one pass, all others rounds. None of the tables is broadcast: they shrink so much on disk that Spark takes millions of rows for small.
    """
    links = stored(links, "seams")
    count = links.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    if (count.agg(F.max("n")).first()[0] or 0) <= few:
        return near_parts(links)
    wide = stored(count.where(F.col("n") > few).select(*KEYS), "large-regions").hint("merge")
    return near_parts(links.join(wide, list(KEYS), "left_anti")).unionByName(merged_by_rounds(links.join(wide, list(KEYS), "left_semi"), most_rounds))


def merged_by_rounds(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """merged_parts() of regions with any number of links.

    Each round hangs the neighbours of every part on the least that it knows, first the larger ones and then the smaller ones, so links become
    stars in a logarithmic number of rounds and never grow in number. Rounds are written to the shared folder.
    """
    keys = list(KEYS)
    now, before = stored(links, "seams"), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        larger = both.where("b > a").join(least.hint("merge"), [*keys, "a"]).select(*keys, F.col("m").alias("a"), "b").distinct()
        nearest = larger.groupBy(*keys, "b").agg(F.min("a").alias("m"))
        across = larger.join(nearest.hint("merge"), [*keys, "b"])
        now = stored(across.where("a > m").select(*keys, F.col("m").alias("a"), F.col("a").alias("b")).union(across.select(*keys, F.col("m").alias("a"), "b")).distinct(), "seams")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            return now.select(*keys, F.col("b").alias("part"), F.col("a").alias("root"))
        before = state
    raise RuntimeError("zones did not settle")


@dataclass(frozen=True)
class Zones:
    """Labelled pixels, and what their parts belong to where regions were cut into tiles."""

    pixels: DataFrame
    merged: DataFrame | None = None


def labelled(levels: DataFrame, three_d: bool = False, straight: bool = False, tile: int | None = None, keep: bool = False) -> Zones:
    """Zones of pixels with levels. Where a region is longer than a tile's side, all are labelled by tile; zones are the same. keep: written, for several features."""
    side = tile or (TILE_3D if three_d else TILE)
    if extent(levels) <= side:
        found = zones(levels, three_d, straight)
        return Zones(stored(found, "zones") if keep else found)
    parts = stored(tiled_zones(levels, side, three_d, straight), "zones")
    return Zones(parts, merged_parts(seams(parts, three_d, straight)))


def features_of(found: Zones, family: str, three_d: bool = False) -> DataFrame:
    """GLSZM or GLDZM features of each region from its zones."""
    if found.merged is None:
        return run(found.pixels, zone_features_sql(family, three_d), zones=found.pixels)
    return run(found.pixels, zone_features_sql(family, three_d, merged=True), zones=found.pixels, merged=found.merged)


def zone_features(pixels: DataFrame, family: str, depth: int = 64, three_d: bool = False, straight: bool = False, background: bool = False, tile: int | None = None) -> DataFrame:
    """GLSZM or GLDZM features of each region of pixels."""
    return features_of(labelled(run(pixels, levels_sql(depth, background)), three_d, straight, tile), family, three_d)
