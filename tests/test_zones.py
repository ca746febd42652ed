"""Zones of regions cut into tiles against one pass over the whole region."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roiforge.functions.sqltext import run
from roiforge.functions.store import stored
from roiforge.operators import texture, zones
from roiforge.operators.zones import zone_features, zone_roots
from roiforge.sources.arrays import montage


def levels(df):
    return run(df, texture.levels_sql(0))


def frame(spark, pixels):
    return spark.createDataFrame([("s", 0, int(k), *map(int, p)) for k, p in pixels], "slide_id string, t long, label long, x long, y long, z long, inten long")


def shape(rng, side, levels, depth=1, hole=0.1):
    cells = np.argwhere(rng.random((depth, side, side)) > hole)
    # patches, so that zones are large and wind through tiles
    field = rng.integers(1, levels + 1, (depth, side // 3 + 1, side // 3 + 1)).repeat(3, axis=1).repeat(3, axis=2)
    return [(x - 7, y + 3, z, field[z, y, x]) for z, y, x in cells.tolist()]


@pytest.mark.parametrize("tile, three_d, straight", [(4, False, False), (7, False, True), (16, False, False), (5, True, False)])
def test_tiled_zones_are_those_of_one_pass(spark, tile, three_d, straight):
    rng = np.random.default_rng(tile)
    pixels = [(k, p) for k in (1, 2) for p in shape(rng, 13 if three_d else 30, 2 + k, 4 if three_d else 1)]
    df = frame(spark, pixels)
    parts = zones.tiled_zones(levels(df), tile, three_d, straight)
    merged = {(r["label"], r["part"]): r["root"] for r in zones.merged_parts(zones.seams(parts, three_d, straight)).collect()}
    found = {}
    for r in parts.collect():
        found.setdefault(r["label"], {})[r["x"], r["y"], r["z"]] = merged.get((r["label"], r["root"]), r["root"])
    for k in (1, 2):
        mine = [p for label, p in pixels if label == k]
        roots = zone_roots(*np.array(mine).T, texture.zone_neighbours(three_d, straight))
        pairs = {(int(root), found[k][p[:3]]) for root, p in zip(roots, mine, strict=True)}
        # one to one
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    for family in ("GLSZM", "GLDZM"):
        rows = [sorted(zone_features(df, family, 0, three_d, straight, tile=t).collect()) for t in (tile, 1000)]
        assert all(tuple(a)[3:] == pytest.approx(tuple(b)[3:]) for a, b in zip(*rows, strict=True))


@pytest.mark.parametrize("family", ["GLSZM", "GLDZM"])
def test_tiles_are_not_broadcast(spark, family):
    # a few kB on disk: by their size Spark would send millions of pixels at seams through the driver
    pixels = [(k, p) for k in range(1, 9) for p in shape(np.random.default_rng(k), 9, 3)]
    parts = stored(zones.tiled_zones(levels(frame(spark, pixels)), 4), "zones")
    for df in (zones.seams(parts), zones.features_of(zones.Zones(parts, zones.merged_parts(zones.seams(parts))), family)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("three_d", [False, True])
def test_many_tiles_at_once_are_those_of_a_group_each(spark, monkeypatch, three_d):
    # regions of other places and sizes, one of a single pixel, several batches
    rng = np.random.default_rng(11)
    pixels = [(k, (x + 50 * k, y - 9 * k, z * 2 + k, g)) for k in range(1, 8) for x, y, z, g in shape(rng, 3 + k, 2, 3)] + [(9, (10**6, 10**6, 7, 1))]
    df = frame(spark, pixels)
    monkeypatch.setattr(zones, "BATCH_CELLS", 100)
    found = zones.tiled_zones(levels(df), 3, three_d)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    monkeypatch.setattr(zones, "FEW_CELLS", 0)
    grouped = zones.tiled_zones(levels(df), 3, three_d)
    assert "MapInArrow" not in grouped._jdf.queryExecution().toString()
    assert sorted(found.select(*grouped.columns).collect()) == sorted(grouped.collect()) and found.count() == len(pixels)
    # only what lies on two sides of a seam is joined
    at = {(r["label"], r["x"], r["y"], r["z"]): r for r in grouped.collect()}
    around = [d for d in texture.zone_neighbours(three_d) if (d[2], d[1], d[0]) > (0, 0, 0)]
    near = lambda k, d: at.get((k[0], *(v + s for v, s in zip(k[1:], d, strict=True))))
    links = {(k[0], *sorted((r["root"], o["root"]))) for k, r in at.items() for d in around if (o := near(k, d)) and o["g"] == r["g"] and o["root"] != r["root"]}
    assert {(r["label"], r["a"], r["b"]) for r in zones.seams(grouped, three_d).collect()} == links and links


def test_a_spiral_over_many_tiles(spark):
    # one zone that passes every tile again and again
    side, x, y, dx, dy = 41, 0, 0, 1, 0
    grid = np.zeros((side, side), int)
    grid[0, 0] = 1
    turns = 0
    while turns < 2:
        ahead, beyond = (y + dy, x + dx), (y + 2 * dy, x + 2 * dx)
        inside = lambda p: 0 <= p[0] < side and 0 <= p[1] < side
        if inside(ahead) and not grid[ahead] and not (inside(beyond) and grid[beyond]):
            y, x = ahead
            grid[y, x], turns = 1, 0
        else:
            dx, dy, turns = -dy, dx, turns + 1
    image = np.where(grid == 1, 5, 9)
    df = montage(spark, image, np.ones((side, side), int))
    parts = zones.tiled_zones(levels(df), 6, straight=True)
    roots = parts.join(zones.merged_parts(zones.seams(parts, straight=True)).withColumnRenamed("root", "least"), parts["root"] == F.col("part"), "left")
    found = roots.groupBy("g").agg(F.countDistinct(F.coalesce("least", "root")).alias("k")).collect()
    assert {r["g"]: r["k"] for r in found}[5] == 1


def test_a_region_of_ten_million_pixels(spark):
    side = 3200
    cells = spark.range(side * side).selectExpr("'s' slide_id", "0L t", "1L label", f"id % {side} x", f"id div {side} y", "0L z")
    df = cells.withColumn("inten", 1 + (F.floor(F.col("x") / 800) + F.floor(F.col("y") / 800)) % 2)
    parts = zones.tiled_zones(levels(df), 1024)
    assert parts.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    row = zone_features(df, "GLSZM", 0).first()
    # 8-connected, squares of equal level join at their corners: two zones of half the region each
    assert row["GLSZM_ZP"] == pytest.approx(2 / side**2) and row["GLSZM_LAE"] == pytest.approx((side * side / 2) ** 2)
