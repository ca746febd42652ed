import math

import duckdb
import numpy as np
import pytest

from roiforge.functions.sqltext import rounded, run
from roiforge.operators import geometry, shape, spatial, volume
from roiforge.plans.api import NestedRois, SlideFeatures
from roiforge.sources.arrays import montage


def disc(a=20.0, b=10.0, size=60):
    yy, xx = np.mgrid[0:size, 0:size]
    return ((xx - size // 2) / a) ** 2 + ((yy - size // 2) / b) ** 2 <= 1


def region(mask):
    y, x = np.nonzero(mask)
    return geometry.Region(x, y, np.ones(len(x)))


def test_ellipse_and_morphology(spark):
    px = montage(spark, disc().astype(int))
    px = montage(spark, disc().astype(int), disc().astype(int))
    e, m = run(px, shape.ellipse_sql()).first(), run(px, shape.morphology_sql()).first()
    assert e["MAJOR_AXIS_LENGTH"] == pytest.approx(40, rel=0.03) and e["MINOR_AXIS_LENGTH"] == pytest.approx(20, rel=0.05) and e["ORIENTATION"] == 0
    assert m["AREA_PIXELS_COUNT"] == disc().sum() and m["BBOX_WIDTH"] == 41 and m["CENTROID_X"] == 30


def test_caliper_and_hull():
    r = region(disc())
    names = geometry.GROUPS["caliper"]
    c = dict(zip(names, geometry.caliper_features(r), strict=True))
    assert c["STAT_FERET_DIAM_MAX"] == 40 and c["STAT_FERET_DIAM_MIN"] == 20 and c["MIN_FERET_ANGLE"] == 90
    area, solidity = geometry.hull_features(r)
    assert solidity <= 1 and area >= r.n
    assert geometry.circle_features(r)[0] == pytest.approx(40, rel=0.01)


def test_every_group_of_small_shapes():
    ring = np.ones((3, 3), bool)
    ring[1, 1] = False
    for mask in (np.ones((1, 1), bool), np.ones((1, 5), bool), ring, np.array([[1, 0, 1]], bool)):
        for group, compute in geometry.COMPUTE.items():
            assert len(compute(region(mask))) == len(geometry.GROUPS[group])


def test_euler_number(spark):
    ring = np.ones((3, 3), int)
    ring[1, 1] = 0
    two = np.array([[1, 0, 1], [1, 0, 1], [0, 0, 0]])
    found = {r["slide_id"]: r["EULER_NUMBER"] for r in run(montage(spark, np.stack([ring, two]), np.stack([ring, two])), shape.euler_sql()).collect()}
    assert found == {"slide0": 0, "slide1": 2}


def boxes_by_hand(mask):
    """Slope over sides from the padded power of two down to 2; small regions take the least count of four grids."""
    y, x = np.nonzero(mask)
    x, y = x - x.min(), y - y.min()
    padded = 1 << int(max(x.max(), y.max())).bit_length()
    shifts = (0, 1) if padded <= 32 else (0,)
    sides = [2**k for k in range(1, padded.bit_length())]
    counts = [min(len(set(zip((x + i * s // 2) // s, (y + j * s // 2) // s, strict=True))) for i in shifts for j in shifts) for s in sides]
    return -np.polyfit(np.log(sides), np.log(counts), 1)[0] if len(sides) > 1 else 0.0


def test_boxes_up_to_the_padded_side(spark):
    rng = np.random.default_rng(3)
    masks = [np.ones((100, 100), int), (rng.random((33, 90)) < 0.05).astype(int), (rng.random((33, 33)) < 0.5).astype(int), (rng.random((32, 20)) < 0.1).astype(int), (rng.random((13, 17)) < 0.3).astype(int), np.ones((2, 2), int), np.ones((1, 1), int)]
    sheet = np.zeros((len(masks), 100, 100), int)
    for k, m in enumerate(masks):
        sheet[k, : m.shape[0], : m.shape[1]] = m
    px = montage(spark, sheet, sheet)
    found = {r["slide_id"]: r["FRACT_DIM_BOXCOUNT"] for r in SlideFeatures("FRACT_DIM_BOXCOUNT", spark).featurize_pixels(px).collect()}
    assert found == pytest.approx({f"slide{k}": boxes_by_hand(m) for k, m in enumerate(sheet)}, abs=1e-9)
    checked = duckdb.connect().register("px", px.toPandas()).sql(shape.box_counts_sql("duckdb").replace("{pixels}", "px")).fetchall()
    assert found == pytest.approx({r[0]: r[3] for r in checked}, abs=1e-9)


def test_moments(spark):
    px = montage(spark, disc().astype(int), disc().astype(int))
    r = run(px, shape.moments_sql("1e0", shape.SHAPE_NAMES)).first()
    assert r["SPAT_MOMENT_00"] == disc().sum() and abs(r["CENTRAL_MOMENT_10"]) < 1e-6
    assert r["HU_M1"] == pytest.approx(r["NORM_CENTRAL_MOMENT_20"] + r["NORM_CENTRAL_MOMENT_02"])


def test_neighbours_of_five_regions(spark):
    mask = np.zeros((30, 30), dtype=int)
    for label, (y, x) in enumerate([(13, 13), (13, 7), (13, 19), (7, 13), (19, 13)], 1):
        mask[y : y + 3, x : x + 3] = label
    found = {r["label"]: r for r in run(montage(spark, mask, mask), spatial.neighbours_sql(5)).collect()}
    assert found[1]["NUM_NEIGHBORS"] == 4 and found[1]["CLOSEST_NEIGHBOR1_DIST"] == 6 and found[1]["PERCENT_TOUCHING"] == 0
    assert found[2]["CLOSEST_NEIGHBOR1_ANG"] == 0


@pytest.mark.parametrize("radius", [1, 5, 33])
def test_neighbours_across_words(spark, radius):
    rng = np.random.default_rng(7)
    pixels = [(f"s{k % 3}", 0, k, int(x), int(y), 0, 1) for k in range(24) for c, r in [(rng.integers(-60, 60, 2), rng.integers(1, 30))] for x, y in c + rng.integers(-r, r + 1, (1 + k % 4 * r * r, 2))]
    pixels += [("block", 0, k, x, y, 0, 1) for k, (x0, y0, w, h) in enumerate([(-40, 0, 100, 9), (-8, 4, 70, 12), (61, 2, 32, 20), (96, 30, 1, 1)]) for x in range(x0, x0 + w) for y in range(y0, y0 + h)]
    pixels += [("null", *p, 0, 1) for p in [(0, 1, 3, 3), (0, 1, None, 3), (0, 1, 8, None), (0, 2, 4, 3), (0, 2, None, None), (0, 3, None, 4), (0, None, 3, 3), (None, 4, 3, 3)]] + [(None, 0, 1, 1, 1, 0, 1), (None, 0, 2, 1, 1, 0, 1)]
    px = spark.createDataFrame(pixels, "slide_id string, t bigint, label bigint, x bigint, y bigint, z bigint, inten bigint").repartition(3)
    found = run(px, rounded(spatial.neighbours_sql(radius), spatial.NEIGHBOURS, "spark")).collect()
    con = duckdb.connect()
    con.execute("create table px (slide_id varchar, t bigint, label bigint, x bigint, y bigint, z bigint, inten bigint)")
    con.register("rows_", px.toPandas().astype({c: "Int64" for c in ("t", "label", "x", "y")}))
    con.execute("insert into px select * from rows_")
    theirs = con.execute(rounded(spatial.neighbours_sql(radius, "duckdb"), spatial.NEIGHBOURS, "duckdb").replace("{pixels}", "px")).fetchall()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, theirs))
    assert {r["NUM_NEIGHBORS"] for r in found} > {0, 1, 2}


def test_nested_regions(spark):
    outer, inner = np.zeros((20, 20), int), np.zeros((20, 20), int)
    outer[2:12, 2:12], inner[3:5, 3:5], inner[8:10, 8:10], inner[15:17, 15:17] = 1, 1, 2, 3
    parents, children = montage(spark, outer, outer), montage(spark, inner, inner)
    relations = spark.sql(spatial.containment_sql(), parents=parents, children=children)
    assert sorted(r["child_label"] for r in relations.collect()) == [1, 2]
    size = lambda df: df.groupBy("slide_id", "t", "label").count()
    wide = spatial.aggregate_children(relations, size(parents), size(children), "NONE", ["count"], 3).first()
    assert (wide["child1_count"], wide["child2_count"], wide["child3_count"]) == (4, 4, 0)


def test_all_children_are_put_side_by_side(spark):
    outer, inner = np.ones((30, 30), int), np.zeros((30, 30), int)
    for k in range(11):
        inner[2 * k + 1, 1 : k + 2] = k + 1
    parents, children = montage(spark, outer, outer), montage(spark, inner, inner)
    relations = spark.sql(spatial.containment_sql(), parents=parents, children=children)
    size = lambda df: df.groupBy("slide_id", "t", "label").count()
    wide = NestedRois("NONE").featurize(relations, size(parents), size(children), ["count"])
    assert [wide.first()[f"child{k}_count"] for k in range(1, 12)] == list(range(1, 12)) and "child12_count" not in wide.columns
    assert spatial.aggregate_children(relations, size(parents), size(children), "NONE", ["count"], 3).first()["child11_count"] == 11
    assert spatial.aggregate_children(relations.limit(0), size(parents), size(children), "NONE", ["count"]).columns == ["slide_id", "t", "parent_label", "count"]


def test_blacklist_and_pairs(spark):
    assert spatial.parse_blacklist("1, 2") == ({1, 2}, {}) and spatial.parse_blacklist("a:1;b:2,3") == (set(), {"a": {1}, "b": {2, 3}})
    a = spark.createDataFrame([("/i/x.tif",), ("/i/.y.tif",)], "path string")
    assert spatial.pair_by_name(a, spark.createDataFrame([("/m/x.tif",)], "path string")).count() == 1
    with pytest.raises(ValueError, match="without a partner"):
        spatial.pair_by_name(a, spark.createDataFrame([("/m/z.tif",)], "path string"))
    assert spatial.annotations("/m/p0_y1_c0.ome.tif") == ["p0", "y1", "c0"] and spatial.stack_key("img_z012_c1.tif") == ("img_z_c1.tif", 12)


def test_volumes(spark):
    cube = np.ones((4, 4, 4), int)
    r = volume.shape3(montage(spark, cube, volumes=True)).first()
    assert r["3AREA"] == 96 and r["3VOLUME_CONVEXHULL"] == pytest.approx(27) and r["3ELONGATION"] == pytest.approx(1)
    assert volume.hull_volume(np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]])) == pytest.approx(1 / 6)
    s = spark.sql(volume.surface_sql(), pixels=montage(spark, cube, volumes=True)).first()
    assert s["3AREA"] == 96 and s["3VOXEL_VOLUME"] == pytest.approx(64 * math.pi / 6 / 0.5236)
