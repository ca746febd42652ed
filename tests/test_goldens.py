"""Geometry on a small region with a hole, against values that other implementations pin."""

import math

import numpy as np
import pytest

from roiforge.functions.sqltext import run
from roiforge.operators import geometry, outline, shape, spatial
from roiforge.sources.arrays import montage

# fixed values: an 8x8 image of one region with a hole, 0 outside it
SHAPE = np.array([
    [0, 0, 12, 14, 0, 0, 0, 0],
    [0, 18, 20, 24, 26, 0, 0, 0],
    [30, 32, 35, 38, 42, 45, 0, 0],
    [34, 37, 40, 0, 48, 52, 0, 0],
    [0, 44, 47, 51, 55, 0, 0, 0],
    [0, 0, 53, 58, 62, 0, 0, 0],
    [0, 0, 0, 63, 68, 0, 0, 0],
    [0, 0, 0, 0, 0, 0, 0, 0],
])

# fixed values: its features
PINNED = {
    "STAT_FERET_DIAM_MIN": 4.47301, "STAT_FERET_DIAM_MAX": 6.3222, "STAT_FERET_DIAM_MEAN": 5.40848, "STAT_FERET_DIAM_MEDIAN": 5.19615,
    "STAT_FERET_DIAM_STDDEV": 0.550668, "STAT_FERET_DIAM_MODE": 5.0, "STAT_MARTIN_DIAM_MIN": 4.25885, "STAT_MARTIN_DIAM_MAX": 6.12801,
    "STAT_MARTIN_DIAM_MEAN": 5.01762, "STAT_MARTIN_DIAM_MEDIAN": 4.97511, "STAT_MARTIN_DIAM_STDDEV": 0.553162, "STAT_MARTIN_DIAM_MODE": 4.0,
    "STAT_NASSENSTEIN_DIAM_MIN": 1.67316, "STAT_NASSENSTEIN_DIAM_MAX": 6.24165, "STAT_NASSENSTEIN_DIAM_MEAN": 4.77746, "STAT_NASSENSTEIN_DIAM_MEDIAN": 5.03857,
    "STAT_NASSENSTEIN_DIAM_STDDEV": 1.09628, "STAT_NASSENSTEIN_DIAM_MODE": 4.0, "ALLCHORDS_MIN": 1.0, "EROSIONS_2_VANISH_COMPLEMENT": 0.0,
    "MIN_FERET_ANGLE": 40.0, "MAX_FERET_ANGLE": 110.0, "MAXCHORDS_MAX": 6.0, "MAXCHORDS_MIN": 3.0,
    "MAXCHORDS_MEDIAN": 4.0, "MAXCHORDS_MEAN": 4.550000000000001, "MAXCHORDS_MODE": 4.0, "MAXCHORDS_STDDEV": 0.944513241388333,
    "ALLCHORDS_MAX": 6.0, "ALLCHORDS_MEDIAN": 3.0, "ALLCHORDS_MEAN": 2.913461538461538, "ALLCHORDS_MODE": 3.0,
    "ALLCHORDS_STDDEV": 1.3446086298393252, "MAXCHORDS_MAX_ANG": 0.0, "MAXCHORDS_MIN_ANG": 0.9424777960769379, "ALLCHORDS_MAX_ANG": 0.0,
    "ALLCHORDS_MIN_ANG": 0.15707963267948966, "PERIMETER": 26.9349412836191, "CIRCULARITY": 0.671081973229055, "DIAMETER_MIN_ENCLOSING_CIRCLE": 6.32475519180298,
    "DIAMETER_CIRCUMSCRIBING_CIRCLE": 12.3317073399088, "DIAMETER_INSCRIBING_CIRCLE": 0.828486893405308, "EDGE_MEAN_INTENSITY": 41.8333333333333, "EDGE_STDDEV_INTENSITY": 16.7691944455582,
    "EDGE_MAX_INTENSITY": 68.0, "EDGE_MIN_INTENSITY": 12.0, "EDGE_INTEGRATED_INTENSITY": 753.0, "CONVEX_HULL_AREA": 27.0,
    "SOLIDITY": 0.9629629629629629, "EROSIONS_2_VANISH": 1.0, "DIAMETER_EQUAL_PERIMETER": 8.573658094355881, "GEODETIC_LENGTH": 11.13182483477333,
    "THICKNESS": 2.3356458070362205,
}
ZERNIKE = [
    0.02049738595695693, 0.035831084484416686, 0.07395376659930046, 0.03543505026559769, 0.09232379744549755, 0.011030627605166297,
    0.13199834370886107, 0.13453286019693309, 0.00788523106321295, 0.0824240648198574, 0.04906207177259106, 0.0040585552756590825,
    0.14488178557089382, 0.23625456011991602, 0.03803257026905974, 0.0011694758904577424, 0.016507094944884948, 0.10703041567067684,
    0.021302528534918392, 0.0006179189718397402, 0.10313303720229962, 0.23275354391334316, 0.08692094259111556, 0.006336222387187414,
    0.00016460740533666494, 0.0857008250343988, 0.15183975656312645, 0.052012830525298454, 0.004511245229389611, 0.00015124210515210458,
]
# fixed values: a cell's pixels and its response shares at (theta, frequency) pairs
CELL = np.array([
    [0, 77, 90, 100, 110, 104, 88, 0, 0, 0],
    [80, 110, 116, 126, 122, 117, 115, 111, 95, 0],
    [106, 119, 125, 132, 110, 104, 120, 131, 124, 84],
    [124, 143, 132, 129, 126, 123, 145, 130, 116, 97],
    [112, 144, 147, 139, 148, 153, 149, 129, 106, 91],
    [96, 120, 127, 122, 130, 139, 125, 113, 109, 0],
    [0, 99, 109, 103, 102, 116, 101, 95, 92, 0],
    [0, 0, 91, 103, 100, 98, 93, 89, 80, 0],
    [0, 0, 0, 75, 94, 95, 88, 82, 0, 0],
])
SHARES = [1.0112359550561798, 0.9213483146067416, 0.9662921348314607, 0.6179775280898876]
RELATIONAL = {
    "AREA_PIXELS_COUNT": 26.0, "CENTROID_X": 2.61538461538462, "CENTROID_Y": 2.84615384615385, "WEIGHTED_CENTROID_X": 2.84160305343511,
    "WEIGHTED_CENTROID_Y": 3.43893129770992, "COMPACTNESS": 0.027517678630878, "BBOX_XMIN": 0.0, "BBOX_YMIN": 0.0,
    "BBOX_WIDTH": 6.0, "BBOX_HEIGHT": 7.0, "DIAMETER_EQUAL_AREA": 5.75362739175159, "EXTENT": 0.619047619047619,
    "ASPECT_RATIO": 0.857142857142857, "MAJOR_AXIS_LENGTH": 6.96881616898619, "MINOR_AXIS_LENGTH": 5.48870991295738, "ELONGATION": 0.787610087547462,
    "ECCENTRICITY": 0.616173960820708, "ORIENTATION": 70.4173944984207, "ROUNDNESS": 0.681656295209303, "EULER_NUMBER": 0.0,
    "MASS_DISPLACEMENT": 0.634476074243407,
}
# fixed values: five regions, and the scores of the one in the middle
SCENE = np.array([
    [0, 0, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, 3, 3, 0, 0, 0],
    [0, 0, 0, 0, 3, 3, 0, 0, 0],
    [0, 0, 2, 2, 1, 1, 1, 4, 4],
    [0, 0, 2, 2, 1, 1, 1, 4, 4],
    [0, 0, 0, 0, 1, 1, 1, 4, 4],
    [0, 0, 0, 0, 0, 5, 5, 0, 0],
    [0, 0, 0, 0, 0, 5, 5, 0, 0],
])
SCORES = (2.0833333333333357, 6.8823312738837217, 0.188079)


def region(image):
    y, x = np.nonzero(image)
    return geometry.Region(x, y, image[y, x])


@pytest.mark.parametrize("group", [g for g in geometry.GROUPS if g not in ("radius", "radial", "gabor", "weighted_moments", "weighted_intensity_moments")])
def test_pinned_geometry(group):
    found = dict(zip(geometry.GROUPS[group], geometry.COMPUTE[group](region(SHAPE)), strict=True))
    wanted = {n: v for n, v in PINNED.items() if n in found}
    assert {n: found[n] for n in wanted} == pytest.approx(wanted, rel=1e-3, abs=1e-9)


def test_pinned_zernike():
    assert geometry.zernike_features(region(SHAPE)) == pytest.approx(ZERNIKE, abs=1e-9)
    textbook = geometry.zernike_features(region(SHAPE), shift=0)
    assert textbook[0] == pytest.approx(1 / math.pi, abs=0.02) and textbook != pytest.approx(ZERNIKE, abs=1e-3)


def test_pinned_gabor():
    pairs = [(math.degrees(4.0), 0.0), (math.degrees(16.0), math.pi / 4), (math.degrees(32.0), math.pi / 2), (math.degrees(64.0), 3 * math.pi / 4)]
    assert geometry.gabor_features(region(CELL), pairs=pairs) == pytest.approx(SHARES, rel=1e-9)


def test_pinned_relations(spark):
    px = montage(spark, SHAPE, (SHAPE > 0).astype(int))
    found = {}
    for text in (shape.morphology_sql(), shape.ellipse_sql(), shape.euler_sql()):
        found |= run(px, text).first().asDict()
    assert {n: found[n] for n in RELATIONAL} == pytest.approx(RELATIONAL, rel=1e-3, abs=1e-9)


def test_pinned_polygons(spark):
    px = montage(spark, SCENE, SCENE)
    scores = geometry.polygonality(run(px, spatial.neighbours_sql()), outline.geometry(px, ["contour", "hull", "caliper"])).where("label = 1").first()
    assert tuple(scores[n] for n in geometry.POLYGONS) == pytest.approx(SCORES, rel=1e-3)


def test_distances_to_the_contour_are_exact():
    """Radii, rings and weights rest on exact distances to the contour, pixel by pixel."""
    rng = np.random.default_rng(4)
    for image in (SHAPE, CELL, (rng.random((19, 27)) < 0.6).astype(int) * 7):
        r = region(image)
        p = np.stack([r.x - r.x0, r.y - r.y0], axis=1)
        d2 = ((p[:, None] - r.contour[None]) ** 2).sum(2)
        assert (r.distances == d2.min(1)).all()
        assert geometry.radius_features(r) == pytest.approx([d2.min(1).mean(), d2.min(1).max(), np.median(d2.min(1))])
        centre = p[np.argmin(d2.max(1) - d2.min(1))]
        most = math.sqrt(((r.contour - centre) ** 2).sum(1).max())
        ring = np.minimum((7 * np.hypot(*(p - centre).T) / most).astype(int), 7)
        assert geometry.radial_features(r)[:8] == pytest.approx((np.bincount(ring, minlength=8) / r.n).tolist(), abs=1e-8)
        f = np.log(np.sqrt(d2.min(1)) + 0.001)
        assert geometry.COMPUTE["weighted_moments"](r)[0] == pytest.approx(f.sum())


def test_walks_along_borders():
    ring = np.ones((3, 3), int)
    ring[1, 1] = 0
    assert region(ring).perimeter == 8 and len(region(ring).contour) == 8
    assert len(region(np.ones((1, 1), int)).contour) == 0 and region(np.ones((1, 1), int)).perimeter == 0
    assert region(np.ones((1, 5), int)).perimeter == 8
    thick = np.ones((7, 7), int)
    thick[3, 3] = 0
    # the border of the hole is walked, too
    assert len(region(thick).contour) == 24 + 4
    two = np.zeros((5, 9), int)
    two[1:4, 1:4] = two[1:4, 6:9] = 1
    assert [len(c) for c in region(two).contours] == [8, 8]


def test_erosions_survived():
    for side, survived in ((1, 0), (2, 0), (3, 1), (9, 4), (100, 49)):
        assert geometry.erosion_features(region(np.ones((side, side), int)))[0] == survived
