"""The digital phantom of the image biomarker standard: consensus values, means over its four slices."""

import numpy as np
import pytest

from roiforge.functions.sqltext import run
from roiforge.operators import firstorder, texture
from roiforge.operators.zones import zone_features, zone_roots
from roiforge.sources.arrays import montage

# fixed values: the standard's digital phantom, four slices of four rows; 0 lies outside its mask
PHANTOM = np.array([
    [[1, 4, 4, 1, 1], [1, 4, 6, 1, 1], [4, 1, 6, 4, 1], [4, 4, 6, 4, 1]],
    [[1, 4, 4, 1, 1], [1, 1, 6, 1, 1], [0, 1, 3, 1, 1], [4, 4, 6, 1, 1]],
    [[1, 4, 4, 0, 0], [1, 1, 1, 1, 1], [1, 1, 0, 1, 1], [1, 1, 6, 1, 1]],
    [[1, 4, 4, 0, 0], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, 6, 1, 1]],
])


@pytest.fixture(scope="module")
def phantom(spark):
    return montage(spark, PHANTOM, (PHANTOM > 0).astype(int)).cache()


def means(df, prefix):
    rows = [r.asDict() for r in df.collect()]
    return {k.removeprefix(prefix): float(np.mean([r[k] for r in rows])) for k in rows[0] if k.startswith(prefix)}


def close(found, wanted, tolerance=1e-2):
    for k, v in wanted.items():
        assert found[k] == pytest.approx(v, rel=tolerance), k


def test_glcm(phantom):
    close(means(run(phantom, texture.glcm_sql(0)), "GLCM_"), {"ACOR": 5.09, "CONTRAST": 5.28, "ASM": 0.368, "JE": 2.05, "JMAX": 0.519, "DIS": 1.42, "CLUTEND": 5.47, "JAVE": 2.14})


def test_glrlm(phantom):
    close(means(run(phantom, texture.glrlm_sql(0)), "GLRLM_"), {"SRE": 0.641, "LRE": 3.78, "RP": 0.627, "RE": 2.17})


def test_glszm_and_gldzm(phantom):
    close(means(zone_features(phantom, "GLSZM", 0), "GLSZM_"), {"SAE": 0.363, "LAE": 43.9, "ZP": 0.24, "HGLZE": 16.4})
    close(means(zone_features(phantom, "GLDZM", 0), "GLDZM_"), {"SDE": 0.946, "LDE": 1.21, "HGLZE": 16.4})


def test_gldm_and_ngtdm(phantom):
    close(means(run(phantom, texture.gldm_sql(0)), "GLDM_"), {"SDE": 0.158, "LDE": 19.2, "DN": 3.96, "DV": 2.73})
    close(means(run(phantom, texture.ngtdm_sql(0)), "NGTDM_"), {"COARSENESS": 0.121, "CONTRAST": 0.925, "BUSYNESS": 2.99, "COMPLEXITY": 10.4, "STRENGTH": 2.88})


def test_first_order_of_the_whole_phantom(phantom):
    whole = phantom.selectExpr("'all' slide_id", "t", "label", "x", "y", "z", "inten")
    row = run(whole, firstorder.intensity_sql()).first().asDict()
    close(row, {"MEAN": 2.15, "VARIANCE_BIASED": 3.05, "ENERGY": 567, "ROOT_MEAN_SQUARED": 2.77, "MEDIAN": 1})


def test_degenerate_regions(spark):
    images = np.zeros((3, 4, 4), dtype=int)
    images[0, 1, 1], images[1], images[2, :2, :2] = 5, 7, [[1, 0], [2, 3]]
    px = montage(spark, images, np.array([(images[0] > 0).astype(int), np.ones((4, 4), int), (images[2] > 0).astype(int)]))
    for text in (firstorder.intensity_sql(), firstorder.ih_sql(), texture.glcm_sql(8, averaged=True), texture.glrlm_sql(8, averaged=True), texture.gldm_sql(8), texture.ngldm_sql(8), texture.ngtdm_sql(8)):
        for row in run(px, text).collect():
            assert all(v is not None and np.isfinite(v) for v in row.asDict().values() if isinstance(v, float))
    row = {r["slide_id"]: r for r in run(px, firstorder.intensity_sql()).collect()}
    assert row["slide1"]["VARIANCE"] == 0 and row["slide1"]["SKEWNESS"] == 0 and row["slide0"]["MEDIAN"] == 5


def test_zones_follow_eight_neighbours():
    x, y = np.array([0, 1, 2, 0, 2]), np.array([0, 1, 0, 2, 2])
    one = np.ones(5, dtype=int)
    assert len(set(zone_roots(x, y, 0 * one, one, texture.AROUND).tolist())) == 1
    four = tuple(o for o in texture.AROUND if 0 in o[:2])
    assert len(set(zone_roots(x, y, 0 * one, one, four).tolist())) == 5
