"""Large regions' geometry, nesting by grids, aggregates of children and texture of levels, against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roiforge.functions.sqltext import run
from roiforge.operators import geometry, outline, spatial, texture
from roiforge.plans.api import NestedRois
from tests.test_zones import frame


def blobs(rng, side, k):
    """Overlapping boxes and scattered dots, with holes."""
    m = np.zeros((side, side), bool)
    for _ in range(k):
        y, x = rng.integers(0, side - 8, 2)
        m[y : y + rng.integers(3, 30), x : x + rng.integers(3, 30)] = True
    m[rng.random(m.shape) < 0.02] = False
    m[rng.integers(0, side, 5), rng.integers(0, side, 5)] = True
    return m


def test_outlined_regions_are_those_of_one_pass(spark, monkeypatch):
    monkeypatch.setattr(outline, "HULL_ROWS", 16)
    rng = np.random.default_rng(2)
    pixels = []
    for label in (1, 2):
        m = blobs(rng, 70 + 40 * label, 9)
        pixels += [(label, (x - 30, y + 11, 0, 1 + (7 * x + y) % 50)) for y, x in np.argwhere(m).tolist()]
    # a region of a row, one of a pixel, and one below the limit
    pixels += [(3, (x, 5, 0, 3)) for x in range(40)] + [(4, (9, 9, 0, 1))] + [(5, (x, y, 0, x + 1)) for x in range(5) for y in range(4)]
    df = frame(spark, pixels)
    groups = ["radius", *outline.OUTLINED[:-1], "erosion"]
    want = {r["label"]: r.asDict() for r in geometry.whole_regions(df, groups).collect()}
    for large in (25, 1 << 40):
        found = {r["label"]: r.asDict() for r in outline.geometry(df, groups, large=large).collect()}
        assert found.keys() == want.keys()
        for label, row in want.items():
            assert found[label] == pytest.approx(row), label


def test_distances_by_blocks_of_rows(monkeypatch):
    rng = np.random.default_rng(3)
    targets = rng.random((40, 33)) < 0.03
    whole = geometry.squared_distances(targets)
    rows = np.arange(40)[:, None]
    for start in (0, 8, 32):
        inside = targets[start : start + 8]
        above = np.where(targets & (rows < start), rows, -(1 << 20)).max(0)
        below = np.where(targets & (rows >= start + 8), rows, 1 << 20).min(0)
        assert np.array_equal(outline.block_distances(inside, start - above, below - (start + 7)), whole[start : start + 8])


def test_a_hull_without_grouping_pixels(spark):
    side = 3000
    df = spark.range(side * side).selectExpr("'s' slide_id", "0L t", "1L label", f"id % {side} x", f"id div {side} y", "0L z", "1L inten").where("x + y >= 1000 and x + y < 5000")
    plan = outline.hull_corners(df)._jdf.queryExecution().executedPlan().toString()
    # the rows' ends are what reaches Python, aggregated before they are shuffled
    assert plan.index("MapInArrow") < plan.index("HashAggregate") and "FlatMapGroups" not in plan
    row = outline.geometry(df, ["hull", "caliper"]).first()
    assert row["CONVEX_HULL_AREA"] == df.count() and row["SOLIDITY"] == 1


def test_nesting_by_grids(spark):
    rng = np.random.default_rng(4)
    n = 10_000
    size = np.exp(rng.uniform(0, 6, (n, 2))).astype(int)
    corner = rng.integers(-20_000, 20_000, (n, 2))
    boxes = [(k + 1, (*corner[k], 0, 1)) for k in range(n)] + [(k + 1, (*(corner[k] + size[k]), 0, 1)) for k in range(n)]
    df = frame(spark, boxes)
    parents, children = df.where("label % 2 = 0"), df
    near = run(df, spatial.containment_candidates_sql("{parents}", "{children}"), parents=parents, children=children)
    low, high = corner, corner + size
    want = set()
    for p in range(1, n, 2):
        inside = (low[p] <= low).all(1) & (high <= high[p]).all(1)
        want |= {(p + 1, int(k) + 1) for k in np.flatnonzero(inside)}
    found = spark.sql(spatial.containment_sql(), parents=parents, children=children).select("parent_label", "child_label").collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert near.count() < 20 * n < n * n / 200


def test_aggregates_of_children(spark):
    parents = spark.createDataFrame([("s", 0, 1, 5.0), ("s", 0, 2, 6.0)], "slide_id string, t long, label long, area double")
    children = spark.createDataFrame([("s", 0, 10, 1.0, None), ("s", 0, 11, 4.0, 2.0), ("s", 0, 12, 4.0, 5.0)], "slide_id string, t long, label long, area double, mean double")
    relations = spark.createDataFrame([("s", 0, 1, k) for k in (10, 11, 12)], "slide_id string, t long, parent_label long, child_label long")
    how = ["sum", ("nanmean", lambda v: np.nanmean(v)), ("spread", lambda c: F.max(c) - F.min(c)), "NUNIQUE"]
    rows = {r["parent_label"]: r.asDict() for r in NestedRois(how).featurize(relations, parents, children, ["area", "mean"]).collect()}
    assert {k: v for k, v in rows[1].items() if k.startswith("child_")} == {"child_area_sum": 9.0, "child_area_nanmean": 3.0, "child_area_spread": 3.0, "child_area_nunique": 2, "child_mean_sum": 7.0, "child_mean_nanmean": 3.5, "child_mean_spread": 3.0, "child_mean_nunique": 2}
    assert all(v == 0 for k, v in rows[2].items() if k.startswith("child_")) and rows[2]["area"] == 6.0
    alone = NestedRois({"area": lambda v: float(pd.Series(v).mode()[0])}).featurize(relations, parents, children, ["area"])
    assert alone.where("parent_label = 1").first()["child_area"] == 4.0


def test_level_sums_are_those_over_pairs(spark):
    rng = np.random.default_rng(5)
    pixels = [(label, (x, y, 0, int(v))) for label, top in ((1, 5), (2, 60_000), (3, 2)) for (y, x), v in np.ndenumerate(rng.integers(1, top, (14, 15)))]
    df = frame(spark, pixels)
    text = texture.ngtdm_sql(0)
    # without its pair sum the text joins levels with nothing of their own kind
    assert text.count("FROM l p JOIN l q") == 1 and "p.g < q.g" in text
    pairs = texture._level_pairs("duckdb")
    want = {r["label"]: tuple(r)[3:] for r in run(df, text.replace(texture._level_pairs("spark"), pairs)).collect()}
    found = {r["label"]: tuple(r)[3:] for r in run(df, text).collect()}
    assert {k: pytest.approx(v, rel=1e-9) for k, v in want.items()} == found
