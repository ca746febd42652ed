"""What moves, and how much a task holds, as tables grow."""

from pathlib import Path

import numpy as np
import pytest

from roiforge.operators import geometry, outline, zones
from roiforge.plans.queries import QUERIES
from roiforge.sources import adapters

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def _rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_few_links_take_one_pass(spark):
    rng = np.random.default_rng(3)
    links = [(f"s{k % 5}", 0, k % 3, *sorted(map(int, rng.choice(40, 2, replace=False)))) for k in range(300)]
    df = spark.createDataFrame(links, "slide_id string, t bigint, label bigint, a bigint, b bigint").distinct()
    rounds = _rows(zones.merged_by_rounds(df))
    assert rounds and _rows(zones.merged_parts(df)) == rounds and _rows(zones.merged_parts(df, few=16)) == rounds


@needs_tables
@pytest.mark.parametrize("name", ["glszm_tiled", "gldzm_tiled"])
def test_parts_are_not_broadcast(spark, name, capsys):
    QUERIES[name](spark, SF).explain()
    joins = [line for line in capsys.readouterr().out.splitlines() if "Join" in line and "part#" in line]
    assert joins and not any("Broadcast" in line for line in joins)


@needs_tables
@pytest.mark.parametrize("name", ["glrlm", "glrlm_ave", "glcm", "glcm_radiomics_ave", "gldm", "euler_number", "box_counts", "contour", "radial", "chords", "caliper", "weighted_moments", "erosion", "erosion_fractal"])
def test_rows_move_once(spark, name, capsys):
    QUERIES[name](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


@needs_tables
def test_regions_of_a_slide_move_once(spark, capsys):
    QUERIES["neighbours"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan and "Join" not in plan


@needs_tables
@pytest.mark.parametrize("adapter", ["quarters", "sparse"])
def test_tasks_grow_in_number(spark, adapter, monkeypatch):
    few = adapters.pixels(spark, SF, adapter)
    monkeypatch.setattr(adapters, "TASK_ROWS", 500)
    many = adapters.pixels(spark, SF, adapter)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count() if adapter == "sparse" else 64 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert many.rdd.getNumPartitions() == -(-rows // 500) > few.rdd.getNumPartitions()
    assert _rows(many) == _rows(few)


def test_small_regions_as_rows(spark):
    rng = np.random.default_rng(5)
    pixels = [("s", 0, k, int(x), int(y), 0, int(v)) for k in range(40) for x, y, v in {(a, b): (a, b, v) for a, b, v in rng.integers(0, 14, (1 + 3 * k, 3)) - (3, 0, 0)}.values()]
    df = spark.createDataFrame(pixels, "slide_id string, t bigint, label bigint, x bigint, y bigint, z bigint, inten bigint")
    groups = [k for k in geometry.GROUPS if k not in ("gabor", "zernike", "sharpness", "spectrum")]
    assert _rows(outline.geometry(df, groups, cells=196)) == _rows(geometry.whole_regions(df, groups))


def test_chords_of_many_places_by_few_angles():
    yy, xx = np.mgrid[0:240, 0:260]
    inside = ((xx - 130) / 125) ** 2 + ((yy - 120) / 110) ** 2 < 1
    region = geometry.Region(xx[inside], yy[inside], np.ones(int(inside.sum()), dtype=np.int64))
    assert region.n * 20 > 500_000
    whole = geometry.chord_features(region)
    turned, owner = [], []
    p, about = np.stack([region.x, region.y], axis=1).astype(float), np.array([region.x0 + (region.w - 1) / 2, region.y0 + (region.h - 1) / 2])
    for k in range(20):
        q = np.trunc(geometry._rotated(p, 9.0 * k, about).astype(np.float32)).astype(np.int64)[None]
        runs, _ = geometry._column_runs(q[:, :, 0], q[:, :, 1], q[:, :, 1].max(1))
        turned.append(runs)
        owner.append(runs.max())
    every = np.concatenate(turned)
    assert whole[0] == max(owner) and whole[2] == min(owner) and whole[8] == every.max() and whole[12] == np.median(every) and whole[13] == every.mean()
