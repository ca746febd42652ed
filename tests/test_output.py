"""Files that tasks write themselves: a CSV for each pair of images, metrics of regions, Arrow IPC."""

import csv

import numpy as np
import pyarrow as pa

from roiforge.__main__ import main
from roiforge.operators import output
from tests.test_sources import folder


def read(path):
    with open(path, newline="") as f:
        return list(csv.DictReader(f))


def images(tmp_path):
    image, mask = np.arange(1, 37, dtype=np.uint16).reshape(6, 6), np.zeros((6, 6), np.uint8)
    mask[:2, :3], mask[3:, 4:] = 2, 1
    return folder(tmp_path, "int", a=image, b_c1=image + 100, c=image), folder(tmp_path, "seg", a=mask, b_c1=mask, c=0 * mask)


def test_a_csv_for_each_pair_and_metrics_of_its_regions(spark, tmp_path):
    """Pairs without regions have no file; a second run replaces the first one's files."""
    ints, segs = images(tmp_path)
    out = tmp_path / "out"
    for _ in range(2):
        main([f"--intDir={ints}", f"--segDir={segs}", f"--outDir={out}", "--outputType=separatecsv", "--features=AREA_PIXELS_COUNT,MAX", "--roiMetrics"])
        assert sorted(p.name for p in out.iterdir() if not p.name.endswith(".crc")) == ["_INT_a_SEG_a.csv", "_INT_b_c1_SEG_b_c1.csv", "roi_metrics_a.csv", "roi_metrics_b_c1.csv"]
    rows = read(out / "_INT_b_c1_SEG_b_c1.csv")
    assert [(r["intensity_image"], r["mask_image"], r["ROI_label"], float(r["AREA_PIXELS_COUNT"]), float(r["MAX"])) for r in rows] == [("b_c1.tif", "b_c1.tif", "1", 6, 136), ("b_c1.tif", "b_c1.tif", "2", 6, 109)]
    assert list(rows[0])[:4] == ["intensity_image", "mask_image", "ROI_label", "t_index"] and set(list(rows[0])[4:]) == {"AREA_PIXELS_COUNT", "MAX"}
    row = read(out / "roi_metrics_a.csv")[1]
    assert {k: row[k] for k in ("label", "area", "width", "height", "min_intens", "max_intens", "size_bytes", "size_class")} == {"label": "2", "area": "6", "width": "3", "height": "2", "min_intens": "1", "max_intens": "9", "size_bytes": "48", "size_class": "TRIVIAL"}


def test_files_of_many_batches(spark, tmp_path):
    """Rows of a name that span batches are one file, and names that share a batch are several."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(100).selectExpr("id", "concat('f', id % 3, '.csv') as file_name").repartition(2, "file_name").sortWithinPartitions("file_name", "id")
        assert output.write_files(rows, str(tmp_path / "x")) == ["f0.csv", "f1.csv", "f2.csv"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [[int(r["id"]) for r in read(tmp_path / "x" / f"f{k}.csv")] for k in range(3)] == [list(range(k, 100, 3)) for k in range(3)]
    assert output.write_files(rows.limit(0), str(tmp_path / "x")) == []


def test_arrow_files_have_rows_in_order_and_may_be_empty(spark, tmp_path):
    rows = spark.range(1000, numPartitions=5).selectExpr("concat('s', id % 10) as slide_id", "0L as t", "id as label", "if(id % 9 = 0, double('nan'), id * 1.0d) as MEAN")
    output.write(rows, str(tmp_path / "all.arrow"), noval=-1.0)
    output.write(rows.limit(0), str(tmp_path / "none.arrow"))
    found, none = (pa.ipc.open_file(str(tmp_path / f"{n}.arrow")).read_all() for n in ("all", "none"))
    keys = list(zip(found["slide_id"].to_pylist(), found["label"].to_pylist(), strict=True))
    assert keys == sorted(keys) and len(keys) == 1000 and found["MEAN"].to_pylist().count(-1.0) == 112
    assert none.num_rows == 0 and none.schema.names == found.schema.names


def test_metrics_of_large_regions(spark):
    rows = spark.range(10).selectExpr("'s' as slide_id", "0L as t", "1L as label", "id * 10 as x", "id as y", "0L as z", "id as inten")
    found = output.roi_metrics(rows, large=900).first().asDict()
    assert (found["area"], found["width"], found["height"], found["size_class"]) == (10, 91, 10, "OVERSIZE")
