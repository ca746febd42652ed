"""Feature queries against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from roiforge.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
QUICK = ("intensity_basic", "intensity_sparse", "morphology", "ellipse", "extrema", "euler_number", "moments_shape", "glrlm_3d_ave", "glszm_3d", "gldzm_3d", "ngldm_3d", "neighbours", "ngtdm", "box_counts", "hull", "erosion", "glszm_tiled", "blacklist", "slide_summary", "roi_metrics", "pairing", "surface_3d", "saturation")


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", QUICK)
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(map(repr, (tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())))
    theirs = con.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({ORACLE_SQL[name]})").fetchall()
    assert mine == sorted(map(repr, theirs))


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_whole_regions_are_nested(spark):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    region = "select l_suppkey as s, l_linenumber as l, min(l_partkey % {0}) as x0, max(l_partkey % {0}) as x1, min(l_orderkey % {0}) as y0, max(l_orderkey % {0}) as y1, count(distinct (l_partkey % {0}, l_orderkey % {0})) as n from lineitem group by all"
    pairs = con.execute(f"select p.s::varchar, p.l, c.l, c.n from ({region.format(32)}) p join ({region.format(12)}) c on p.s = c.s and p.x0 <= c.x0 and p.x1 >= c.x1 and p.y0 <= c.y0 and p.y1 >= c.y1").fetchall()
    found = {(r["slide_id"], r["parent_label"], r["child_label"]) for r in QUERIES["nested_relations"](spark, SF).collect()}
    assert found == {p[:3] for p in pairs} and {p[1] % 2 for p in pairs} == {0, 1} == {p[2] % 2 for p in pairs}
    wide = QUERIES["nested_pivot"](spark, SF)
    most = len([c for c in wide.columns if c.startswith("child")])
    assert sum(r[f"child{k}_area"] for r in wide.collect() for k in range(1, most + 1)) == sum(p[3] for p in pairs)
    test_same_as_duckdb(spark, "nested_relations")
    test_same_as_duckdb(spark, "nested_sum")
    test_same_as_duckdb(spark, "nested_mean")
    test_same_as_duckdb(spark, "nested_pivot")
