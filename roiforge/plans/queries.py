"""Feature queries over the driver's tables, each with the SQL that checks it on another engine."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roiforge.functions.sqltext import KEYS, rounded, run
from roiforge.operators import firstorder, geometry, imagequality, outline, output, shape, spatial, texture, volume
from roiforge.operators.zones import zone_features
from roiforge.sources.adapters import ADAPTERS, BOUNDED, pixels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def family(name: str, adapter: str, text: Callable[..., str], names: Sequence[str], keys: Sequence[str] = KEYS, slides: bool = False) -> None:
    """Registers a relational family: text(dialect=...) over an adapter's pixels. slides: its regions meet others of their slide."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(pixels(spark, sf_dir, adapter, slides), rounded(text(dialect="spark"), names, "spark", keys))

    QUERIES[name] = query
    ORACLE_SQL[name] = rounded(text(dialect="duckdb"), names, "duckdb", keys).replace("{pixels}", f"({ADAPTERS[adapter]('duckdb')})")


def zoned(name: str, adapter: str, kind: str, depth: int, three_d: bool = False) -> None:
    """Registers a zone family: labelled by the component pass, checked by recursion."""
    names = texture.names(kind, three_d)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = zone_features(pixels(spark, sf_dir, adapter), kind, depth, three_d)
        return run(found, rounded("SELECT * FROM {pixels}", names, "spark"))

    QUERIES[name] = query
    ORACLE_SQL[name] = rounded(texture.zone_check_sql(kind, depth, three_d, "duckdb"), names, "duckdb").replace("{pixels}", f"({ADAPTERS[adapter]('duckdb')})")


ANGLED = (*KEYS, "a")

family("intensity_basic", "dense", firstorder.basic_sql, ["AREA_PIXELS_COUNT", "MIN", "MAX", "INTEGRATED_INTENSITY", "MEAN"])
family("intensity_full", "quarters", firstorder.intensity_sql, firstorder.INTENSITY)
family("intensity_sparse", "sparse", firstorder.intensity_sql, firstorder.INTENSITY)
family("intensity_temporal", "temporal", firstorder.intensity_sql, firstorder.INTENSITY)
family("intensity_3d", "volume", partial(firstorder.intensity_sql, prefix="3"), [f"3{n}" for n in firstorder.INTENSITY])
family("histogram", "dense", firstorder.histogram_sql, [f"HISTOGRAM_{k}" for k in range(16)])
family("ih", "dense", firstorder.ih_sql, firstorder.IH)
family("morphology", "sparse", shape.morphology_sql, shape.MORPHOLOGY)
family("ellipse", "sparse", shape.ellipse_sql, shape.ELLIPSE)
family("extrema", "sparse", shape.extrema_sql, shape.EXTREMA)
family("euler_number", "compact", shape.euler_sql, ["EULER_NUMBER"])
family("box_counts", "sparse", shape.box_counts_sql, ["FRACT_DIM_BOXCOUNT"])
family("moments_shape", "quarters", partial(shape.moments_sql, "1e0", shape.SHAPE_NAMES), shape.moment_names(shape.SHAPE_NAMES))
family("moments_intensity", "dense", partial(shape.moments_sql, "cast(a.inten as double)", shape.INTENSITY_NAMES), shape.moment_names(shape.INTENSITY_NAMES))
family("glcm", "dense", partial(texture.glcm_sql, 16), texture.names("GLCM"), ANGLED)
family("glcm_ave", "quarters", partial(texture.glcm_sql, 8, averaged=True), texture.names("GLCM", averaged=True))
family("glcm_radiomics_ave", "compact", partial(texture.glcm_sql, -10, averaged=True), texture.names("GLCM", averaged=True))
family("gldm", "dense", partial(texture.gldm_sql, 8), texture.names("GLDM"))
family("ngldm", "dense", partial(texture.ngldm_sql, 8), texture.names("NGLDM"))
family("ngtdm", "dense", partial(texture.ngtdm_sql, 16), texture.names("NGTDM"))
family("glrlm", "dense", partial(texture.glrlm_sql, 8), texture.names("GLRLM"), ANGLED)
family("glrlm_ave", "compact", partial(texture.glrlm_sql, 8, averaged=True), texture.names("GLRLM", averaged=True))
zoned("glszm", "dense", "GLSZM", 8)
zoned("gldzm", "dense", "GLDZM", 8)
family("glcm_3d", "volume", partial(texture.glcm_sql, 8, three_d=True), texture.names("GLCM", True), ANGLED)
family("glcm_3d_ave", "volume", partial(texture.glcm_sql, 8, three_d=True, averaged=True), texture.names("GLCM", True, True))
family("gldm_3d", "volume", partial(texture.gldm_sql, 8, three_d=True), texture.names("GLDM", True))
family("ngldm_3d", "volume", partial(texture.ngldm3_sql, 4), texture.names("NGLDM", True))
family("ngtdm_3d", "volume", partial(texture.ngtdm_sql, 16, three_d=True), texture.names("NGTDM", True))
family("glrlm_3d", "volume", partial(texture.glrlm_sql, 8, three_d=True), texture.names("GLRLM", True), ANGLED)
family("glrlm_3d_ave", "volume", partial(texture.glrlm_sql, 8, three_d=True, averaged=True), texture.names("GLRLM", True, True))
zoned("glszm_3d", "volume", "GLSZM", 8, True)
zoned("gldzm_3d", "volume", "GLDZM", 8, True)

def tiled(name: str, adapter: str, kind: str, depth: int, tile: int, three_d: bool = False) -> None:
    """Registers a zone family labelled by tiles of a side, checked by the same recursion."""
    names = texture.names(kind, three_d)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = zone_features(pixels(spark, sf_dir, adapter), kind, depth, three_d, tile=tile)
        return run(found, rounded("SELECT * FROM {pixels}", names, "spark"))

    QUERIES[name] = query
    ORACLE_SQL[name] = rounded(texture.zone_check_sql(kind, depth, three_d, "duckdb"), names, "duckdb").replace("{pixels}", f"({ADAPTERS[adapter]('duckdb')})")


tiled("glszm_tiled", "dense", "GLSZM", 8, 4)
tiled("gldzm_tiled", "dense", "GLDZM", 8, 4)

# --- regions against regions, image quality, volumes ------------------------------------------------------------------

family("neighbours", "compact", spatial.neighbours_sql, spatial.NEIGHBOURS, slides=True)
family("focus", "dense", imagequality.focus_sql, imagequality.FOCUS)
family("saturation", "dense", imagequality.saturation_sql, imagequality.SATURATION)
family("surface_3d", "volume", volume.surface_sql, volume.SURFACE)


def _side(dialect: str, which: str, adapter: str = "sparse") -> str:
    return which.replace("{pixels}", f"({ADAPTERS[adapter](dialect)}) AS adapted")


def _children_joined(relations: DataFrame, parents: DataFrame, children: DataFrame, how: str, least_children: int = 0) -> DataFrame:
    size = lambda df, name: df.groupBy(*KEYS).agg(F.count(F.lit(1)).cast("double").alias(name))
    return spatial.aggregate_children(relations, size(parents, "area"), size(children, "area"), how, ["area"], least_children)


_SIZES = "SELECT slide_id, t, label, cast(count(*) as double) AS area FROM ({}) AS q GROUP BY slide_id, t, label"


def _nested_pixels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions of all line items twice: on the grid of side 32 as parents, folded to side 12 as children."""
    parents, children = pixels(spark, sf_dir, "sparse"), pixels(spark, sf_dir, "compact")
    return spark.sql(spatial.containment_sql(), parents=parents, children=children), parents, children


def nested_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested_pixels(spark, sf_dir)[0]


def _nested(how: str) -> Query:
    return lambda spark, sf_dir: _children_joined(*_nested_pixels(spark, sf_dir), how)


_EVERY = "SELECT * FROM {pixels}"
_NESTED_SQL = spatial.containment_sql(f"({_side('duckdb', _EVERY)}) AS ps", f"({_side('duckdb', _EVERY, 'compact')}) AS cs", "duckdb")


def _nested_sql(aggregate: str) -> str:
    child = f"({_SIZES.format(_side('duckdb', _EVERY, 'compact'))})"
    ranked = f"SELECT r.slide_id, r.t, r.parent_label, area, row_number() OVER (PARTITION BY r.slide_id, r.t, r.parent_label ORDER BY r.child_label) AS k FROM ({_NESTED_SQL}) AS r JOIN {child} AS c ON r.slide_id = c.slide_id AND r.t = c.t AND r.child_label = c.label"
    joined = f"SELECT slide_id, t, parent_label, {aggregate} FROM ({ranked}) AS k GROUP BY slide_id, t, parent_label"
    shown = ", ".join(f"coalesce(w.{n}, 0e0) AS {n}" for n in (a.split(" AS ")[-1] for a in aggregate.split(", ")))
    return f"SELECT p.slide_id, p.t, p.label AS parent_label, p.area, {shown} FROM ({_SIZES.format(_side('duckdb', _EVERY))}) AS p LEFT JOIN ({joined}) AS w ON p.slide_id = w.slide_id AND p.t = w.t AND p.label = w.parent_label"


#: Line numbers are 1 to 7, so no family is larger.
_MOST_CHILDREN = 7


def nested_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _children_joined(*_nested_pixels(spark, sf_dir), "NONE", _MOST_CHILDREN)


QUERIES |= {"nested_relations": nested_relations, "nested_sum": _nested("SUM"), "nested_mean": _nested("MEAN"), "nested_pivot": nested_pivot}
ORACLE_SQL |= {"nested_relations": _NESTED_SQL, "nested_sum": _nested_sql("sum(area) AS child_area"), "nested_mean": _nested_sql("avg(area) AS child_area"), "nested_pivot": _nested_sql(", ".join(f"max(CASE WHEN k = {k} THEN area END) AS child{k}_area" for k in range(1, _MOST_CHILDREN + 1)))}


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of regions that a list by file leaves."""
    kept = spatial.without_blacklisted(pixels(spark, sf_dir, "sparse"), "1:1,2,3;7:4")
    return kept.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("area"))


def slide_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prescan: extrema of intensity and size, and the number of regions, of each slide."""
    roi = pixels(spark, sf_dir, "sparse").groupBy(*KEYS).agg(F.min("inten").alias("lo"), F.max("inten").alias("hi"), F.count(F.lit(1)).alias("area"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    return roi.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n_rois"), F.min("lo").alias("min_inten"), F.max("hi").alias("max_inten"), F.max("area").alias("max_area"), F.max("w").alias("max_width"), F.max("h").alias("max_height"))


def slide_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a slide, label -1: means over its regions."""
    return output.slide_means(run(pixels(spark, sf_dir, "sparse"), firstorder.basic_sql()), ["AREA_PIXELS_COUNT", "MEAN"]).select(*KEYS, *(F.round(F.col(c), 6).alias(c) for c in ("AREA_PIXELS_COUNT", "MEAN")))


def roi_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, box, extremes and size class of each region; large from 200 cells on."""
    return output.roi_metrics(pixels(spark, sf_dir, "sparse"), 200)


QUERIES |= {"blacklist": blacklist, "slide_summary": slide_summary, "slide_means": slide_means, "roi_metrics": roi_metrics}
_SPARSE = f"({ADAPTERS['sparse']('duckdb')})"
_ROI = f"SELECT slide_id, t, label, min(inten) AS lo, max(inten) AS hi, count(*) AS area, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, avg(inten * 1e0) AS mean FROM {_SPARSE} AS p GROUP BY slide_id, t, label"
ORACLE_SQL |= {
    "blacklist": f"SELECT slide_id, t, label, count(*) AS area FROM {_SPARSE} AS p WHERE NOT (slide_id = '1' AND label IN (1, 2, 3)) AND NOT (slide_id = '7' AND label = 4) GROUP BY slide_id, t, label",
    "slide_summary": f"SELECT slide_id, count(*) AS n_rois, min(lo) AS min_inten, max(hi) AS max_inten, max(area) AS max_area, max(w) AS max_width, max(h) AS max_height FROM ({_ROI}) AS r GROUP BY slide_id",
    "roi_metrics": f"""SELECT slide_id, t, label, area, minx, miny, maxx, maxy, maxx - minx + 1 AS width, maxy - miny + 1 AS height, min_intens, max_intens, (maxx - minx + 1) * (maxy - miny + 1) * 8 AS size_bytes,
CASE WHEN (maxx - minx + 1) * (maxy - miny + 1) > 200 THEN 'OVERSIZE' ELSE 'TRIVIAL' END AS size_class FROM (SELECT slide_id, t, label, count(*) AS area, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, min(inten) AS min_intens, max(inten) AS max_intens FROM {_SPARSE} AS p GROUP BY slide_id, t, label) AS r""",
    "slide_means": f"SELECT slide_id, t, cast(-1 as bigint) AS label, round(avg(area), 6) AS AREA_PIXELS_COUNT, round(avg(mean), 6) AS MEAN FROM ({_ROI}) AS r GROUP BY slide_id, t",
}


def pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the base name of their address, as files of two folders are paired: names that occur once on either side."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", r"/([0-9]+)(?:[?#].*)?$", 1).alias("base"), "page_id").where("base <> ''")
    once = pages.groupBy("base").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2")
    side = lambda c: once.select(F.concat(F.lit(f"/{c}/"), F.col("base"), F.lit(".tif")).alias("path"))
    return spatial.pair_by_name(side("a"), side("b"), "[0-9]+\\.tif").select("name", "intensity_image", "mask_image")


QUERIES["pairing"] = pairing
ORACLE_SQL["pairing"] = """SELECT base || '.tif' AS name, '/a/' || base || '.tif' AS intensity_image, '/b/' || base || '.tif' AS mask_image
FROM (SELECT regexp_extract(url, '/([0-9]+)(?:[?#].*)?$', 1) AS base FROM pages) AS p WHERE base <> '' GROUP BY base HAVING count(*) = 2"""


def geometric(name: str, adapter: str, groups: Sequence[str]) -> None:
    """Registers groups of the grouped pass; SQL can't express them."""
    QUERIES[name] = lambda spark, sf_dir: outline.geometry(pixels(spark, sf_dir, adapter), groups, cells=BOUNDED[adapter])


_COMPACT = f"({ADAPTERS['compact']('duckdb')})"


def hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hull area and solidity from rows' ends and partial hulls, as large regions take them."""
    found = outline.hull_features(pixels(spark, sf_dir, "compact"), ["hull"])
    return run(found, rounded("SELECT * FROM {pixels}", geometry.GROUPS["hull"], "spark"))


def erosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outline.geometry(pixels(spark, sf_dir, "compact"), ["erosion"], cells=BOUNDED["compact"])
    return run(found, rounded("SELECT * FROM {pixels}", geometry.GROUPS["erosion"], "spark"))


QUERIES |= {"hull": hull, "erosion": erosion}
ORACLE_SQL |= {
    # an ordered pair of places is an edge if none lies to its right and none beyond it on its line; area by the shoelace formula and lattice points
    "hull": rounded(f"""WITH p AS (SELECT DISTINCT slide_id, t, label, x, y FROM {_COMPACT} AS q),
n AS (SELECT slide_id, t, label, count(*) AS n FROM p GROUP BY ALL),
o AS (SELECT slide_id, t, label, list((x, y)) AS all_ FROM p GROUP BY ALL),
e AS (SELECT a.slide_id, a.t, a.label, a.x AS x, a.y AS y, b.x AS u, b.y AS v FROM p a JOIN p b ON a.slide_id = b.slide_id AND a.t = b.t AND a.label = b.label AND (a.x <> b.x OR a.y <> b.y)),
edge AS (SELECT slide_id, t, label, x, y, u, v FROM e JOIN o USING (slide_id, t, label)
  WHERE len(list_filter(all_, lambda c: (u - x) * (c[2] - y) - (v - y) * (c[1] - x) < 0 OR ((u - x) * (c[2] - y) - (v - y) * (c[1] - x) = 0 AND ((c[1] - x) * (c[1] - u) + (c[2] - y) * (c[2] - v) > 0)))) = 0),
h AS (SELECT slide_id, t, label, count(*) AS k, abs(sum(x * v - u * y)) / 2e0 + sum(gcd(abs(u - x), abs(v - y))) / 2e0 + 1 AS area FROM edge GROUP BY ALL),
f AS (SELECT slide_id, t, label, n, CASE WHEN k >= 3 THEN area ELSE n * 1e0 END AS area FROM n LEFT JOIN h USING (slide_id, t, label))
SELECT slide_id, t, label, area AS CONVEX_HULL_AREA, n / area AS SOLIDITY FROM f""", geometry.GROUPS["hull"], "duckdb"),
    # a pixel survives one erosion less than its city-block distance to the nearest place outside
    "erosion": rounded(f"""WITH p AS (SELECT DISTINCT slide_id, t, label, x, y FROM {_COMPACT} AS q),
box AS (SELECT slide_id, t, label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY ALL),
rows_ AS (SELECT slide_id, t, label, x0, x1, unnest(range(y0 - 1, y1 + 2)) AS y FROM box),
cells AS (SELECT slide_id, t, label, unnest(range(x0 - 1, x1 + 2)) AS x, y FROM rows_),
outside AS (SELECT cells.* FROM cells ANTI JOIN p USING (slide_id, t, label, x, y)),
d AS (SELECT p.slide_id, p.t, p.label, p.x, p.y, min(abs(p.x - o.x) + abs(p.y - o.y)) AS d FROM p JOIN outside o ON p.slide_id = o.slide_id AND p.t = o.t AND p.label = o.label GROUP BY ALL)
SELECT slide_id, t, label, max(d) - 1e0 AS EROSIONS_2_VANISH, 0e0 AS EROSIONS_2_VANISH_COMPLEMENT FROM d GROUP BY slide_id, t, label""", geometry.GROUPS["erosion"], "duckdb"),
}

geometric("contour", "compact", ["contour", "hull", "geodetic", "circles", "radius"])
geometric("erosion_fractal", "sparse", ["erosion", "fractal"])
geometric("caliper", "sparse", ["caliper"])
geometric("chords", "compact", ["chords"])
geometric("radial", "compact", ["radial"])
geometric("gabor", "dense", ["gabor"])
geometric("zernike", "dense", ["zernike"])
geometric("weighted_moments", "compact", ["weighted_moments", "weighted_intensity_moments"])
geometric("sharpness_spectrum", "dense", ["sharpness", "spectrum"])
QUERIES["shape_3d"] = lambda spark, sf_dir: volume.shape3(pixels(spark, sf_dir, "volume"))


def polygonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir, "compact", slides=True)
    return geometry.polygonality(run(px, spatial.neighbours_sql()), outline.geometry(px, ["contour", "hull", "caliper"], cells=BOUNDED["compact"]))


QUERIES["polygonality"] = polygonality
