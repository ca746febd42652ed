"""Shape from sums over pixels: basic morphology, fitted ellipse, extrema, Euler number, box counts and geometric moments."""

from __future__ import annotations

from roiforge.functions.sqltext import K, div, finished, of, on, with_rows

MORPHOLOGY = (
    "AREA_PIXELS_COUNT", "AREA_UM2", "CENTROID_X", "CENTROID_Y", "WEIGHTED_CENTROID_Y", "WEIGHTED_CENTROID_X", "MASS_DISPLACEMENT", "COMPACTNESS", "BBOX_YMIN", "BBOX_XMIN", "BBOX_HEIGHT", "BBOX_WIDTH", "DIAMETER_EQUAL_AREA", "EXTENT", "ASPECT_RATIO",
)
ELLIPSE = ("MAJOR_AXIS_LENGTH", "MINOR_AXIS_LENGTH", "ELONGATION", "ECCENTRICITY", "ORIENTATION", "ROUNDNESS")
EXTREMA = tuple(f"EXTREMA_P{k}_{c}" for k in range(1, 9) for c in "XY")


def _pixels(weight: str = "cast(inten as double)") -> str:
    return f"px AS (SELECT {K}, cast(x as double) AS x, cast(y as double) AS y, {weight} AS i FROM {{pixels}})"


def morphology_sql(pixel_um: float = 1.0, dialect: str = "spark") -> str:
    """Basic morphology of each region; areas in square micrometres follow from the pixel's side."""
    inner = f"""WITH {_pixels()},
a AS (SELECT {K}, cast(count(*) as double) AS n, avg(x) AS cx, avg(y) AS cy, sum(x * i) / nullif(sum(i), 0e0) AS wx, sum(y * i) / nullif(sum(i), 0e0) AS wy, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px GROUP BY {K}),
d AS (SELECT {of("px")}, CASE WHEN count(*) > 2 THEN stddev_samp(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) ELSE 0e0 END AS spread FROM px JOIN a ON {on("px", "a")} GROUP BY {of("px")})
SELECT {of("a")}, n AS AREA_PIXELS_COUNT, n * {pixel_um * pixel_um}e0 AS AREA_UM2, cx AS CENTROID_X, cy AS CENTROID_Y, wy AS WEIGHTED_CENTROID_Y, wx AS WEIGHTED_CENTROID_X, sqrt(power(wx - cx, 2) + power(wy - cy, 2)) AS MASS_DISPLACEMENT,
  spread / n AS COMPACTNESS, y0 AS BBOX_YMIN, x0 AS BBOX_XMIN, y1 - y0 + 1 AS BBOX_HEIGHT, x1 - x0 + 1 AS BBOX_WIDTH, 2e0 * sqrt(n / pi()) AS DIAMETER_EQUAL_AREA, n / ((x1 - x0 + 1) * (y1 - y0 + 1)) AS EXTENT, (x1 - x0 + 1) / (y1 - y0 + 1) AS ASPECT_RATIO
FROM a JOIN d ON {on("a", "d")}"""
    return finished(inner, MORPHOLOGY, dialect)


def ellipse_sql(dialect: str = "spark") -> str:
    """The ellipse of equal second moments (a twelfth added for the pixel's own extent)."""
    inner = f"""WITH {_pixels()},
a AS (SELECT {K}, cast(count(*) as double) AS n, avg(x) AS cx, avg(y) AS cy FROM px GROUP BY {K}),
u AS (SELECT {of("px")}, max(n) AS n, avg((x - cx) * (x - cx)) + 1e0 / 12e0 AS xx, avg((y - cy) * (y - cy)) + 1e0 / 12e0 AS yy, avg((x - cx) * (y - cy)) AS xy FROM px JOIN a ON {on("px", "a")} GROUP BY {of("px")}),
c AS (SELECT {K}, n, xx, yy, CASE WHEN abs(xy) < 1e-9 THEN 0e0 ELSE xy END AS xy, sqrt((xx - yy) * (xx - yy) + 4e0 * xy * xy) AS q FROM u),
l AS (SELECT {K}, n, xx, yy, xy, q, 2e0 * sqrt(2e0) * sqrt(xx + yy + q) AS major, 2e0 * sqrt(2e0) * sqrt(greatest(xx + yy - q, 0e0)) AS minor FROM c)
SELECT {K}, major AS MAJOR_AXIS_LENGTH, minor AS MINOR_AXIS_LENGTH, minor / major AS ELONGATION, CASE WHEN q < 1e-9 THEN 0e0 ELSE sqrt(greatest(1e0 - minor * minor / (major * major), 0e0)) END AS ECCENTRICITY,
  CASE WHEN xy = 0 THEN CASE WHEN yy > xx + 1e-9 THEN 90e0 ELSE 0e0 END WHEN yy > xx + 1e-9 THEN degrees(atan((yy - xx + q) / (2e0 * xy))) ELSE degrees(atan(2e0 * xy / (xx - yy + q))) END AS ORIENTATION, 4e0 * n / (pi() * major * major) AS ROUNDNESS FROM l"""
    return finished(inner, ELLIPSE, dialect)


def extrema_sql(dialect: str = "spark") -> str:
    """Eight extremal points, clockwise from the left one of the top row."""
    inner = f"""WITH {_pixels()},
b AS (SELECT {K}, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px GROUP BY {K}),
e AS (SELECT {of("px")}, max(x0) AS x0, max(x1) AS x1, max(y0) AS y0, max(y1) AS y1, min(CASE WHEN y = y0 THEN x END) AS tl, max(CASE WHEN y = y0 THEN x END) AS tr, min(CASE WHEN x = x1 THEN y END) AS rt, max(CASE WHEN x = x1 THEN y END) AS rb,
  max(CASE WHEN y = y1 THEN x END) AS br, min(CASE WHEN y = y1 THEN x END) AS bl, max(CASE WHEN x = x0 THEN y END) AS lb, min(CASE WHEN x = x0 THEN y END) AS lt FROM px JOIN b ON {on("px", "b")} GROUP BY {of("px")})
SELECT {K}, tl AS EXTREMA_P1_X, y0 AS EXTREMA_P1_Y, tr AS EXTREMA_P2_X, y0 AS EXTREMA_P2_Y, x1 AS EXTREMA_P3_X, rt AS EXTREMA_P3_Y, x1 AS EXTREMA_P4_X, rb AS EXTREMA_P4_Y, br AS EXTREMA_P5_X, y1 AS EXTREMA_P5_Y,
  bl AS EXTREMA_P6_X, y1 AS EXTREMA_P6_Y, x0 AS EXTREMA_P7_X, lb AS EXTREMA_P7_Y, x0 AS EXTREMA_P8_X, lt AS EXTREMA_P8_Y FROM e"""
    return finished(inner, EXTREMA, dialect)


def euler_sql(dialect: str = "spark") -> str:
    """EULER_NUMBER from 2x2 quads: (quads of one pixel - quads of three - 2 * diagonal quads) / 4."""
    corners = with_rows("px", "p", [(0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8)], ("dx", "dy", "bit"), dialect)
    inner = f"""WITH px AS (SELECT DISTINCT {K}, x, y FROM {{pixels}}),
q AS (SELECT {K}, x - dx AS qx, y - dy AS qy, sum(bit) AS bits, count(*) AS k FROM {corners} GROUP BY {K}, x - dx, y - dy)
SELECT {K}, (sum(CASE WHEN k = 1 THEN 1e0 ELSE 0e0 END) - sum(CASE WHEN k = 3 THEN 1e0 ELSE 0e0 END) - 2e0 * sum(CASE WHEN k = 2 AND (bits = 9 OR bits = 6) THEN 1e0 ELSE 0e0 END)) / 4e0 AS EULER_NUMBER FROM q GROUP BY {K}"""
    return finished(inner, ["EULER_NUMBER"], dialect)


_SHIFTS = ((0, 0), (0, 1), (1, 0), (1, 1))


def box_counts_sql(dialect: str = "spark") -> str:
    """FRACT_DIM_BOXCOUNT: minus the slope of log(boxes) over log(side), sides from 2 to the power of two that the region's box is padded to.

    Grids begin at the box's corner. Up to a padded side of 32 a side's count is the least one over four grids, shifted by half a side.
    """
    sides = "explode(sequence(1, n))" if dialect == "spark" else "unnest(range(1, n + 1))"
    spread = with_rows("sided", "p", _SHIFTS, ("ox", "oy"), dialect)
    cell = lambda v: f"cast(floor(({v} + o{v} * s / 2e0) / s) as bigint)"
    inner = f"""WITH b AS (SELECT {K}, min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) + 1 AS side FROM {{pixels}} GROUP BY {K}),
px AS (SELECT {of("a")}, a.x - b.x0 AS x, a.y - b.y0 AS y, b.side, length(bin(cast(b.side - 1 as bigint))) AS n FROM {{pixels}} a JOIN b ON {on("a", "b")} WHERE b.side > 1),
sided AS (SELECT {K}, x, y, side, power(2e0, k) AS s FROM (SELECT {K}, x, y, side, {sides} AS k FROM px) AS e),
g AS (SELECT {K}, s, ox, oy, count(*) AS boxes FROM (SELECT DISTINCT {K}, s, ox, oy, {cell("x")} AS bx, {cell("y")} AS by_ FROM {spread} WHERE side <= 32 OR ox + oy = 0) AS d GROUP BY {K}, s, ox, oy),
l AS (SELECT {K}, ln(s) AS u, ln(min(boxes) * 1e0) AS v FROM g GROUP BY {K}, s),
f AS (SELECT {K}, -{div("count(*) * sum(u * v) - sum(u) * sum(v)", "count(*) * sum(u * u) - sum(u) * sum(u)")} AS FRACT_DIM_BOXCOUNT FROM l GROUP BY {K})
SELECT {of("b")}, FRACT_DIM_BOXCOUNT FROM b LEFT JOIN f ON {on("b", "f")}"""
    return finished(inner, ["FRACT_DIM_BOXCOUNT"], dialect)


# --- geometric moments -----------------------------------------------------------------------------------------------

_RAW = [(p, q) for p in range(4) for q in range(4) if (p, q) not in ((3, 1), (3, 2), (3, 3))]
_ALL = [(p, q) for p in range(4) for q in range(4)]
_SECOND = [(0, 2), (0, 3), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0)]
_WEIGHTED_RAW = [(p, q) for p in range(4) for q in range(4) if p + q <= 3]
#: Names of the raw, central, normalised raw, normalised central and Hu moments, and of the weighted ones.
SHAPE_NAMES = ("SPAT_MOMENT_", "CENTRAL_MOMENT_", "NORM_SPAT_MOMENT_", "NORM_CENTRAL_MOMENT_", "HU_M")
INTENSITY_NAMES = ("IMOM_RM_", "IMOM_CM_", "IMOM_NRM_", "IMOM_NCM_", "IMOM_HU")
WEIGHTED_SHAPE_NAMES = ("WEIGHTED_SPAT_MOMENT_", "WEIGHTED_CENTRAL_MOMENT_", None, "WT_NORM_CTR_MOM_", "WEIGHTED_HU_M")
WEIGHTED_INTENSITY_NAMES = ("IMOM_WRM_", "IMOM_WCM_", None, "IMOM_WNCM_", "IMOM_WHU")


def moment_names(names: tuple[str | None, ...], weighted: bool = False) -> list[str]:
    raw, central = (_WEIGHTED_RAW, _SECOND) if weighted else (_RAW, _ALL)
    listed = [f"{names[0]}{p}{q}" for p, q in raw] + [f"{names[1]}{p}{q}" for p, q in central]
    if names[2]:
        listed += [f"{names[2]}{p}{q}" for p, q in _ALL]
    return [*listed, *(f"{names[3]}{p}{q}" for p, q in _SECOND), *(f"{names[4]}{k}" for k in range(1, 8))]


def hu(n: dict[tuple[int, int], str]) -> list[str]:
    """The seven invariants of normalised central moments, as expressions."""
    n20, n02, n11, n30, n03, n12, n21 = (n[k] for k in ((2, 0), (0, 2), (1, 1), (3, 0), (0, 3), (1, 2), (2, 1)))
    a, b, c, d = f"({n30} + {n12})", f"({n21} + {n03})", f"({n30} - 3e0 * {n12})", f"(3e0 * {n21} - {n03})"
    aa, bb = f"{a} * {a}", f"{b} * {b}"
    return [
        f"{n20} + {n02}", f"power({n20} - {n02}, 2) + 4e0 * {n11} * {n11}", f"{c} * {c} + {d} * {d}", f"{aa} + {bb}", f"{c} * {a} * ({aa} - 3e0 * {bb}) + {d} * {b} * (3e0 * {aa} - {bb})",
        f"({n20} - {n02}) * ({aa} - {bb}) + 4e0 * {n11} * {a} * {b}", f"{d} * {a} * ({aa} - 3e0 * {bb}) - {c} * {b} * (3e0 * {aa} - {bb})",
    ]


def moments_sql(weight: str, names: tuple[str | None, ...], weighted: bool = False, dialect: str = "spark", pixels: str = "{pixels}") -> str:
    """Moments of sum(f * x^p * y^q), coordinates relative to the region's box; weight is the SQL of f (1e0, the intensity, ...)."""
    power = lambda v, k: " * ".join([v] * k) if k else ""
    term = lambda x, y, p, q: " * ".join(filter(None, ["f", power(x, p), power(y, q)]))
    raw = ", ".join(f"sum({term('x', 'y', p, q)}) AS r{p}{q}" for p, q in _ALL)
    central = ", ".join(f"sum({term('(x - xc)', '(y - yc)', p, q)}) AS c{p}{q}" for p, q in _ALL)
    norm = lambda kind, p, q: div(f"{kind}{p}{q}", f"power(r00, {(p + q) / 2 + 1}e0)")
    shown_raw, shown_central = (_WEIGHTED_RAW, _SECOND) if weighted else (_RAW, _ALL)
    out = [(f"r{p}{q}", f"{names[0]}{p}{q}") for p, q in shown_raw] + [(f"c{p}{q}", f"{names[1]}{p}{q}") for p, q in shown_central]
    if names[2]:
        out += [(norm("r", p, q), f"{names[2]}{p}{q}") for p, q in _ALL]
    out += [(f"n{p}{q}", f"{names[3]}{p}{q}") for p, q in _SECOND]
    out += [(h, f"{names[4]}{k + 1}") for k, h in enumerate(hu({k: f"n{k[0]}{k[1]}" for k in _SECOND}))]
    inner = f"""WITH box AS (SELECT {K}, min(x) AS x0, min(y) AS y0 FROM {pixels} GROUP BY {K}),
px AS (SELECT {of("a")}, cast(a.x - box.x0 as double) AS x, cast(a.y - box.y0 as double) AS y, {weight} AS f FROM {pixels} a JOIN box ON {on("a", "box")}),
r AS (SELECT {K}, {raw} FROM px GROUP BY {K}),
o AS (SELECT {K}, r10 / nullif(r00, 0e0) AS xc, r01 / nullif(r00, 0e0) AS yc FROM r),
c AS (SELECT {of("px")}, {central} FROM px JOIN o ON {on("px", "o")} GROUP BY {of("px")}),
n AS (SELECT {of("r")}, {", ".join(f"r{p}{q}" for p, q in _ALL)}, {", ".join(f"c{p}{q}" for p, q in _ALL)}, {", ".join(f"{norm('c', p, q)} AS n{p}{q}" for p, q in _SECOND)} FROM r JOIN c ON {on("r", "c")})
SELECT {K}, {", ".join(f"{e} AS {x}" for e, x in out)} FROM n"""
    return finished(inner, [x for _, x in out], dialect)
