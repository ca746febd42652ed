"""Image quality: focus and saturation as relations over the dense image; pixels that are no rows count as zero."""

from __future__ import annotations

from roiforge.functions.sqltext import K, finished, of, on, with_rows

FOCUS = ("FOCUS_SCORE", "LOCAL_FOCUS_SCORE")
SATURATION = ("MAX_SATURATION", "MIN_SATURATION")
_CROSS = ((0, 0, -4), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1))


def focus_sql(scale: int = 2, dialect: str = "spark") -> str:
    """Population variance of the Laplacian, zero-padded, over the region's box; and of tiles of 1/scale of its sides, each padded by itself, summed over scale^2.

    Each pixel adds its weighted intensity to itself and its four neighbours; places that nothing reaches are zero, so that
    sums, squares and the box's size give the variance. As the feature is defined, a tile counts if it begins more than a tile before the box's end: one tile where scale
    is 2 and both sides are even. A side shorter than scale has no tiles.
    """
    spread = with_rows("px", "p", _CROSS, ("dx", "dy", "wt"), dialect)
    inner = f"""WITH px AS (SELECT {K}, x, y, cast(inten as double) AS i FROM {{pixels}}),
box AS (SELECT {K}, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) * 1e0 AS n FROM px GROUP BY {K}),
lap AS (SELECT {K}, x + dx AS x, y + dy AS y, sum(i * wt) AS v FROM {spread} GROUP BY {K}, x + dx, y + dy),
g AS (SELECT {of("lap")}, sum(v * v) / max(n) - power(sum(v) / max(n), 2) AS score FROM lap JOIN box ON {on("lap", "box")} WHERE lap.x >= x0 AND lap.x <= x1 AND lap.y >= y0 AND lap.y <= y1 GROUP BY {of("lap")}),
q AS (SELECT {of("px")}, px.x - x0 AS x, px.y - y0 AS y, i, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h, floor((x1 - x0 + 1) / {scale}e0) AS tw, floor((y1 - y0 + 1) / {scale}e0) AS th FROM px JOIN box ON {on("px", "box")}),
placed AS (SELECT {K}, x, y, i, w, h, tw, th, floor(x / nullif(tw * 1e0, 0e0)) AS tx, floor(y / nullif(th * 1e0, 0e0)) AS ty FROM q),
tiled AS (SELECT {K}, tx, ty, tw, th, x - tx * tw AS u, y - ty * th AS v, i FROM placed WHERE (tx + 1) * tw < w AND (ty + 1) * th < h),
tl AS (SELECT {K}, tx, ty, tw, th, u + dx AS u, v + dy AS v, sum(i * wt) AS d FROM {with_rows("tiled", "p", _CROSS, ("dx", "dy", "wt"), dialect)} GROUP BY {K}, tx, ty, tw, th, u + dx, v + dy),
tile AS (SELECT {K}, tx, ty, max(tw * th) AS tn, sum(d) AS s1, sum(d * d) AS s2 FROM tl WHERE u >= 0 AND u < tw AND v >= 0 AND v < th GROUP BY {K}, tx, ty),
loc AS (SELECT {K}, sum(s2 / tn - power(s1 / tn, 2)) / {scale * scale}e0 AS score FROM tile GROUP BY {K})
SELECT {of("box")}, g.score AS FOCUS_SCORE, loc.score AS LOCAL_FOCUS_SCORE FROM box LEFT JOIN g ON {on("box", "g")} LEFT JOIN loc ON {on("box", "loc")}"""
    return finished(inner, FOCUS, dialect)


def saturation_sql(dialect: str = "spark") -> str:
    """Shares of the box's pixels at its maximum and at its minimum, zeros outside the region included; an image of one intensity has no minimum share."""
    inner = f"""WITH v AS (SELECT {K}, cast(inten as double) AS i, count(*) AS c, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {{pixels}} GROUP BY {K}, cast(inten as double)),
b AS (SELECT {K}, min(i) AS lo, max(i) AS hi, (max(x1) - min(x0) + 1) * (max(y1) - min(y0) + 1) AS n, (max(x1) - min(x0) + 1) * (max(y1) - min(y0) + 1) - sum(c) AS gap FROM v GROUP BY {K}),
r AS (SELECT {K}, n, gap, CASE WHEN gap > 0 AND lo > 0 THEN 0e0 ELSE lo END AS mn, CASE WHEN gap > 0 AND hi < 0 THEN 0e0 ELSE hi END AS mx FROM b)
SELECT {of("r")}, (coalesce(sum(CASE WHEN i = mx THEN c END), 0) + max(CASE WHEN mx = 0 THEN gap ELSE 0 END)) * 1e0 / max(n) AS MAX_SATURATION,
(coalesce(sum(CASE WHEN i = mn AND i <> mx THEN c END), 0) + max(CASE WHEN mn = 0 AND mx <> 0 THEN gap ELSE 0 END)) * 1e0 / max(n) AS MIN_SATURATION FROM v JOIN r ON {on("v", "r")} GROUP BY {of("r")}"""
    return finished(inner, SATURATION, dialect)
