"""First-order intensity statistics and intensity histograms.

All of them come from one compact relation, the count of each intensity in a region: it is pre-aggregated before the
shuffle, so that a region of any size costs at most as many rows as it has intensities.
"""

from __future__ import annotations

from roiforge.functions.binning import folded
from roiforge.functions.sqltext import K, div, finished, of, on

INTENSITY = (
    "COV", "COVERED_IMAGE_INTENSITY_RANGE", "ENERGY", "ENTROPY", "EXCESS_KURTOSIS", "HYPERFLATNESS", "HYPERSKEWNESS", "INTEGRATED_INTENSITY", "INTERQUARTILE_RANGE", "KURTOSIS", "MAX", "MEAN", "MEAN_ABSOLUTE_DEVIATION",
    "MEDIAN", "MEDIAN_ABSOLUTE_DEVIATION", "MIN", "MODE", "P01", "P10", "P25", "P75", "P90", "P99", "QCOD", "RANGE", "ROBUST_MEAN", "ROBUST_MEAN_ABSOLUTE_DEVIATION", "ROOT_MEAN_SQUARED", "SKEWNESS", "STANDARD_DEVIATION",
    "STANDARD_DEVIATION_BIASED", "STANDARD_ERROR", "VARIANCE", "VARIANCE_BIASED", "UNIFORMITY", "UNIFORMITY_PIU",
)
QUANTILES = {"P01": "0.01e0", "P10": "0.1e0", "P25": "0.25e0", "P75": "0.75e0", "P90": "0.9e0", "P99": "0.99e0"}

_IH = (
    "MEAN", "VARIANCE", "SKEWNESS", "EXCESS_KURTOSIS", "MEDIAN", "MINIMUM", "P10", "P90", "MAXIMUM", "MODE", "INTERQUANTILE_RANGE", "RANGE", "MEAN_ABSOLUTE_DEVIATION", "ROBUST_MEAN_ABSOLUTE_DEVIATION",
    "MEDIAN_ABSOLUTE_DEVIATION", "COEFFICIENT_OF_VARIATION", "QUANTILE_COEFFICIENT_OF_DISPERSION", "ENTROPY", "UNIFORMITY", "ROBUST_MEAN",
)
IH = (*(f"IH_{n}_VAL" for n in _IH), *(f"IH_{n}_IDX" for n in _IH), "IH_MAX_GRADIENT", "IH_MAX_GRADIENT_IDX", "IH_MIN_GRADIENT", "IH_MIN_GRADIENT_IDX", "IH_NUM_BINS", "IH_BIN_SIZE")


def counts(pixels: str = "{pixels}") -> str:
    """WITH clauses h (count c of intensity i in a region) and r (n, sums and extrema)."""
    return f"""h AS (SELECT {K}, cast(inten as double) AS i, cast(count(*) as double) AS c FROM {pixels} GROUP BY {K}, cast(inten as double)),
r AS (SELECT {K}, sum(c) AS n, min(i) AS mn, max(i) AS mx, sum(c * i) AS s1, sum(c * i * i) AS s2 FROM h GROUP BY {K})"""


def intensity_sql(depth: int = 64, prefix: str = "", dialect: str = "spark") -> str:
    """The 36 scalar first-order features of each region."""
    quantiles = ", ".join(f"max(CASE WHEN below <= {q} * n AND {q} * n <= below + b THEN ({q} * n - below) * bw / b + mn + bw * bin END) AS {name.lower()}" for name, q in QUANTILES.items())
    inner = f"""WITH {counts()},
slide AS (SELECT slide_id, min(mn) AS smn, max(mx) AS smx FROM r GROUP BY slide_id),
m AS (SELECT {of("h")}, sum(c * power(i - s1 / n, 2)) AS m2, sum(c * power(i - s1 / n, 3)) AS m3, sum(c * power(i - s1 / n, 4)) AS m4, sum(c * power(i - s1 / n, 5)) AS m5, sum(c * power(i - s1 / n, 6)) AS m6, sum(c * abs(i - s1 / n)) AS ad
  FROM h JOIN r ON {on("h", "r")} GROUP BY {of("h")}),
cum AS (SELECT {K}, i, c, sum(c) OVER (PARTITION BY {K} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(c) OVER (PARTITION BY {K}) AS n, max(c) OVER (PARTITION BY {K}) AS most FROM h),
med AS (SELECT {K}, (min(CASE WHEN 2 * upto >= n THEN i END) + min(CASE WHEN 2 * upto > n THEN i END)) / 2e0 AS med, min(CASE WHEN c = most THEN i END) AS mode_ FROM cum GROUP BY {K}),
md AS (SELECT {of("h")}, sum(c * abs(i - med)) AS mad FROM h JOIN med ON {on("h", "med")} GROUP BY {of("h")}),
cent AS (SELECT {of("h")}, (mx - mn) / 100e0 AS bw, mn, n, least(coalesce(floor((i - mn) / nullif((mx - mn) / 100e0, 0e0)), 0e0), 99e0) AS bin, c FROM h JOIN r ON {on("h", "r")}),
bins AS (SELECT {K}, bin, sum(c) AS b, min(bw) AS bw, min(mn) AS mn, min(n) AS n FROM cent GROUP BY {K}, bin),
run AS (SELECT {K}, bin, b, bw, mn, n, sum(b) OVER (PARTITION BY {K} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - b AS below FROM bins),
p AS (SELECT {K}, {quantiles} FROM run GROUP BY {K}),
rob AS (SELECT {of("h")}, sum(CASE WHEN i >= p10 AND i <= p90 THEN c * i END) / sum(CASE WHEN i >= p10 AND i <= p90 THEN c END) AS rmean, sum(CASE WHEN i >= p10 AND i <= p90 THEN c END) AS rn FROM h JOIN p ON {on("h", "p")} GROUP BY {of("h")}),
rad AS (SELECT {of("h")}, sum(CASE WHEN i >= p10 AND i <= p90 THEN c * abs(i - rmean) END) / max(rn) AS rmad FROM h JOIN p ON {on("h", "p")} JOIN rob ON {on("h", "rob")} GROUP BY {of("h")}),
grey AS (SELECT {of("h")}, {folded(depth)} AS g, sum(c) AS c, max(n) AS n FROM h JOIN r ON {on("h", "r")} GROUP BY {of("h")}, {folded(depth)}),
e AS (SELECT {K}, -sum(c / n * log2(c / n + 2.2e-16)) AS entropy, sum(c / n * c / n) AS uniformity FROM grey GROUP BY {K}),
s AS (SELECT {of("r")}, n, mn, mx, s1, s2, smn, smx, m2, m3, m4, m5, m6, ad, med, mode_, mad, p01, p10, p25, p75, p90, p99, rmean, rmad, entropy, uniformity, s1 / n AS mu, CASE WHEN n > 1 THEN m2 / (n - 1) ELSE 0e0 END AS var
  FROM r JOIN slide ON r.slide_id = slide.slide_id JOIN m ON {on("r", "m")} JOIN med ON {on("r", "med")} JOIN md ON {on("r", "md")} JOIN p ON {on("r", "p")} JOIN rob ON {on("r", "rob")} JOIN rad ON {on("r", "rad")} JOIN e ON {on("r", "e")})
SELECT {K}, {div("sqrt(var)", "mu")} AS COV, {div("mx - mn", "smx - smn")} AS COVERED_IMAGE_INTENSITY_RANGE, s2 AS ENERGY, entropy AS ENTROPY,
  CASE WHEN n > 4 AND m2 > 0 THEN n * m4 / (m2 * m2) - 3e0 END AS EXCESS_KURTOSIS, {div("m6", "n * power(var, 3)")} AS HYPERFLATNESS, {div("m5", "n * power(var, 2.5e0)")} AS HYPERSKEWNESS,
  s1 AS INTEGRATED_INTENSITY, p75 - p25 AS INTERQUARTILE_RANGE, CASE WHEN n > 4 AND m2 > 0 THEN n * m4 / (m2 * m2) END AS KURTOSIS, mx AS MAX, mu AS MEAN, ad / n AS MEAN_ABSOLUTE_DEVIATION, med AS MEDIAN, mad / n AS MEDIAN_ABSOLUTE_DEVIATION,
  mn AS MIN, mode_ AS MODE, p01 AS P01, p10 AS P10, p25 AS P25, p75 AS P75, p90 AS P90, p99 AS P99, {div("p75 - p25", "p75 + p25")} AS QCOD, mx - mn AS RANGE, rmean AS ROBUST_MEAN, rmad AS ROBUST_MEAN_ABSOLUTE_DEVIATION, sqrt(s2 / n) AS ROOT_MEAN_SQUARED,
  CASE WHEN n > 3 AND m2 > 0 THEN sqrt(n) * m3 / power(m2, 1.5e0) END AS SKEWNESS, sqrt(var) AS STANDARD_DEVIATION, sqrt(m2 / n) AS STANDARD_DEVIATION_BIASED, sqrt(var / n) AS STANDARD_ERROR, var AS VARIANCE, m2 / n AS VARIANCE_BIASED,
  uniformity AS UNIFORMITY, (1e0 - {div("mx - mn", "mx + mn")}) * 100e0 AS UNIFORMITY_PIU FROM s"""
    return finished(inner, [(n, prefix + n) for n in INTENSITY], dialect)


def basic_sql(dialect: str = "spark") -> str:
    """The smallest slice: count, extrema, sum and mean, one shuffle."""
    inner = f"SELECT {K}, count(*) AS AREA_PIXELS_COUNT, min(inten) AS MIN, max(inten) AS MAX, sum(cast(inten as double)) AS INTEGRATED_INTENSITY, avg(cast(inten as double)) AS MEAN FROM {{pixels}} GROUP BY {K}"
    return finished(inner, ["AREA_PIXELS_COUNT", "MIN", "MAX", "INTEGRATED_INTENSITY", "MEAN"], dialect)


def histogram_sql(n: int = 16, dialect: str = "spark") -> str:
    """HISTOGRAM: one column for each of n bins, the maximum in the last."""
    columns = ", ".join(f"sum(CASE WHEN g = {k} THEN c ELSE 0e0 END) AS h{k}" for k in range(n))
    inner = f"WITH {counts()}, grey AS (SELECT {of('h')}, {folded(n)} AS g, c FROM h JOIN r ON {on('h', 'r')}) SELECT {K}, {columns} FROM grey GROUP BY {K}"
    return finished(inner, [(f"h{k}", f"HISTOGRAM_{k}") for k in range(n)], dialect)


def ih_sql(n: int = 16, dialect: str = "spark") -> str:
    """The 46 features of an n-bin intensity histogram, of bin centres (VAL) and of bin numbers from 1 (IDX).

    Quantiles lie inside a bin, scanned from the left below the middle and from the right above it. A region of one
    intensity has no histogram and gets noval throughout.
    """
    empty = " UNION ALL ".join(f"SELECT cast({k} as bigint) AS g" for k in range(n))
    quant = lambda q: f"max(CASE WHEN upto >= {q}e0 * n AND upto - c < {q}e0 * n THEN mn + bw * (g + ({q}e0 * n - (upto - c)) / c) END)" if q < 0.5 else f"min(CASE WHEN n - upto + c >= {1 - q:.2f}e0 * n AND n - upto < {1 - q:.2f}e0 * n THEN mn + bw * (g + 1e0 - ({1 - q:.2f}e0 * n - (n - upto)) / c) END)"
    where = lambda q: f"max(CASE WHEN upto >= {q}e0 * n AND upto - c < {q}e0 * n THEN g END)" if q < 0.5 else f"min(CASE WHEN n - upto + c >= {1 - q:.2f}e0 * n AND n - upto < {1 - q:.2f}e0 * n THEN g END)"

    def stats(suffix: str, x: str) -> str:
        """Statistics of a bin's value x, once the moments of its centre v are known."""
        scale, shift = ("1e0", "0e0") if suffix == "VAL" else ("1e0 / bw", "0.5e0 - mn / bw")
        lin = lambda e: f"(({e}) * {scale} + {shift})"
        wide = lambda e: f"(({e}) * {scale})"
        q = lambda p: lin(p) if suffix == "VAL" else f"({p.replace('v', '')}i + 1e0)"
        values = {
            "MEAN": lin("mu"), "VARIANCE": f"(m2 / n * {scale} * {scale})", "SKEWNESS": "m3 / n / nullif(power(m2 / n, 1.5e0), 0e0)", "EXCESS_KURTOSIS": "m4 / n / nullif(power(m2 / n, 2), 0e0) - 3e0", "MEDIAN": lin("med"),
            "MINIMUM": lin("lo"), "P10": q("p10v"), "P90": q("p90v"), "MAXIMUM": lin("hi"), "MODE": lin("mode_"), "INTERQUANTILE_RANGE": f"({q('p75v')} - {q('p25v')})", "RANGE": wide("hi - lo"), "MEAN_ABSOLUTE_DEVIATION": wide("ad / n"),
            "ROBUST_MEAN_ABSOLUTE_DEVIATION": wide("rmad"), "MEDIAN_ABSOLUTE_DEVIATION": wide("mad / n"), "COEFFICIENT_OF_VARIATION": div(f"sqrt(m2 / n) * {scale}", lin("mu")),
            "QUANTILE_COEFFICIENT_OF_DISPERSION": div(f"{q('p75v')} - {q('p25v')}", f"{q('p75v')} + {q('p25v')}"), "ENTROPY": "entropy", "UNIFORMITY": "uniformity", "ROBUST_MEAN": lin("rmean"),
        }
        return ", ".join(f"{v} AS IH_{k}_{suffix}" for k, v in values.items())

    inner = f"""WITH {counts()},
grey AS (SELECT {of("h")}, {folded(n)} AS g, sum(c) AS c FROM h JOIN r ON {on("h", "r")} GROUP BY {of("h")}, {folded(n)}),
frame AS (SELECT {of("r")}, e.g, r.n, r.mn, (r.mx - r.mn) / {n}e0 AS bw FROM r CROSS JOIN ({empty}) AS e WHERE r.mx > r.mn),
f AS (SELECT {of("frame")}, frame.g, frame.n, frame.mn, frame.bw, coalesce(grey.c, 0e0) AS c, frame.mn + (frame.g + 0.5e0) * frame.bw AS v FROM frame LEFT JOIN grey ON {on("frame", "grey", ["g"])}),
w AS (SELECT {K}, g, n, mn, bw, c, v, sum(c) OVER (PARTITION BY {K} ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, max(c) OVER (PARTITION BY {K}) AS most,
  lag(c) OVER (PARTITION BY {K} ORDER BY g) AS before, lead(c) OVER (PARTITION BY {K} ORDER BY g) AS after, sum(c * v) OVER (PARTITION BY {K}) / n AS mu FROM f),
d AS (SELECT {K}, g, n, mn, bw, c, v, upto, most, mu, CASE WHEN before IS NULL THEN after - c WHEN after IS NULL THEN c - before ELSE (after - before) / 2e0 END AS grad FROM w),
b AS (SELECT {K}, max(n) AS n, max(mn) AS mn, max(bw) AS bw, max(mu) AS mu, sum(c * power(v - mu, 2)) AS m2, sum(c * power(v - mu, 3)) AS m3, sum(c * power(v - mu, 4)) AS m4, sum(c * abs(v - mu)) AS ad,
  min(CASE WHEN upto > floor(n / 2e0) THEN v END) AS med, min(CASE WHEN c > 0 THEN v END) AS lo, max(CASE WHEN c > 0 THEN v END) AS hi, min(CASE WHEN c = most THEN v END) AS mode_,
  {quant(0.1)} AS p10v, {quant(0.25)} AS p25v, {quant(0.75)} AS p75v, {quant(0.9)} AS p90v, {where(0.1)} AS p10i, {where(0.25)} AS p25i, {where(0.75)} AS p75i, {where(0.9)} AS p90i,
  -sum(CASE WHEN c > 0 THEN c / n * log2(c / n) ELSE 0e0 END) AS entropy, sum(c / n * c / n) AS uniformity, max(grad) AS gmax, min(grad) AS gmin FROM d GROUP BY {K}),
gi AS (SELECT {of("d")}, min(CASE WHEN grad = gmax THEN g END) + 1e0 AS gmaxi, min(CASE WHEN grad = gmin THEN g END) + 1e0 AS gmini, sum(d.c * abs(d.v - b.med)) AS mad,
  sum(CASE WHEN g >= p10i AND g <= p90i THEN c * v END) / sum(CASE WHEN g >= p10i AND g <= p90i THEN c END) AS rmean, sum(CASE WHEN g >= p10i AND g <= p90i THEN c END) AS rn FROM d JOIN b ON {on("d", "b")} GROUP BY {of("d")}),
rb AS (SELECT {of("d")}, sum(CASE WHEN g >= p10i AND g <= p90i THEN c * abs(v - rmean) END) / max(rn) AS rmad FROM d JOIN b ON {on("d", "b")} JOIN gi ON {on("d", "gi")} GROUP BY {of("d")}),
x AS (SELECT {of("b")}, n, mn, bw, mu, m2, m3, m4, ad, med, lo, hi, mode_, p10v, p25v, p75v, p90v, p10i, p25i, p75i, p90i, entropy, uniformity, gmax, gmin, gmaxi, gmini, mad, rmean, rmad FROM b JOIN gi ON {on("b", "gi")} JOIN rb ON {on("b", "rb")}),
y AS (SELECT {K}, {stats("VAL", "v")}, {stats("IDX", "g")}, gmax AS IH_MAX_GRADIENT, gmaxi AS IH_MAX_GRADIENT_IDX, gmin AS IH_MIN_GRADIENT, gmini AS IH_MIN_GRADIENT_IDX, {n}e0 AS IH_NUM_BINS, bw AS IH_BIN_SIZE FROM x)
SELECT {of("r")}, {", ".join(IH)} FROM r LEFT JOIN y ON {on("r", "y")}"""
    return finished(inner, IH, dialect)
