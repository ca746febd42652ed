"""Regions against regions: neighbours, containment, nested aggregation, blacklists and the pairing of files."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roiforge.functions.sqltext import K, div, finished, of, on, with_rows

NEIGHBOURS = ("NUM_NEIGHBORS", "PERCENT_TOUCHING", "CLOSEST_NEIGHBOR1_DIST", "CLOSEST_NEIGHBOR1_ANG", "CLOSEST_NEIGHBOR2_DIST", "CLOSEST_NEIGHBOR2_ANG", "ANG_BW_NEIGHBORS_MEAN", "ANG_BW_NEIGHBORS_STDDEV", "ANG_BW_NEIGHBORS_MODE")
_WORD = (1 << 32) - 1
_FOUR = ((1, 0), (-1, 0), (0, 1), (0, -1))
_NINE = tuple((dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1))


def neighbours_sql(radius: int = 5, dialect: str = "spark") -> str:
    """The nine neighbour features. Regions are neighbours where their border pixels come within radius.

    A border pixel has a 4-neighbour outside the region. Distances and angles are between centroids, ties by label. Other engines
    check the words of 32 places by comparing pixels.
    """
    return finished(_neighbours_by_words(radius) if dialect == "spark" else _neighbours_by_pixels(radius, dialect), NEIGHBOURS, dialect)


def _neighbours_by_words(radius: int) -> str:
    """A region's row is words of 32 places, a bit each; shifts find its border and what lies within radius of it, and regions meet by word.

    There is no join: what is grouped or ordered has slide and t among its keys, so a table that is partitioned by slide moves no more.
    Places with a null coordinate, or of a region with a null key, are border and near nothing.
    """
    reach = [(dy, math.isqrt(math.floor(radius * radius - dy * dy))) for dy in range(-math.floor(radius), math.floor(radius) + 1)]
    # how far a border pixel touches to the sides, dy rows away: squared distances up to 2; nowhere is -1
    touch = lambda dy: next((c for c in (1, 0) if c * c + dy * dy <= min(2, radius * radius)), -1)
    # smearing a word by 1, 3, 9 and 18 places leaves no gaps, and 31 is all of it
    steps = lambda w: (a := min(w, 1), b := min(w - a, 3), c := min(w - a - b, 9), min(w - a - b - c, 18))
    rows = [(dy, k, w, touch(dy), *steps(min(w, 31))) for dy, w in reach for k in range(-((w + 31) // 32), (w + 31) // 32 + 1)]
    smeared, last = "", "e"
    for k in range(4):
        if any(r[4 + k] for r in rows):
            smeared += f"g{k} AS (SELECT *, ({last} | shiftleft({last}, s{k}) | shiftrightunsigned({last}, s{k})) & {_WORD} AS g{k} FROM {f'g{k - 1}' if k else 'shifted'}),\n"
            last = f"g{k}"
    within = " + ".join(f"{1 << j}e0 * bit_count(m & {sum(1 << b for b in range(32) if b >> j & 1)})" for j in range(5))
    beside = lambda f, window, step, sign: f"CASE WHEN {f}({step}) OVER {window} = {step} {sign} 1 THEN {f}(m) OVER {window} ELSE 0L END"
    return f"""WITH places AS (SELECT {K}, x, y, slide_id IS NULL OR t IS NULL OR label IS NULL OR x IS NULL OR y IS NULL AS alone FROM {{pixels}}),
words AS (SELECT {K}, y, shiftright(x, 5) AS bx, alone, CASE WHEN alone THEN x END AS ax, bit_or(CASE WHEN alone THEN 0L ELSE shiftleft(1L, cast(x & 31 as int)) END) AS m FROM places GROUP BY {K}, y, shiftright(x, 5), alone, CASE WHEN alone THEN x END),
sums AS (SELECT *, CASE WHEN alone THEN ax * 1e0 ELSE 32e0 * bx * bit_count(m) + {within} END AS sx, CASE WHEN alone THEN y * 1e0 ELSE y * 1e0 * bit_count(m) END AS sy, CASE WHEN alone THEN 1 ELSE bit_count(m) END AS n FROM words),
means AS (SELECT {K}, y, bx, m, alone, {div("sum(sx) OVER region", "sum(CASE WHEN sx IS NOT NULL THEN n END) OVER region")} AS cx, {div("sum(sy) OVER region", "sum(CASE WHEN sy IS NOT NULL THEN n END) OVER region")} AS cy FROM sums WINDOW region AS (PARTITION BY {K})),
around AS (SELECT *, {beside("lag", "down", "y", "-")} AS above, {beside("lead", "down", "y", "+")} AS below, {beside("lag", "along", "bx", "-")} AS before, {beside("lead", "along", "bx", "+")} AS after
  FROM means WINDOW down AS (PARTITION BY {K}, bx ORDER BY y), along AS (PARTITION BY {K}, y ORDER BY bx)),
edges AS (SELECT {K}, y, bx, cx, cy, cast(alone as int) AS alone, m & ~(above & below & (shiftleft(m, 1) | shiftrightunsigned(before, 31)) & (shiftrightunsigned(m, 1) | shiftleft(after & 1L, 31))) AS e FROM around),
ends AS (SELECT *, bit_count((e & -e) - 1) AS lo, length(bin(e)) - 1 AS hi FROM edges WHERE e <> 0 OR alone = 1),
shifted AS (SELECT * FROM {with_rows("ends", "p", rows, ("dy", "k", "w", "c", "s0", "s1", "s2", "s3"), "spark")} WHERE e <> 0 OR dy = 0 AND k = 0),
{smeared}spread AS (SELECT {K}, y + dy AS y, bx + k AS bx, cx, cy, CASE WHEN dy = 0 AND k = 0 THEN e ELSE 0L END AS own, CASE WHEN dy = 0 AND k = 0 THEN alone ELSE 0 END AS alone,
  CASE WHEN k = 0 THEN {last} WHEN k > 0 THEN shiftleft(1L, least(32, greatest(0, hi + w - 32 * k + 1))) - 1L ELSE {1 << 32}L - shiftleft(1L, least(32, greatest(0, lo - w - 32 * k))) END AS reach,
  CASE WHEN c < 0 THEN 0L WHEN k = 0 THEN (e | shiftleft(e, c) | shiftrightunsigned(e, c)) & {_WORD} WHEN c = 1 AND k = 1 THEN shiftrightunsigned(e, 31) WHEN c = 1 AND k = -1 THEN shiftleft(e & 1L, 31) ELSE 0L END AS close FROM {last if smeared else "shifted"}),
mine AS (SELECT {K}, y, bx, max(cx) AS cx, max(cy) AS cy, bit_or(own) AS own, sum(alone) AS alone, bit_or(reach) AS reach, bit_or(close) AS close FROM spread WHERE reach <> 0 OR alone > 0 GROUP BY {K}, y, bx),
cells AS (SELECT slide_id, t, collect_list(struct(label, own, alone, reach, close, cx, cy)) AS cell FROM mine GROUP BY slide_id, t, y, bx HAVING bit_or(own) <> 0 OR max(alone) > 0),
near AS (SELECT {K}, cx, cy, bit_count(own) + alone AS border, bit_count(own & aggregate(cell, 0L, (s, c) -> CASE WHEN c.label <> label THEN s | c.close ELSE s END)) AS touching, filter(cell, c -> c.label <> label AND (c.reach & own) <> 0) AS others
  FROM cells LATERAL VIEW inline(cell) a AS label, own, alone, reach, close, cx, cy WHERE own <> 0 OR alone > 0),
pair AS (SELECT {K}, o.label AS other, max(cx) AS cx, max(cy) AS cy, max(o.cx) AS ox, max(o.cy) AS oy, sum(CASE WHEN coalesce(k, 0) = 0 THEN border END) AS border, sum(CASE WHEN coalesce(k, 0) = 0 THEN touching END) AS touching FROM near LATERAL VIEW OUTER posexplode(others) e AS k, o GROUP BY {K}, o.label),
geo AS (SELECT {K}, other, border, touching, sqrt(power(cx - ox, 2) + power(cy - oy, 2)) AS dist, degrees(atan2(oy - cy, ox - cx)) AS raw FROM pair),
ang AS (SELECT {K}, other, border, touching, dist, CASE WHEN raw < 0 THEN raw + 360e0 ELSE raw END AS ang, row_number() OVER (PARTITION BY {K} ORDER BY CASE WHEN other IS NULL THEN 1 ELSE 0 END, cast(dist as float), other) AS k FROM geo),
modes AS (SELECT *, floor(ang + 0.5e0) AS a, count(other) OVER (PARTITION BY {K}, floor(ang + 0.5e0)) AS c FROM ang)
SELECT {K}, count(other) AS NUM_NEIGHBORS, 100e0 * sum(touching) / sum(border) AS PERCENT_TOUCHING, max(CASE WHEN k = 1 THEN dist END) AS CLOSEST_NEIGHBOR1_DIST, max(CASE WHEN k = 1 THEN ang END) AS CLOSEST_NEIGHBOR1_ANG, max(CASE WHEN k = 2 THEN dist END) AS CLOSEST_NEIGHBOR2_DIST,
  max(CASE WHEN k = 2 THEN ang END) AS CLOSEST_NEIGHBOR2_ANG, avg(ang) AS ANG_BW_NEIGHBORS_MEAN, CASE WHEN count(other) > 2 THEN stddev_samp(ang) END AS ANG_BW_NEIGHBORS_STDDEV, -max(CASE WHEN other IS NOT NULL THEN struct(c, -a AS b) END).b AS ANG_BW_NEIGHBORS_MODE FROM modes GROUP BY {K}"""


def _neighbours_by_pixels(radius: int, dialect: str) -> str:
    """Border pixels meet by an equi-join on cells of the radius' side, each with the nine around it."""
    shifted = with_rows("px", "p", _FOUR, ("dx", "dy"), dialect)
    spread = with_rows("e", "p", _NINE, ("dx", "dy"), dialect)
    inner = f"""WITH px AS (SELECT DISTINCT {K}, x, y FROM {{pixels}}),
s AS (SELECT {K}, x AS x0, y AS y0, x + dx AS x, y + dy AS y FROM {shifted}),
inn AS (SELECT {of("s")}, x0, y0, count(*) AS k FROM s JOIN px ON {on("s", "px", ["x", "y"])} GROUP BY {of("s")}, x0, y0),
e AS (SELECT {of("px")}, px.x, px.y, cast(floor(px.x / {radius}e0) as bigint) AS gx, cast(floor(px.y / {radius}e0) as bigint) AS gy FROM px LEFT JOIN inn ON {on("px", "inn")} AND px.x = inn.x0 AND px.y = inn.y0 WHERE coalesce(k, 0) < 4),
w AS (SELECT {K}, x, y, gx + dx AS gx, gy + dy AS gy FROM {spread}),
near AS (SELECT a.slide_id, a.t, a.label, b.label AS other, a.x, a.y, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM w a JOIN e b ON a.slide_id = b.slide_id AND a.t = b.t AND a.gx = b.gx AND a.gy = b.gy AND a.label <> b.label
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {radius * radius} GROUP BY a.slide_id, a.t, a.label, b.label, a.x, a.y),
touch AS (SELECT {K}, count(*) AS touching FROM (SELECT DISTINCT {K}, x, y FROM near WHERE d2 <= 2) AS d GROUP BY {K}),
len AS (SELECT {K}, count(*) AS border FROM e GROUP BY {K}),
cen AS (SELECT {K}, avg(x * 1e0) AS cx, avg(y * 1e0) AS cy FROM px GROUP BY {K}),
pair AS (SELECT DISTINCT {K}, other FROM near),
geo AS (SELECT {of("pair")}, other, sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) AS dist, degrees(atan2(b.cy - a.cy, b.cx - a.cx)) AS raw FROM pair JOIN cen a ON {on("pair", "a")} JOIN cen b ON pair.slide_id = b.slide_id AND pair.t = b.t AND pair.other = b.label),
ang AS (SELECT {K}, other, dist, CASE WHEN raw < 0 THEN raw + 360e0 ELSE raw END AS ang, row_number() OVER (PARTITION BY {K} ORDER BY cast(dist as float), other) AS k FROM geo),
modes AS (SELECT {K}, a, count(*) AS c FROM (SELECT {K}, floor(ang + 0.5e0) AS a FROM ang) AS q GROUP BY {K}, a),
top AS (SELECT {K}, max(c) AS c FROM modes GROUP BY {K}),
md AS (SELECT {of("modes")}, min(a) AS a FROM modes JOIN top ON {on("modes", "top")} AND modes.c = top.c GROUP BY {of("modes")}),
n AS (SELECT {K}, count(*) AS n, max(CASE WHEN k = 1 THEN dist END) AS d1, max(CASE WHEN k = 1 THEN ang END) AS a1, max(CASE WHEN k = 2 THEN dist END) AS d2, max(CASE WHEN k = 2 THEN ang END) AS a2, avg(ang) AS am, CASE WHEN count(*) > 2 THEN stddev_samp(ang) END AS asd FROM ang GROUP BY {K})
SELECT {of("len")}, n AS NUM_NEIGHBORS, 100e0 * touching / border AS PERCENT_TOUCHING, d1 AS CLOSEST_NEIGHBOR1_DIST, a1 AS CLOSEST_NEIGHBOR1_ANG, d2 AS CLOSEST_NEIGHBOR2_DIST, a2 AS CLOSEST_NEIGHBOR2_ANG, am AS ANG_BW_NEIGHBORS_MEAN, asd AS ANG_BW_NEIGHBORS_STDDEV, md.a AS ANG_BW_NEIGHBORS_MODE
FROM len LEFT JOIN n ON {on("len", "n")} LEFT JOIN touch ON {on("len", "touch")} LEFT JOIN md ON {on("len", "md")}"""
    return inner


# --- nested regions --------------------------------------------------------------------------------------------------


_BOX = f"SELECT {K}, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {{}} GROUP BY {K}"


def containment_candidates_sql(parents: str = "{parents}", children: str = "{children}") -> str:
    """Pairs of boxes (p_label, px0.., c_label, cx0..) that may be nested, by a hierarchy of grids.

    A parent's level is that of the least power of two not below its longer side: it touches at most four cells of that side. A child
    lies in a parent only if its corner lies in one of these cells, so it looks up one cell for each level that its slide's parents have and that isn't below its own.
    """
    level = lambda v: f"length(bin(cast(greatest({v}x1 - {v}x0, {v}y1 - {v}y0) as bigint)))"
    cell = lambda v: f"cast(floor({v} / power(2e0, lv)) as bigint)"
    return f"""WITH p AS (SELECT *, {level("")} AS lv FROM ({_BOX.format(parents)}) AS b), c AS ({_BOX.format(children)}),
grid AS (SELECT * FROM p LATERAL VIEW explode(sequence({cell("x0")}, {cell("x1")})) e AS gx LATERAL VIEW explode(sequence({cell("y0")}, {cell("y1")})) f AS gy),
levels AS (SELECT DISTINCT slide_id, t, lv FROM p),
probe AS (SELECT c.*, lv, {cell("x0")} AS gx, {cell("y0")} AS gy FROM c JOIN levels ON c.slide_id = levels.slide_id AND c.t = levels.t AND lv >= {level("c.")})
SELECT g.slide_id, g.t, g.label AS parent_label, g.x0 AS px0, g.x1 AS px1, g.y0 AS py0, g.y1 AS py1, q.label AS child_label, q.x0, q.x1, q.y0, q.y1
FROM grid g JOIN probe q ON g.slide_id = q.slide_id AND g.t = q.t AND g.lv = q.lv AND g.gx = q.gx AND g.gy = q.gy"""


def containment_sql(parents: str = "{parents}", children: str = "{children}", dialect: str = "spark") -> str:
    """Relations (slide_id, t, parent_label, child_label): the parent's box contains the child's, borders included.

    parents and children are tables of pixels of the same slides. Other engines check the grids by comparing all boxes of a slide.
    """
    if dialect == "spark":
        return f"SELECT slide_id, t, parent_label, child_label FROM ({containment_candidates_sql(parents, children)}) AS near WHERE px0 <= x0 AND px1 >= x1 AND py0 <= y0 AND py1 >= y1"
    return f"""SELECT p.slide_id, p.t, p.label AS parent_label, c.label AS child_label FROM ({_BOX.format(parents)}) AS p JOIN ({_BOX.format(children)}) AS c
ON p.slide_id = c.slide_id AND p.t = c.t AND p.x0 <= c.x0 AND p.x1 >= c.x1 AND p.y0 <= c.y0 AND p.y1 >= c.y1"""


#: Names of aggregates.
_AGGREGATES: dict[str, Callable] = {"SUM": F.sum, "MEAN": F.avg, "MIN": F.min, "MAX": F.max, "WMA": F.avg, "COUNT": F.count, "STD": F.stddev_samp, "VAR": F.var_samp, "MEDIAN": F.median, "FIRST": F.first, "LAST": F.last, "NUNIQUE": F.count_distinct, "PROD": F.product}


def _aggregate(how: str | Callable, column: Column) -> tuple[Column, bool]:
    """The aggregate of a column, and whether Python computes it: names and functions of columns are Spark's, others get a group's values as a pandas Series."""
    if isinstance(how, str):
        return _AGGREGATES[how.upper()](column), False
    try:
        found = how(column)
    except Exception:  # noqa: BLE001 - a function of values may fail on a column in any way
        found = None
    if isinstance(found, Column):
        return found, False

    def values(v: pd.Series) -> float:
        return float(how(v))

    return F.pandas_udf(values, "double")(column), True


def aggregate_children(relations: DataFrame, parents: DataFrame, children: DataFrame, how: str | Callable | Sequence | dict[str, str | Callable], features: Sequence[str], least_children: int = 0) -> DataFrame:
    """Parents' rows with their children's features: aggregated by name (SUM, MEAN, MIN, MAX, WMA (equal to MEAN), COUNT, STD, VAR, MEDIAN, FIRST, LAST, NUNIQUE, PROD) or function, or NONE.

    A function takes a column and gives an aggregate, or takes a pandas Series of a parent's values, as np.nanmean does; then a parent's children are one
    group of a task. how may be a dict from feature to aggregate, or a list of aggregates and of (name, aggregate): child_F, or child_F_name for each of a list.
    NONE puts all children side by side, child1_F, child2_F, ... by ascending label: as many as the largest family has (counted by a
    job of its own when this is called), least_children at least. Parents without children get zeros.
    """
    keys = ["slide_id", "t", "parent_label"]
    joined = relations.join(children.withColumnRenamed("label", "child_label"), ["slide_id", "t", "child_label"])
    if how == "NONE":
        from pyspark.sql import Window

        width = max(least_children, joined.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
        if not width:
            return parents.withColumnRenamed("label", "parent_label")
        ranked = joined.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("child_label")))
        wide = [ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col(f"`{f}`"))).alias(f"child{k}_{f}") for k in range(1, width + 1) for f in features])]
        added = [f"child{k}_{f}" for k in range(1, width + 1) for f in features]
    else:
        if isinstance(how, dict):
            asked = [(f, f"child_{f}", a) for f, a in how.items()]
        elif isinstance(how, (list, tuple)):
            named = [h if isinstance(h, tuple) else (h.lower() if isinstance(h, str) else h.__name__, h) for h in how]
            asked = [(f, f"child_{f}_{n}", a) for f in features for n, a in named]
        else:
            asked = [(f, f"child_{f}", how) for f in features]
        made = [(name, *_aggregate(a, F.col(f"`{f}`"))) for f, name, a in asked]
        # Spark computes its own aggregates and those of pandas apart
        wide = [joined.groupBy(*keys).agg(*[c.alias(n) for n, c, python in made if python == side]) for side in (False, True) if any(m[2] == side for m in made)]
        added = [n for n, *_ in made]
    found = parents.withColumnRenamed("label", "parent_label")
    for w in wide:
        found = found.join(w, keys, "left")
    return found.fillna(0, subset=added).select(*[c for c in found.columns if c not in added], *[F.col(f"`{c}`") for c in added])


# --- lists and names -------------------------------------------------------------------------------------------------


def parse_blacklist(text: str) -> tuple[set[int], dict[str, set[int]]]:
    """`1,2,3` for all files, or `f1:1,2;f2:3` by file; a global list wins over lists by file."""
    numbers = lambda s: {int(x) for x in s.split(",") if x.strip()}
    if not text.strip():
        return set(), {}
    if ":" not in text:
        return numbers(text), {}
    by_file: dict[str, set[int]] = {}
    for part in filter(str.strip, text.split(";")):
        name, _, labels = part.partition(":")
        by_file.setdefault(name.strip(), set()).update(numbers(labels))
    return set(), by_file


def without_blacklisted(rows: DataFrame, text: str, file_column: str = "slide_id") -> DataFrame:
    """rows less those of blacklisted labels; the list comes from a configuration and is broadcast."""
    everywhere, by_file = parse_blacklist(text)
    if everywhere:
        return rows.where(~F.col("label").isin(sorted(everywhere)))
    if not by_file:
        return rows
    listed = rows.sparkSession.createDataFrame([(f, x) for f, s in sorted(by_file.items()) for x in sorted(s)], f"{file_column} string, label bigint")
    return rows.join(F.broadcast(listed), [file_column, "label"], "left_anti")


def pair_by_name(intensity: DataFrame, masks: DataFrame, pattern: str = ".*") -> DataFrame:
    """(intensity_image, mask_image) of equal base name, among names that match pattern as a whole and start with no dot.

    Names on one side only are an error, as are counts that differ; rows have a column path.
    """
    named = lambda df, c: df.select(F.col("path").alias(c), F.element_at(F.split("path", "/"), -1).alias("name")).where(F.col("name").rlike(f"^(?:{pattern})$") & ~F.col("name").startswith("."))
    a, b = named(intensity, "intensity_image"), named(masks, "mask_image")
    alone = a.join(b, "name", "left_anti").select("name").union(b.join(a, "name", "left_anti").select("name"))
    missing = [r[0] for r in alone.limit(5).collect()]
    if missing:
        raise ValueError(f"files without a partner: {', '.join(missing)}")
    return a.join(b, "name")


def pair_by_file(lines: DataFrame, intensity_dir: str, mask_dir: str) -> DataFrame:
    """Pairs from a mapping file's lines (value): two names separated by white space."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(F.concat(F.lit(intensity_dir.rstrip("/") + "/"), parts[0]).alias("intensity_image"), F.concat(F.lit(mask_dir.rstrip("/") + "/"), parts[1]).alias("mask_image"))


def annotations(name: str, separator: str = "_") -> list[str]:
    """A mask's annotations: its base name before the first dot, split at separators."""
    return [x for x in name.split("/")[-1].split(".")[0].split(separator) if x]


def annotations_of(column: str, separator: str = "_") -> Column:
    """annotations() of a column of file names."""
    return F.filter(F.split(F.element_at(F.split(F.element_at(F.split(column, "/"), -1), r"\."), 1), re.escape(separator)), lambda x: x != "")


def stack_pattern(pattern: str) -> re.Pattern | None:
    """A pattern of names in which {d+} stands for digits, {c+} for letters and {set d+} or {set,d+} for the z index; None if it names no index."""
    parts = re.split(r"(\{[^}]*\})", pattern)
    known = {"{d+}": r"\d+", "{c+}": "[A-Za-z]+", "{set d+}": r"(?P<z>\d+)", "{set,d+}": r"(?P<z>\d+)"}
    if not any(p in ("{set d+}", "{set,d+}") for p in parts):
        return None
    if any(p.startswith("{") and p not in known for p in parts):
        raise ValueError("only {d+}, {c+} and {set d+} are known in a pattern of z-stacks")
    return re.compile("".join(known.get(p, re.escape(p)) for p in parts))


def pair_by_channel(paths: Sequence[str], signature: str, parent: int, child: int) -> list[tuple[str, str, str]]:
    """(name without channel, parent's path, child's path) of files that differ only in the number after the last signature in their names."""
    found: dict[str, dict[int, str]] = {}
    for path in paths:
        folder, _, name = path.rpartition("/")
        at = name.rfind(signature)
        m = re.match(r"\d+", name[at + len(signature) :]) if at >= 0 else None
        if not m:
            raise ValueError(f"no channel number after {signature!r} in {name}")
        found.setdefault(f"{folder}/{name[:at]}{name[at + len(signature) + m.end() :]}", {})[int(m[0])] = path
    return [(stem.rpartition("/")[2], c[parent], c[child]) for stem, c in sorted(found.items()) if parent in c and child in c]


def stack_key(name: str) -> tuple[str, int] | None:
    """(name without its z index, z) of a file of a z-stack, named ..._z<digits>...; None for other names."""
    m = re.fullmatch(r"(.*_z)(\d+)(.*)", name)
    return (m[1] + m[3], int(m[2])) if m else None
